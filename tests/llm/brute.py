"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(spans: list) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    total = sum(d if k % 2 == 0 else (2 * d - 9 * (2 * d > 9)) for k, d in enumerate(reversed(digits)))
    return 12 <= len(digits) <= 19 and total % 10 == 0


def private(text: str) -> list:
    kinds = ["email", "ip", "card", "phone"]
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [
        (m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(part) <= 255 for part in m[0].split("."))
    ]
    found += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if luhn(m[0])]
    found += [
        (m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15
    ]
    return sorted(found, key=lambda s: (s[0], kinds.index(s[2])))


def secret(text: str) -> list:
    assign = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [(m.start(), m.end(), "assign") for m in re.finditer(assign, text, re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def repeats(text: str) -> dict:
    words = WORD.findall(text)
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def bag(text: str) -> Counter:
    words = WORD.findall(text)
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def near_classes(docs: list[tuple]) -> dict:
    """Smallest id of each document's class, comparing all pairs."""
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(i, text, bag(text)) for i, text in docs]
    for at, (i, text, one) in enumerate(bags):
        for j, other_text, other in bags[:at]:
            shared = (one & other).total()
            union = one.total() + other.total() - shared
            if text == other_text or (union and 5 * shared >= 4 * union):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = defaultdict(list)
    for i, _ in docs:
        groups[find(i)].append(i)
    return {i: min(members) for members in groups.values() for i in members}


def edits_within(passage: bytes, text: bytes) -> int:
    """Least edits between the passage and any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    steps = np.arange(len(text) + 1)
    symbols = np.frombuffer(text, np.uint8)
    for i, c in enumerate(passage, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (symbols != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def language_model(docs: list[tuple]) -> dict:
    """Per id: tokens, known tokens, base score and score; and the number of training tokens."""
    counts, contexts = Counter(), [defaultdict(Counter) for _ in range(4)]

    def tokens(text):
        return [*WORD.findall(text.translate(ASCII_LOWER)), None]

    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(text))
            data = b"\0\0\0" + text.encode() + b"\0"
            for at in range(3, len(data)):
                for k in range(4):
                    contexts[k][data[at - k:at]][data[at]] += 1
    n, v = counts.total(), len(counts)

    def log_share(data, at):
        seen, total = set(), 0.0
        for k in (3, 2, 1, 0):
            here = {s: c for s, c in contexts[k].get(data[at - k:at], {}).items() if s not in seen}
            if data[at] in here:
                return total + math.log10(here[data[at]] / (sum(here.values()) + len(here)))
            if here:
                total += math.log10(len(here) / (sum(here.values()) + len(here)))
            seen |= set(contexts[k].get(data[at - k:at], {}))
        return total - math.log10(256 - len(seen))

    out = {}
    for i, text in docs:
        listed = tokens(text)
        data = b"\0\0\0" + text.encode() + b"\0"
        out[i] = (
            len(listed), sum(counts[w] > 0 for w in listed), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in listed),
            sum(log_share(data, at) for at in range(3, len(data))),
        )
    return {"train_tokens": n, "docs": out}
