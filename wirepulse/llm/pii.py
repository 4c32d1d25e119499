"""Personal data: cues found by one Aho-Corasick pass, spans grown by local parsers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.spans import BASE_COLUMNS, Span, base_columns
from wirepulse.llm.text import map_texts

#: Kinds whose spans are fixed, in their order; then those that the cues add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "url_login", "iban", "account", "national_id", "ipv6")
KINDS = BASE + ADDED

# Fixed patterns of the base kinds, each tried only where an anchor leads to its start.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# What the added kinds look for after their cue.
LOGIN = re.compile(r"://[^\s/@:\"'<>]{1,64}:[^\s/@\"'<>]{1,64}@[A-Za-z0-9.-]+")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}$")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[\x20.:#]{0,3}(?:no|number|nr)?[\x20.:#]{0,3}([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])")
NATIONAL = re.compile(r"[\x20.:#]{0,3}(?:no|number|nr)?[\x20.:#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
ADDRESS = re.compile(r"[0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][A-Za-z'.-]{0,30}\x20){1,4}$")
SIX = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:])")

#: Cues of the added kinds, matched in lower case.
CUES = {
    "://": "scheme", "iban": "iban", "account": "account", "acct": "account", "konto": "account", "compte": "account",
    "cuenta": "account", "ssn": "national", "social security": "national", "::": "six",
    " street": "address", " avenue": "address", " road": "address", " lane": "address", " boulevard": "address",
}


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def valid_ip(text: str) -> bool:
    parts = [part.lstrip("0") or "0" for part in text.split(".")]
    return all(len(part) <= 3 and int(part) <= 255 for part in parts)


def valid_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def valid_phone(text: str) -> bool:
    return 9 <= len(DIGIT.findall(text)) <= 15


def valid_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _automaton(anchors: Iterable[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for anchor in anchors:
        machine.add_word(anchor, anchor)
    machine.make_automaton()
    return machine


@lru_cache(maxsize=1)
def _anchors():
    """At-signs, plus signs, digits, schemes and the cue words."""
    return _automaton({"@", "+", *"0123456789", *CUES})


class _Base:
    """Leftmost non-overlapping matches per kind, in the order their anchors come.

    ``done`` is where the last match of a kind ended, kept or not; a pattern may only start
    there or later.
    """

    def __init__(self, text: str) -> None:
        self.text, self.spans = text, []
        self.done = dict.fromkeys(BASE, 0)

    def grow(self, kind: str, start: int, pattern: re.Pattern, valid: Callable[[str], bool]) -> None:
        if start >= self.done[kind] and (match := pattern.match(self.text, start)):
            self.done[kind] = match.end()
            if valid(match[0]):
                self.spans.append((start, match.end(), kind))

    def at_sign(self, at: int) -> None:
        start, text = at, self.text
        while start > self.done["email"] and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (match := DOMAIN.match(text, at + 1)):
            self.done["email"] = match.end()
            self.spans.append((start, match.end(), "email"))

    def digit(self, at: int) -> None:
        """Patterns of digits start at the first digit of a run, or where a match ended."""
        before = self.text[at - 1] if at else ""
        run = not ("0" <= before <= "9")
        if run or at == self.done["ip"]:
            self.grow("ip", at, IP, valid_ip)
        if run or at == self.done["card"]:
            self.grow("card", at, CARD, valid_card)


def _added(text: str, cue: str, end: int) -> Span | None:
    """The span that a cue leads to; ``end`` is just after the cue."""
    kind = CUES[cue]
    if kind == "scheme":
        match, scheme = LOGIN.match(text, end - 3), SCHEME.search(text, max(0, end - 19), end - 3)
        return (scheme.start(), match.end(), "url_login") if match and scheme else None
    if kind == "iban":
        match = IBAN.search(text, end, end + 60)
        return (match.start(), match.end(), "iban") if match and valid_iban(match[0]) else None
    if kind in ("account", "national"):
        match = (ACCOUNT if kind == "account" else NATIONAL).match(text, end)
        name = "account" if kind == "account" else "national_id"
        return (match.start(1), match.end(1), name) if match else None
    if kind == "address":
        match = ADDRESS.search(text, max(0, end - len(cue) - 150), end - len(cue) + 1)
        return (match.start(), end, "address") if match else None
    match = next((m for m in SIX.finditer(text, max(0, end - 41), end + 40) if m.start() < end <= m.end()), None)
    if match is None:
        return None
    try:
        IPv6Address(match[0])
    except AddressValueError:
        return None
    return (match.start(), match.end(), "ipv6") if len(match[0]) > 2 else None


def find(text: str) -> list[Span]:
    """All spans ``(start, end, kind)`` of a text, by start, then in order of kinds."""
    base, added = _Base(text), set()
    # Lower case of the cues must not move positions.
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(_LOWER)
    for end, anchor in _anchors().iter(lower):
        if anchor == "@":
            base.at_sign(end)
        elif anchor == "+":
            base.grow("phone", end, PHONE, valid_phone)
        elif anchor in CUES:
            span = _added(text, anchor, end + 1)
            if span:
                added.add(span)
        else:
            base.digit(end)
    return sorted([*base.spans, *added], key=lambda span: (span[0], KINDS.index(span[2]), span[1]))


_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

SCHEMA = ", ".join(["doc_id long", *(f"n_{kind} long" for kind in BASE), BASE_COLUMNS, "n_added long"])


def _rows(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
    found = [find(text.decode("utf-8", "replace")) for text in texts]
    return {"doc_id": ids, **base_columns(found, BASE), "n_added": [sum(s[2] in ADDED for s in spans) for spans in found]}


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans.

    Spans are ``kind:start:end`` in code points, end exclusive. Null or empty texts have
    none; repeated rows are read one by one; an empty table gives an empty result; columns
    other than ``doc_id`` and ``text`` are not read. Nothing is shuffled.
    """
    return map_texts(docs, _rows, SCHEMA)


def masked(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind; of overlapping spans the first."""

    def rows(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
        out = []
        for text in (t.decode("utf-8", "replace") for t in texts):
            parts, at = [], 0
            for start, end, kind in find(text):
                if start >= at:
                    parts += [text[at:start], mark.format(kind)]
                    at = end
            out.append("".join([*parts, text[at:]]))
        return {"doc_id": ids, "text": out}

    return map_texts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rows, "doc_id long, text string")
