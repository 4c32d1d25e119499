"""Quality rules on repetition, found with a suffix array over the words of each text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wirepulse.llm.text import BLANKS, groups, map_texts, utf8

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20

#: The method's own limits: words inside repeats of at least ``MIN_REPEAT`` words, and the
#: longest repeat; both as a share of the words.
MIN_REPEAT = 3
MAX_COVERED = 0.40
MAX_LONGEST = 0.15
#: A repeat shorter than this is never too long, however short the text.
LONG_REPEAT = 25

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)


def suffix_array(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and adjacent longest common prefixes of many sequences at once.

    ``symbols`` are small integers, ``owner`` the sequence that each belongs to (ascending).
    A prefix never crosses from one sequence into the next. Sorting doubles the compared
    length and touches only suffixes that still tie, so plain prose is done in a few rounds.
    ``lcp[k]`` belongs to the suffixes at ``k - 1`` and ``k``.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = owner.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    end = np.searchsorted(owner, owner, side="right")
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, slots, 0))
    levels = [(1, rank.copy())]
    tied = ~fresh | ~np.r_[fresh[1:], True]
    active = slots[tied]
    length = 1
    while len(active):
        suffixes = order[active]
        after = suffixes + length
        inside = after < end[suffixes]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[suffixes] * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        order[active] = suffixes = suffixes[by]
        pair = pair[by]
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        rank[suffixes] = np.maximum.accumulate(np.where(fresh, active, 0))
        length *= 2
        tied = ~fresh | ~np.r_[fresh[1:], True]
        active = active[tied]
        levels.append((length, rank.copy()))
    lcp = np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for length, at in reversed(levels):
        a, b = left + common, right + common
        inside = (a < end[left]) & (b < end[right])
        same = inside & (at[np.minimum(a, n - 1)] == at[np.minimum(b, n - 1)])
        common += np.where(same, length, 0)
    lcp[1:] = common
    return order, lcp


def covered(starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, n_owners: int) -> np.ndarray:
    """Positions per sequence inside the union of spans, none of which crosses sequences."""
    edge = np.zeros(len(owner) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    inside = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[inside], minlength=n_owners)


def longest_repeats(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position the longest substring from it that occurs twice in its sequence.

    In the suffix array that is the larger of the prefixes shared with either neighbour:
    the deepest longest-common-prefix interval that holds the suffix.
    """
    order, lcp = suffix_array(symbols, owner)
    longest = np.zeros(len(symbols), np.int64)
    longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return longest


def measure(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
    n = len(texts)
    words = [text.split() for text in texts]
    n_words = np.fromiter(map(len, words), np.int64, n)
    number: dict[bytes, int] = defaultdict(count().__next__)
    symbols = np.fromiter((number[w] for doc in words for w in doc), np.int64, int(n_words.sum()))
    owner = np.repeat(np.arange(n), n_words)
    longest = longest_repeats(symbols, owner)
    at = np.flatnonzero(longest >= REPEAT_WINDOW)
    n_repeat = covered(at, np.full(len(at), REPEAT_WINDOW), owner, n)
    at = np.flatnonzero(longest >= MIN_REPEAT)
    n_covered = covered(at, longest[at], owner, n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, longest)
    lines = [[line for line in text.split(b"\n") if line.strip()] for text in texts]
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    limit = np.maximum(LONG_REPEAT, MAX_LONGEST * n_words)
    return {
        "doc_id": ids,
        "n_words": n_words,
        "word_chars": np.fromiter((_code_points(t.translate(None, BLANKS)) for t in texts), np.int64, n),
        "n_symbols": np.fromiter((len(t) - len(t.translate(None, SYMBOLS)) for t in texts), np.int64, n),
        "n_dup_lines": np.fromiter((len(doc) - len(set(doc)) for doc in lines), np.int64, n),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & (n_covered <= MAX_COVERED * n_words) & (most <= limit),
        "covered_words": n_covered,
        "longest_repeat": most,
    }


def _code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def quality_measures(docs: DataFrame) -> DataFrame:
    """One row per document with its repetition measures and the verdict ``kept``.

    A null or empty text has no words, so ``base_failed`` is true; repeated rows are judged
    one by one; an empty table gives an empty result; columns other than ``doc_id`` and
    ``text`` are not read. Time grows with the text, and memory with the longest text.
    """
    return map_texts(docs, measure, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is ``kept``, with all their columns, in one pass.

    Needs a ``text`` column; null texts go, as texts without words do.
    """
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(at))
            for a, b in groups(texts):
                kept = measure(pa.nulls(b - a), texts[a:b])["kept"]
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
