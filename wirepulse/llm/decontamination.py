"""Benchmark decontamination: the q-gram lemma as filter, banded alignment as proof."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.text import map_texts, utf8
from wirepulse.session import materialise, scratch_path

#: Items and texts of fewer bytes (in normal form) match nothing; texts are kept so far apart.
Q = 8
#: Bytes in a q-gram: the first of these with which the lemma asks a passage for a shared one.
#: The last does so for any passage of ``Q`` bytes or more.
GRAMS = (8, 4)
#: Edits allowed, as a share of a passage's bytes.
EDIT_RATE = 0.08
#: Longer items are looked for in passages of this many bytes, one every ``STRIDE``; so any excerpt
#: of ``PASSAGE + STRIDE - 1`` bytes holds a whole one.
PASSAGE = 80
STRIDE = PASSAGE // 4
#: And in longer passages, every half of it, whose budget allows more edits at one place.
LONG = 160
#: One index covers passages of about this many bytes; a larger benchmark is taken in turns.
BLOCK_BYTES = 2 << 20
TABLE_BITS = 20

#: Documents are searched in groups of this many bytes; a longer one in windows of as many, which overlap.
WINDOW = 1 << 20
#: Entries of the index that are laid out at once.
ENTRIES = 1 << 18

_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")

HITS = "doc_id long, passage binary, distance long"


def normal(text: bytes) -> bytes:
    """Lower case, one space between words."""
    lower = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    lower = lower.translate(_SPACES)
    while b"  " in lower:
        lower = lower.replace(b"  ", b" ")
    return lower.strip(b" ")


def cuts(text: bytes, size: int, stride: int) -> set[bytes]:
    """Passages of ``size`` bytes, one every ``stride`` and one at the end; a shorter text whole."""
    last = max(0, len(text) - size)
    return {text[start:start + size] for start in (*range(0, last, stride), last)}


def passages(benchmark: DataFrame) -> DataFrame:
    """``item_id, passage``: items in normal form, long ones cut into overlapping passages."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                text = normal(text)
                if len(text) < Q:
                    continue
                for part in sorted(cuts(text, PASSAGE, STRIDE) | cuts(text, LONG, LONG // 2)):
                    ids.append(item)
                    parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], ["item_id", "passage"])

    return benchmark.select("item_id", "text").mapInArrow(cut, "item_id long, passage binary")


@dataclass
class Index:
    """Q-grams of some passages: where each occurs, and what each passage must share."""

    q: int
    items: list
    texts: list[bytes]
    budget: np.ndarray
    needed: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    piece: np.ndarray
    offset: np.ndarray
    table: np.ndarray


def grams(text: bytes, q: int) -> np.ndarray:
    """The q-gram at each position as one integer."""
    codes = np.ndarray((max(0, len(text) - q + 1),), "<u8", text + bytes(8 - q), strides=(1,))
    return codes & np.uint64((1 << 8 * q) - 1)


def budget_of(length: int) -> int:
    """Edits allowed in a passage of so many bytes."""
    return int(EDIT_RATE * length)


def gram_of(length: int) -> int:
    """Bytes in the q-grams by which a passage of so many bytes is looked for."""
    return next(q for q in GRAMS if q == GRAMS[-1] or length - q + 1 - budget_of(length) * q > 0)


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def build_index(rows: list[tuple]) -> Index:
    items, texts = [r[0] for r in rows], [bytes(r[1]) for r in rows]
    length = np.array([len(t) for t in texts], np.int64)
    budget = np.array([budget_of(len(t)) for t in texts], np.int64)
    q = min(gram_of(len(t)) for t in texts)
    # An edit touches at most q q-grams; what is left of them must be shared.
    needed = length - q + 1 - budget * q
    codes = np.concatenate([grams(t, q) for t in texts])
    piece = np.repeat(np.arange(len(texts)), length - q + 1)
    offset = np.concatenate([np.arange(n - q + 1) for n in length])
    by = np.argsort(codes, kind="stable")
    distinct, first = np.unique(codes[by], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[_slot(distinct)] = True
    return Index(q, items, texts, budget, needed, distinct, np.append(first, len(by)), piece[by], offset[by], table)


def distance(passage: bytes, region: bytes, budget: int, before: int = 0) -> int | None:
    """Edits between the passage and some stretch of the region, if within the budget.

    The stretch begins at any of the region's diagonals; only those are computed. Where a
    document's start clips the region, ``before`` adds the diagonals ahead of it.
    """
    if passage in region:
        return 0
    width = before + len(region) - len(passage) + 1 + budget
    if width < 1:
        return None
    a = np.frombuffer(passage, np.uint8)
    # What lies outside the region matches no byte.
    b = np.full(len(a) + width, -1, np.int16)
    b[before:before + len(region)] = np.frombuffer(region, np.uint8)
    steps = np.arange(width)
    row = np.zeros(width, np.int64)
    for i, symbol in enumerate(a):
        other = row + (b[i:i + width] != symbol)
        other[:-1] = np.minimum(other[:-1], row[1:] + 1)
        row = np.minimum.accumulate(other - steps) + steps
        if row.min() > budget:
            return None
    return int(row.min())


def _windows(text: bytes, overlap: int) -> list[bytes]:
    """The text in parts of ``WINDOW`` bytes, any ``overlap`` bytes of it whole in one of them."""
    step = max(1, WINDOW - overlap)
    return [text[at:at + step + overlap] for at in range(0, max(1, len(text) - overlap), step)]


def search(index: Index, texts: list[bytes]) -> list[tuple[int, object, int]]:
    """``(text number, item, edits)`` of each item with a passage within its budget.

    A match is no longer than a passage and its budget, so windows that overlap by as much
    find all that the whole text holds; memory is that of one window.
    """
    overlap = max(map(len, index.texts)) + int(index.budget.max())
    found: dict[tuple[int, object], int] = {}
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        for at, piece, edits in _search(index, [part for _, part in held]):
            name = (held[at][0], index.items[piece])
            found[name] = min(edits, found.get(name, edits))
        held.clear()

    for number, text in enumerate(texts):
        for part in _windows(normal(text), overlap):
            if held and size + len(part) > WINDOW:
                flush()
                size = 0
            held.append((number, part))
            size += len(part)
    flush()
    return [(doc, item, edits) for (doc, item), edits in found.items()]


def _places(index: Index, codes: np.ndarray) -> np.ndarray:
    """Places whose q-gram the index may know, where a window around holds enough of such."""
    known = index.table[_slot(codes)]
    # All q-grams of a match lie in one window; elsewhere nothing is looked up. The windows of
    # longer passages are covered by several short ones, one of which holds its part.
    reach = np.array([len(t) for t in index.texts]) + index.budget
    window, wide = int(reach.min()), int(reach.max())
    least = int((-(-index.needed // -(-reach // window))).min())
    seen = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(known, out=seen[1:])
    gained = np.full(len(codes), seen[-1], np.int32)
    gained[:max(0, len(codes) - window)] = seen[window:-1]
    gained -= seen[:-1]
    dense = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(gained >= least, out=dense[1:])
    if not dense[-1]:
        return np.zeros(0, np.int64)
    places = np.flatnonzero(known)
    near = dense[np.minimum(places + wide, len(codes))] > dense[np.maximum(places - wide, 0)]
    return places[near]


def _search(index: Index, norms: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """``(text number, piece, edits)`` for texts in normal form, one after the other."""
    gap = bytes(Q)
    starts = np.cumsum([0, *(len(t) + Q for t in norms)])
    joined = gap.join(norms) + gap
    codes = grams(joined, index.q)
    places = _places(index, codes)
    at = np.minimum(np.searchsorted(index.codes, codes[places]), len(index.codes) - 1)
    same = index.codes[at] == codes[places]
    places, at = places[same], at[same]
    count = index.first[at + 1] - index.first[at]
    # Bands cover twice this many diagonals and overlap by half; more than the largest budget.
    half, longest = int(index.budget.max()) + 1, max(map(len, index.texts))
    n, n_bands = len(index.texts), (len(joined) + longest) // half + 2
    open_keys, open_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(count)
    first = 0
    while first < len(places):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + ENTRIES, side="right")))
        some, held = slice(first, last), count[first:last]
        entry = np.arange(held.sum()) - np.repeat(ends[some] - held - before, held) + np.repeat(index.first[at[some]], held)
        place = np.repeat(places[some], held)
        band = (place - index.offset[entry] + longest) // half + 1
        doc = np.searchsorted(starts, place, side="right") - 1
        # Bands of a document, each counted with its upper half and as the lower half of the one before.
        key = (doc * n_bands + band) * n + index.piece[entry]
        keys, which = np.unique(np.concatenate([key, key - n, open_keys]), return_inverse=True)
        shared = np.bincount(which, weights=np.concatenate([np.ones(2 * len(key)), open_counts]), minlength=len(keys)).astype(np.int64)
        first = last
        # A band that ends before the next place gets no more entries.
        ended = np.ones(len(keys), bool)
        if first < len(places):
            ended = (keys // n % n_bands + 1) * half <= places[first]
        for key in keys[ended & (shared >= index.needed[keys % n])].tolist():
            rest, piece = divmod(key, n)
            doc, band = divmod(rest, n_bands)
            budget, passage = int(index.budget[piece]), index.texts[piece]
            low = (band - 1) * half - longest - budget
            high = low + 2 * half + len(passage) + 2 * budget
            start, end = int(starts[doc]), int(starts[doc + 1]) - Q
            edits = distance(passage, joined[max(low, start):min(high, end)], budget, min(budget, max(0, start - low)))
            if edits is not None:
                yield doc, piece, edits
        open_keys, open_counts = keys[~ended], shared[~ended]


def _finder(index: Index) -> Callable:
    def rows(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
        hits = search(index, texts)
        return {
            "doc_id": ids.take(pa.array([doc for doc, _, _ in hits], pa.int64())),
            "passage": [passage for _, passage, _ in hits],
            "distance": [edits for _, _, edits in hits],
        }

    return rows


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, distance`` of every document that holds an item's passage.

    A document holds a passage if some stretch of its normal form is within ``EDIT_RATE``
    edits per byte of it. Such a stretch shares ``length - q + 1 - edits * q`` q-grams with
    the passage, on diagonals no further apart than the edits; documents are searched for
    bands with so many, and each of them is proved by alignment. Only the index of one
    block of passages, bounded by ``BLOCK_BYTES``, is broadcast at a time.

    Null or empty texts and items match nothing, nor do items of under ``Q`` bytes; equal
    items are reported each under its id; repeated rows of documents count once.
    """
    spark = docs.sparkSession
    parts = materialise(passages(benchmark).distinct(), scratch_path(spark, "benchmark-passages"))
    # Equal passages are indexed once, however many items hold them.
    texts = materialise(parts.select("passage").distinct(), scratch_path(spark, "benchmark-texts"))
    size = texts.agg(F.sum(F.length("passage"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("passage"), F.lit(max(1, n_blocks)))
    found = spark.createDataFrame([], HITS)
    for number in range(n_blocks):
        rows = [(row[0], row[0]) for row in texts.where(block == number).orderBy("passage").collect()]
        # Long and short passages apart: each kind's filter is sharper without the other.
        kinds = [(gram_of(len(row[1])), len(row[1]) > PASSAGE) for row in rows]
        for kind in sorted(set(kinds)):
            index = build_index([row for row, its in zip(rows, kinds, strict=True) if its == kind])
            index = spark.sparkContext.broadcast(index)
            found = found.unionByName(map_texts(docs, None, HITS, lambda index=index: _finder(index.value), WINDOW))
    hits = found.groupBy("doc_id", "passage").agg(F.min("distance").alias("distance"))
    return hits.join(parts, "passage").groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: the items it leaks and whether it is ``contaminated``.

    ``items`` lists the item ids, ascending and comma-joined (empty if clean). Rows that
    share a ``doc_id`` share their hits; a null ``doc_id`` is an id like any other. An
    empty benchmark leaves every document clean.
    """
    hits = materialise(leaks(docs, benchmark), scratch_path(docs.sparkSession, "leaks"))
    per_doc = hits.groupBy(F.col("doc_id").alias("_id")).agg(
        F.array_join(F.array_sort(F.collect_set("item_id")).cast("array<string>"), ",").alias("items"),
        F.countDistinct("item_id").alias("n_items"),
        F.min("distance").alias("distance"),
    )
    joined = docs.select("doc_id").join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select(
        "doc_id",
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        "distance",
        F.col("n_items").isNotNull().alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark, with all their columns."""
    hits = materialise(leaks(docs, benchmark), scratch_path(docs.sparkSession, "leaks"))
    named = hits.select(F.col("doc_id").alias("_leaking")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("_doc"))
    return packed.join(named, F.col("_doc.doc_id").eqNullSafe(F.col("_leaking")), "left_anti").select("_doc.*")
