"""Near-duplicate classes: BagMinHash signatures, banding, exact multiset overlap."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.components import components
from wirepulse.llm.open_groups import open_links
from wirepulse.llm.text import map_texts, utf8
from wirepulse.session import materialise, scratch_path

SHINGLE = 5
#: Documents are near-duplicates from this weighted Jaccard similarity on: 4 / 5.
SIMILAR = (4, 5)

#: Signature slots, in bands of four. A pair at 0.8 shares no band once in 300 000.
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: Slots whose last four bits must agree before texts are compared: expected 78 at 0.8,
#: and fewer than 57 about twice in ten millions.
AGREEING = 57

#: Members of each bucket that all its other members are tested against first.
LEADERS = 2
#: Larger buckets are compared in tiles in the end.
SMALL_BUCKET = 8

SIGNATURES = "doc_id long, key binary, bands array<long>, planes array<long>"
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs agree in every process."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: hash, count and number of the text.

    A text of fewer than ``SHINGLE`` words is one shingle; one without words has none.
    """
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    ids, lengths = [], []
    for text in texts:
        words = text.split()
        ids += [number[w] for w in words]
        if words:
            ids += [0] * max(0, SHINGLE - len(words))
        lengths.append(max(SHINGLE, len(words)) if words else 0)
    hashes = np.array([0, *map(xxhash.xxh3_64_intdigest, number)], np.uint64)[np.array(ids, np.int64)]
    rolled = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(rolled)]
    rolled = mix(rolled)
    found, weights, owners, start = [], [], [], 0
    for doc, length in enumerate(lengths):
        if length:
            distinct, counts = np.unique(rolled[start:start + length - SHINGLE + 1], return_counts=True)
            found.append(distinct)
            weights.append(counts)
            owners.append(np.full(len(distinct), doc))
        start += length
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(weights), np.concatenate(owners)


def bag_minhash(hashes: np.ndarray, weights: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Signatures ``[n, SLOTS]`` of ``n`` weighted sets; zero rows for empty sets.

    Each shingle has a Poisson process over its weight axis, cut into (0, 1], (1, 2],
    (2, 4], ...; an interval emits points at its own rate, in order of time, each with a
    slot and a unit of weight, and those above the shingle's weight are thinned out. A
    slot keeps its earliest point, so two sets agree in a slot with the probability of
    their weighted Jaccard similarity. Points after a bound on time are not made; sets
    that leave a slot empty are done again with twice the bound.
    """
    values = np.zeros((n, SLOTS), np.uint64)
    level = np.zeros(len(hashes), np.int64)
    parts = [np.arange(len(hashes))]
    levels = [level]
    k = 1
    while len(more := np.flatnonzero(weights > (1 << (k - 1)))):
        parts.append(more)
        levels.append(np.full(len(more), k))
        k += 1
    element, level = np.concatenate(parts), np.concatenate(levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    span = np.where(level > 0, low, 1)
    seed = mix(hashes[element] ^ mix(level.astype(np.uint64) + np.uint64(1)))
    total = np.bincount(owners, weights=weights, minlength=n)
    bound = np.where(total > 0, (np.log(SLOTS) + 3) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        at = np.flatnonzero(todo[owners[element]])
        best = np.full(n * SLOTS, np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        time, step = np.zeros(len(at)), 0
        while len(at):
            step += 2
            a = mix(seed[at] + np.uint64(step * 0x9E3779B97F4A7C15 & int(_MASK)))
            b = mix(seed[at] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & int(_MASK)))
            uniform = ((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(uniform) / (SLOTS * span[at])
            alive = time <= bound[owners[element[at]]]
            at, time, b = at[alive], time[alive], b[alive]
            slot = ((b >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)).astype(np.int64)
            unit = low[at] + ((b & np.uint64(0xFFFFFFFF)) * span[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            counts = unit < weights[element[at]]
            place = owners[element[at]][counts] * SLOTS + slot[counts]
            np.minimum.at(best, place, time[counts])
            kept.append((place, time[counts], mix(b[counts] ^ seed[at][counts])))
        flat = values.reshape(-1)
        for place, when, value in kept:
            first = best[place] == when
            flat[place[first]] = value[first]
        todo &= np.isinf(best.reshape(n, SLOTS)).any(axis=1)
        bound = np.where(todo, bound * 2, bound)
    return values


def _bands(values: np.ndarray) -> np.ndarray:
    banded = np.zeros((len(values), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        banded = mix(banded * np.uint64(0x9E3779B97F4A7C15) + values[:, k::ROWS])
    return banded.view(np.int64)


def _planes(values: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 of each slot, as four planes of two 48-bit halves."""
    weight = (np.uint64(1) << np.arange(48, dtype=np.uint64))
    out = np.zeros((len(values), 8), np.uint64)
    for bit in range(4):
        ones = (values >> np.uint64(bit)) & np.uint64(1)
        out[:, 2 * bit] = ones[:, :48] @ weight
        out[:, 2 * bit + 1] = ones[:, 48:] @ weight
    return out.view(np.int64)


def _sign(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
    hashes, weights, owners = shingles(texts)
    values = bag_minhash(hashes, weights, owners, len(texts))
    signed = np.bincount(owners, minlength=len(texts)) > 0
    bands, planes = _bands(values), _planes(values)

    def lists(matrix: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(signed * matrix.shape[1])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix[signed].ravel()))

    return {
        "doc_id": ids, "key": [hashlib.md5(text).digest() for text in texts],
        "bands": lists(bands), "planes": lists(planes),
    }


def agreeing(a: str, b: str) -> Column:
    """Slots whose last four bits agree, from two plane columns."""
    differ = [
        F.bit_count(
            F.expr(" | ".join(f"({a}[{2 * bit + half}] ^ {b}[{2 * bit + half}])" for bit in range(4)))
        )
        for half in (0, 1)
    ]
    return SLOTS - differ[0] - differ[1]


def overlap(words_a: Counter, words_b: Counter) -> tuple[int, int]:
    """Weighted Jaccard similarity of two shingle multisets as a fraction."""
    if len(words_b) < len(words_a):
        words_a, words_b = words_b, words_a
    shared = sum(min(n, words_b[s]) for s, n in words_a.items() if s in words_b)
    return shared, words_a.total() + words_b.total() - shared


def bag(text: bytes) -> Counter:
    words = text.split()
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs that are similar enough; neighbouring rows often share a leader."""
    last, bag_a = None, Counter()
    for batch in batches:
        a = batch.column(0).to_pylist()
        texts_a, texts_b = batch.column(2), utf8(batch.column(3))
        keep = []
        for row, key in enumerate(a):
            if key != last:
                last, bag_a = key, bag((texts_a[row].as_py() or "").encode())
            shared, union = overlap(bag_a, bag(texts_b[row]))
            keep.append(union > 0 and SIMILAR[1] * shared >= SIMILAR[0] * union)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar enough."""
    planes = nodes.select("key", "planes")
    close = (
        pairs.join(planes.select(F.col("key").alias("a"), F.col("planes").alias("planes_a")), "a")
        .join(planes.select(F.col("key").alias("b"), F.col("planes").alias("planes_b")), "b")
        .where(agreeing("planes_a", "planes_b") >= AGREEING)
        .select("a", "b")
    )
    with_texts = (
        close.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return with_texts.mapInArrow(_verify, "a binary, b binary")


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("key", "first").alias("a"), F.greatest("key", "first").alias("b"))


def _similar(one: bytes, other: bytes) -> bool:
    shared, union = overlap(bag(one), bag(other))
    return union > 0 and SIMILAR[1] * shared >= SIMILAR[0] * union


def near_roots(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """``key, root`` for the texts that have a near-duplicate with another text.

    Texts sharing a band value form a bucket. First each bucket tests its members against a
    few of them, so a group of copies costs a few tests per member. Buckets that still hold
    several components then test all pairs that are not in one component: small buckets each
    pair, larger ones inside tasks that get two tiles of their texts. Links are lost only by
    banding and the sketch filter, some 4 in a million pairs at exactly 0.8; what else is
    skipped is not similar, or could only join what is joined.
    """
    spark = docs.sparkSession

    def keep(df: DataFrame, label: str) -> DataFrame:
        return materialise(df, scratch_path(spark, label))

    nodes = keep(
        signed.where("size(bands) > 0").groupBy("key").agg(F.first("bands").alias("bands"), F.first("planes").alias("planes")),
        "near-nodes",
    )
    members = nodes.select("key", F.explode("bands").alias("value"))
    several = members.groupBy("value").agg(F.count("*").alias("_n")).where("_n > 1").select("value")
    shared = keep(members.join(several, "value"), "near-buckets")
    texts = keep(
        docs.select(_text_key().alias("key"), "text")
        .join(shared.select("key").distinct(), "key", "left_semi")
        .groupBy("key").agg(F.first("text").alias("text")),
        "near-texts",
    )
    lowest = [F.min_by("key", F.xxhash64("key", F.lit(seed))) for seed in range(LEADERS)]
    leaders = shared.groupBy("value").agg(F.array_distinct(F.array(*lowest)).alias("first"))
    pairs = shared.join(leaders, "value").select("key", F.explode("first").alias("first")).where("key <> first")
    tested = keep(_ordered(pairs).distinct(), "near-pairs")
    links = keep(_links(tested, nodes, texts), "near-links")
    roots = keep(components(links), "near-roots")

    placed = (
        shared.join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select("value", "key", F.coalesce("root", "key").alias("root"))
    )
    mixed = placed.groupBy("value").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    opened = keep(placed.join(mixed.where("low < high").select("value", "n"), "value"), "near-open")
    small = opened.where(F.col("n") <= SMALL_BUCKET)
    other = small.select("value", F.col("key").alias("first"), F.col("root").alias("first_root"))
    pairs = _ordered(small.join(other, "value").where("root <> first_root AND key < first"))
    pairs = keep(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
    large = opened.where(F.col("n") > SMALL_BUCKET).select("value", "key", "root")
    found = open_links(large, nodes, texts, shingles, _similar, SIMILAR, SLOTS, AGREEING)
    more = keep(_links(pairs, nodes, texts).unionByName(found), "near-links")
    if not more.isEmpty():
        joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
        roots = keep(components(joined), "near-roots")
    return roots.select(F.col("node").alias("key"), "root")


def _signed_and_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    signed = materialise(map_texts(docs, _sign, SIGNATURES), scratch_path(spark, "near-signatures"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    per_text = signed.groupBy("key").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    rooted = per_text.join(near_roots(docs, signed), "key", "left").withColumn("root", F.coalesce("root", "key"))
    return signed, materialise(rooted, scratch_path(spark, "near-rooted"))


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size`` for every document.

    Documents with equal texts, or linked by a chain of texts each at least 0.8 similar
    on five-word shingles with their counts, share a class; its id is its smallest
    ``doc_id``. Null and empty texts are equal; a text of blanks is only like its exact
    copies; repeated rows are copies; a null id comes last; an empty table gives an empty
    result; columns other than ``doc_id`` and ``text`` are not read.
    """
    signed, rooted = _signed_and_roots(docs)
    classes = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    by_text = rooted.select("key", "root").join(classes, "root").select("key", F.col("first.doc_id").alias("class_id"), "class_size")
    return signed.select("doc_id", "key").join(by_text, "key").select("doc_id", "class_id", "class_size")


def first_of_class(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns."""
    _, rooted = _signed_and_roots(docs)
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    chosen = first.select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_chosen"))
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_own"), _text_key().alias("_key"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_chosen"))
    return keyed.join(chosen, same, "left_semi").dropDuplicates(["_own", "_key"]).select("_doc.*")
