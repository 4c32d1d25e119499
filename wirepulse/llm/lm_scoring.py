"""Language-model scores: prediction by partial matching over bytes, with a unigram base.

The trie of byte contexts up to order 3 is a table of 4-grams with their counts in the
training documents; shorter contexts are its marginals. An escape at a context has the
weight of the number of symbols seen there, and symbols seen at a context are excluded
below it. Since the sets of seen symbols are nested, the code length of a 4-gram follows
from its counts and a few sums per context, so the whole trie is coded by joins.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirepulse.llm.text import arrow_schema, slices, utf8
from wirepulse.session import materialise, scratch_path

#: Documents with this remainder of crc32(id) mod 7 are held out.
HELD_OUT, PARTS = 2, 7
#: Bytes of text in a chunk, about: the documents that share one look-up in the counts.
CHUNK_BYTES = 10 << 20
#: Bytes of text, about, whose words and 4-grams a task holds at once: some 50 times as many bytes.
PIECE_BYTES = 1 << 20
#: Distinct 4-grams of pieces that a task lets gather, at least, before it adds them up.
PENDING = 1 << 18
#: Stands for the end of a text among the words, which hold no white space.
END = b"\n"
#: Fills the contexts before a text, and ends it, among the bytes.
EDGE = b"\0"
ORDER = 3

NEEDS = "chunk long, word binary, gram long, n long"
SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, known_score double, score double, train_tokens long, "
    "new_words long"
)


def remainder(doc_id: object) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % PARTS


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case, then one end."""
    return [*text.lower().split(), END]


def _pieces(ids: pa.ChunkedArray | pa.Array, column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, of which only one piece at a time is copied out of Arrow."""
    for a, b in slices(column, PIECE_BYTES):
        yield ids.slice(a, b - a).to_pylist(), utf8(column.slice(a, b - a))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each byte and at the end of each text, and where texts start."""
    joined = b"".join(EDGE * ORDER + text + EDGE for text in texts)
    length = np.array([len(text) + ORDER + 1 for text in texts], np.int64)
    ends = np.cumsum(length)
    wanted = np.ones(len(joined), bool)
    for k in range(1, ORDER + 1):
        wanted[ends - k] = False
    codes = np.ndarray((len(joined) - ORDER,), ">u4", joined, strides=(1,))
    starts = np.cumsum(length - ORDER) - (length - ORDER)
    return codes[wanted[:len(codes)]].astype(np.uint32), starts


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct 4-grams of all lists with the sums of their counts."""
    at, found = pd.factorize(np.concatenate(codes))
    return [found], [np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)]


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4-grams of a task's documents, with their counts in those for training."""
    codes, counts, pending = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0
    for batch in batches:
        for ids, texts in _pieces(batch.column(0), batch.column(1)):
            both: tuple[list, list] = ([], [])
            for doc_id, text in zip(ids, texts, strict=True):
                both[remainder(doc_id) != HELD_OUT].append(text)
            for trained, part in enumerate(both):
                if part:
                    at, found = pd.factorize(grams(part)[0])
                    codes.append(found)
                    counts.append(trained * np.bincount(at, minlength=len(found)))
                    pending += len(found)
            if pending > max(PENDING, len(codes[0])):
                codes, counts = _added(codes, counts)
                pending = 0
    codes, counts = _added(codes, counts)
    yield pa.RecordBatch.from_arrays([pa.array(codes[0].astype(np.int64)), pa.array(counts[0])], ["gram", "n"])


def gram_counts(docs: DataFrame) -> DataFrame:
    """``gram, c``: 4-grams of all documents with their counts in the training documents.

    Tasks add up before the shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("c"))


def _log_share(part: Column, total: Column, distinct: Column) -> Column:
    return F.log10(part / (total + distinct))


def _escape(total: Column, distinct: Column) -> Column:
    """Log probability to leave a context; one that has nothing left is left for sure."""
    return F.when((total > 0) & (distinct > 0), _log_share(distinct, total, distinct)).otherwise(
        F.when(total > 0, F.lit(float("-inf"))).otherwise(0.0)
    )


def code_lengths(counts: DataFrame) -> DataFrame:
    """``gram, value``: log10 probability of the last byte of each distinct 4-gram.

    The tables of orders 2, 1 and 0 have at most 2^24, 2^16 and 2^8 rows.
    """
    three = counts.where("c > 0")
    two = three.groupBy((F.col("gram") % (1 << 24)).alias("g2")).agg(F.sum("c").alias("n2"))
    one = two.groupBy((F.col("g2") % (1 << 16)).alias("g1")).agg(F.sum("n2").alias("n1"))
    none = one.groupBy((F.col("g1") % (1 << 8)).alias("g0")).agg(F.sum("n1").alias("n0"))

    def key(name: str, bits: int) -> Column:
        return (F.col(name) % (1 << bits)).alias(f"g{bits // 8 - 1}")

    # Per context: total, distinct symbols, and how much those hold one order below.
    at3 = three.withColumn("g2", key("gram", 24)).join(two, "g2").groupBy(F.shiftright("gram", 8).alias("x3")).agg(
        F.sum("c").alias("t3"), F.count("*").alias("d3"), F.sum("n2").alias("s2")
    )
    at2 = two.withColumn("g1", key("g2", 16)).join(one, "g1").groupBy(F.shiftright("g2", 8).alias("x2")).agg(
        F.sum("n2").alias("t2"), F.count("*").alias("d2"), F.sum("n1").alias("s1")
    )
    at1 = one.withColumn("g0", key("g1", 8)).join(none, "g0").groupBy(F.shiftright("g1", 8).alias("x1")).agg(
        F.sum("n1").alias("t1"), F.count("*").alias("d1"), F.sum("n0").alias("s0")
    )
    at0 = none.agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("t0"), F.count("*").alias("d0"))
    known = (
        counts.select("*", key("gram", 24), key("gram", 16), key("gram", 8), F.shiftright("gram", 8).alias("x3"))
        .select("*", F.shiftright("g2", 8).alias("x2"), F.shiftright("g1", 8).alias("x1"))
    )
    for table, by in ((two, "g2"), (one, "g1"), (none, "g0"), (at3, "x3"), (at2, "x2"), (at1, "x1")):
        known = known.join(table, by, "left")
    known = known.crossJoin(F.broadcast(at0)).fillna(0)
    c = F.col
    left2, rare2 = c("t2") - c("s2"), c("d2") - c("d3")
    left1, rare1 = c("t1") - c("s1"), c("d1") - c("d2")
    left0, rare0 = c("t0") - c("s0"), c("d0") - c("d1")
    escape3, escape2 = _escape(c("t3"), c("d3")), _escape(left2, rare2)
    escape1, escape0 = _escape(left1, rare1), _escape(left0, rare0)
    value = (
        F.when(c("c") > 0, _log_share(c("c"), c("t3"), c("d3")))
        .when(c("n2") > 0, escape3 + _log_share(c("n2"), left2, rare2))
        .when(c("n1") > 0, escape3 + escape2 + _log_share(c("n1"), left1, rare1))
        .when(c("n0") > 0, escape3 + escape2 + escape1 + _log_share(c("n0"), left0, rare0))
        .otherwise(escape3 + escape2 + escape1 + escape0 - F.log10(256 - c("d0")))
    )
    return known.select("gram", value.alias("value"))


def _table(columns: list, ddl: str) -> pa.Table:
    schema = arrow_schema(ddl)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _chunk_words(table: pa.Table) -> pa.Table:
    """Distinct words of a chunk, with their counts in its training documents."""
    chunk, counts, rest = table["chunk"][0].as_py(), Counter(), set()
    for ids, texts in _pieces(table["doc_id"], table["text"]):
        for doc_id, text in zip(ids, texts, strict=True):
            (rest if remainder(doc_id) == HELD_OUT else counts).update(tokens(text))
    rest.difference_update(counts)
    n = len(counts) + len(rest)
    return _table(
        [np.full(n, chunk), [*counts, *rest], np.full(n, None), np.array([*counts.values(), *(0 for _ in rest)], np.int64)], NEEDS
    )


def _chunk_grams(table: pa.Table) -> pa.Table:
    """Distinct 4-grams of a chunk."""
    found = pd.unique(np.concatenate([pd.unique(grams(texts)[0]) for _, texts in _pieces(table["doc_id"], table["text"])]))
    n = len(found)
    return _table(
        [np.full(n, table["chunk"][0].as_py()), np.full(n, None), found.astype(np.int64), np.zeros(n, np.int64)], NEEDS
    )


def _score_chunk(docs: pa.Table, known: pa.Table) -> pa.Table:
    """One row per document, and a last one with the chunk's share of the totals."""
    if not docs.num_rows:
        return _table([[] for _ in SCORED.split(", ")], SCORED)
    is_word = known["word"].is_valid()
    words = known.filter(is_word)
    count = dict(zip(words["word"].to_pylist(), words["c"].to_pylist(), strict=True))
    coded = known.filter(pa.compute.invert(is_word))
    gram, value = coded["gram"].to_numpy(), coded["value"].to_numpy()
    by = np.argsort(gram)
    gram, value = gram[by], value[by]
    ids = docs["doc_id"].to_pylist()
    held = [remainder(doc_id) == HELD_OUT for doc_id in ids]
    n_tokens, n_known, known_score, score = [], [], [], []
    for _, texts in _pieces(docs["doc_id"], docs["text"]):
        listed = [tokens(text) for text in texts]
        length = np.array([len(one) for one in listed])
        c = np.fromiter((count[word] for one in listed for word in one), np.int64, int(length.sum()))
        starts = np.cumsum(length) - length
        n_tokens.append(length)
        n_known.append(np.add.reduceat((c > 0).astype(np.int64), starts))
        known_score.append(np.add.reduceat(np.log10(c + 1.0), starts))
        codes, starts = grams(texts)
        at, found = pd.factorize(codes)
        score.append(np.add.reduceat(value[np.searchsorted(gram, found.astype(np.int64))][at], starts))
    n = len(ids)
    trained = int(sum(k for k, out in zip(np.concatenate(n_tokens).tolist(), held, strict=True) if not out))
    new = pa.compute.sum(pa.compute.cast(words["fresh"], pa.int64())).as_py()
    rows = [
        [*ids, None], [*held, None], np.concatenate(n_tokens), np.concatenate(n_known), np.concatenate(known_score),
        np.concatenate(score), [None] * n + [trained], [None] * n + [new or 0],
    ]
    return _table([[*one, *[None] * (n + 1 - len(one))] for one in rows], SCORED)


def lm_scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document.

    Documents are dealt into chunks of bounded size. A chunk asks for the counts of its
    distinct words and the code lengths of its distinct 4-grams, gets just these back, and
    scores its documents; a frequent word is one row per chunk, so no key is hot. The model
    is never in one place: what is gathered grows with the corpus, what a task holds does
    not.

    A null or empty text has the end alone; repeated rows count each time; a null ``doc_id``
    is trained on; an empty table gives an empty result, and without training documents all
    bytes are equally likely. Columns other than ``doc_id`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = materialise(gram_counts(docs), scratch_path(spark, "lm-grams"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = -(-size // chunk_bytes) or 1
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).alias("chunk")
    # No fewer partitions than Spark would make, or it would deal the texts out once more.
    n_parts = max(n_chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(chunk, "doc_id", "text").repartition(n_parts, "chunk").groupBy("chunk")

    per_word = Window.partitionBy("word")
    words = dealt.applyInArrow(_chunk_words, NEEDS).select(
        "chunk", "word", F.lit(None).cast("long").alias("gram"), F.sum("n").over(per_word).alias("c"),
        F.lit(0.0).alias("value"), (F.min("chunk").over(per_word) == F.col("chunk")).alias("first"),
    )
    words = words.select("chunk", "word", "gram", "c", "value", (F.col("first") & (F.col("c") > 0)).alias("fresh"))
    coded = materialise(code_lengths(counts), scratch_path(spark, "lm-codes"))
    needed = dealt.applyInArrow(_chunk_grams, NEEDS).select("chunk", "gram")
    codes = needed.join(coded, "gram").select(
        "chunk", F.lit(None).cast("binary").alias("word"), "gram", F.lit(0).cast("long").alias("c"), "value", F.lit(False).alias("fresh")
    )
    known = words.unionByName(codes)
    # Dealt like the texts, so that these stay where they are.
    known = known.repartition(n_parts, "chunk").groupBy("chunk")
    scored = dealt.cogroup(known).applyInArrow(_score_chunk, SCORED)
    scored = materialise(scored, scratch_path(spark, "lm-scored"))
    total = scored.agg(F.sum("train_tokens"), F.sum("new_words")).first()
    n, v = total[0] or 0, total[1] or 0
    base = F.col("known_score") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return scored.where(F.col("n_tokens").isNotNull()).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
