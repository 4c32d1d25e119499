"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirepulse.session import materialise, scratch_path

WORD = r"[^\x20\x09-\x0D]+"

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this on average.
MAX_REPEATS = 3
#: Rows of one source and size are numbered in pieces of about this many.
PIECE_ROWS = 512
SEED = "mix"

_KEY = ["_none", "_source"]


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: words per document; the only read of the texts."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return docs.select("doc_id", "source", words.cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: its size and its target in words.

    Targets are ``min(max_repeats * size, weight * level)``; the level is the one at which
    they add up to all words. Sorted by the level that fills a source, the sources before
    the first one that stays below its bound are full. Works on one row per source.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = Window.orderBy("_none", "_source")
    filled = Window.orderBy("_fills", "_none", "_source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = (F.row_number().over(ranked) - 1) % len(weights) + 1
    per_source = (
        sized.groupBy(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"))
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("double"))
        .withColumn("_bound", max_repeats * F.col("source_size").cast("double"))
        .withColumn("_fills", F.col("_bound") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_full", F.coalesce(F.sum("_bound").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.sum("_weight").over(onward))
        .withColumn("_place", F.row_number().over(filled))
    )
    fits = F.col("_level") * F.col("_weight") <= F.col("_bound")
    level = F.min(F.when(fits, F.struct("_place", "_level"))).over(everything)["_level"]
    target = F.least("_bound", F.col("_weight") * level)
    return per_source.withColumn("target", target).select(*_KEY, "source_size", "target")


def offset(source: Column, none: Column, seed: str = SEED) -> Column:
    """The random offset of a source in [0, 1), fixed by the seed."""
    digest = F.md5(F.concat(F.lit(seed), F.when(none, F.lit("")).otherwise(F.concat(F.lit(":"), source))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """``sizes()`` with ``source_size, target, copies``.

    Documents of a source stand in order of size, then of a hash of their id. Each expects
    ``target / source_size`` copies; their prefix sum starts at the source's random offset
    and a copy is taken at each whole number crossed. As sizes rise along the order, the
    words taken differ from the target by no more than about the longest document.

    The prefix sum is the rate times a document's number within its source. Numbers are
    made in three steps, so that no task holds a source: documents per source and size,
    then per piece of a source and size, then within a piece. A piece is a range of the
    hash, and cutting finer never changes a number.
    """
    lettered = sized.select(
        "doc_id", "source", "size",
        F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_hash"),
    )
    by_size = Window.partitionBy(*_KEY).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    halving = F.ceil(F.log2(F.col("_n") / PIECE_ROWS) / 4)
    groups = (
        lettered.groupBy(*_KEY, "size").agg(F.count("*").alias("_n"))
        .withColumn("_smaller", F.coalesce(F.sum("_n").over(by_size), F.lit(0)))
        .withColumn("_digits", F.greatest(F.lit(0), halving).cast("int"))
        .drop("_n")
    )
    pieced = (
        lettered.join(groups, [*_KEY, "size"])
        .withColumn("_piece", F.expr("substring(_hash, 1, _digits)"))
        .repartition(*_KEY, "size", "_piece")
    )
    earlier = Window.partitionBy(*_KEY, "size").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        pieced.groupBy(*_KEY, "size", "_piece").agg(F.count("*").alias("_n"))
        .withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(*_KEY, "size", "_piece").orderBy("_hash", "doc_id")
    number = F.col("_smaller") + F.col("_earlier") + F.col("_within")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = offset(F.col("_source"), F.col("_none"), seed)
    crossed = F.floor(number * F.col("_rate") + F.col("_start")) - F.floor((number - 1) * F.col("_rate") + F.col("_start"))
    return (
        pieced.withColumn("_within", F.row_number().over(within))
        .join(pieces, [*_KEY, "size", "_piece"])
        .join(targets(sized, weights, max_repeats), _KEY)
        .withColumn("_rate", rate)
        .withColumn("_start", start)
        .select("doc_id", "source", "size", "source_size", "target", crossed.alias("copies"))
    )


def mix_plan(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document.

    Null or empty texts have size 0 and take nothing; a null source is a source of its own,
    the last one; repeated rows are numbered one after the other; an empty table gives an
    empty result; other columns are not read. Reruns agree, as the offset is a hash.
    """
    sized = materialise(sizes(docs), scratch_path(docs.sparkSession, "mix-sizes"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return copies(sized, **settings).select("doc_id", "size", "source_size", "target", taken)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Of rows that share id, source and size, the first in order of text gets the first
    number of copies. Documents without words are not taken.
    """
    sized = materialise(sizes(docs), scratch_path(docs.sparkSession, "mix-sizes"))
    same = ["_id", "_no_id", *_KEY, "_size"]

    def keyed(df: DataFrame, size: Column, *more: Column) -> DataFrame:
        return df.select(
            *more, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id").isNull().alias("_no_id"),
            F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), size.alias("_size"),
        )

    chosen = keyed(copies(sized, **settings), F.col("size"), F.col("copies"))
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("copies"))
    chosen = chosen.withColumn("_nth", nth).where("copies > 0 AND _size > 0")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("_doc.text"))
    rows = keyed(docs, size, F.struct(*docs.columns).alias("_doc")).withColumn("_nth", nth).join(chosen, [*same, "_nth"])
    return rows.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("_doc.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3 * source_size::DOUBLE AS bound,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sources
), levels AS (
  SELECT *, row_number() OVER fills AS place,
    ((SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(bound) OVER (fills ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (fills ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW fills AS (ORDER BY bound / weight, source NULLS LAST)
), targets AS (
  SELECT source, source_size,
    least(bound, weight * (SELECT arg_min(level, place) FROM levels WHERE level * weight <= bound)) AS target,
    ('0x' || substr(md5('mix' || coalesce(':' || source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS start
  FROM weighed
), numbered AS (
  SELECT doc_id, source, size,
    row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) AS number
  FROM sized
), rated AS (
  SELECT doc_id, size, source_size, target, number, start,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM numbered JOIN targets ON numbered.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(number * rate + start) - floor((number - 1) * rate + start)))::BIGINT AS taken
FROM rated
"""
