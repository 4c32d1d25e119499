"""How document filters act together: what each order of them keeps, removes and repeats.

Each document fails some of five filters; that set is a mask, and every figure of every
order is a sum over masks, so one count per mask and part of the corpus is enough. Four
filters look at one text. The fifth, for copies, needs whole texts compared across the
table: a counting Bloom filter over all texts first clears those that surely occur once,
and only the others are shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.session import materialise, scratch_path

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")

BLANK = r"[\x20\x09-\x0D]+"

#: Cells of a page of the sketch, and words of 64 cells in it.
PAGE_CELLS = 4096
PAGE_WORDS = PAGE_CELLS // 64
#: Cells that a text counts in, all of one page; and cells of the sketch per text.
PROBES, CELLS_PER_TEXT = 3, 16
#: Pages of the sketch at most. Its broadcast form has a bit per cell: 32 MB. A larger table fills
#: the cells up, so that fewer texts are cleared and more are compared; the result stays the same.
MAX_PAGES = 1 << 16


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, BLANK), "")
    hundred = F.lit(100).cast("long")
    few = F.size(words) < 50
    alike = hundred * F.size(F.array_distinct(words)) < 65 * F.size(words).cast("long")
    loud = hundred * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text).cast("long")
    marked = F.regexp_count(text, F.lit("[#$%&*|]")) > 0
    return sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate((few, alike, loud, marked))), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256: stands for the text where ids are joined back."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _page(key: Column, pages: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(pages))


def _cell(key: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(PAGE_CELLS)).cast("int")


def single_cells(keys: DataFrame, pages: int) -> DataFrame:
    """``page, bits``: the counting Bloom filter of all rows' ``key``, as the cells counted once.

    Each row counts in ``PROBES`` cells of one page. Counts combine in each task, and the
    tasks' sketches are added up; a page then packs the cells with count 1 into bits.
    """
    cells = keys.select(
        _page(F.col("key"), pages).alias("page"),
        F.explode(F.array_distinct(F.array(*[_cell(F.col("key"), p) for p in range(PROBES)]))).alias("cell"),
    )
    single = cells.groupBy("page", "cell").agg(F.count("*").alias("n")).where("n = 1")
    words = single.groupBy("page", F.expr("cell div 64").cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cell % 64))").alias("bits")
    )
    # At most PAGE_WORDS rows a page.
    packed = words.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_words"))
    bits = F.expr(f"transform(sequence(0, {PAGE_WORDS - 1}), w -> coalesce(_words[w], 0L))")
    return packed.select("page", bits.alias("bits"))


def surely_single(key: Column, bits: Column) -> Column:
    """Whether a text has a cell of its own in its page of the sketch, so that it occurs once."""
    own = F.lit(False)
    for probe in range(PROBES):
        cell = _cell(key, probe)
        word = F.get(bits, F.floor(cell / 64).cast("int"))
        own = own | (F.call_function("shiftrightunsigned", word, cell % 64).bitwiseAND(F.lit(1)) == 1)
    return F.coalesce(own, F.lit(False))


def with_suspects(rows: DataFrame, sketch: DataFrame, pages: int) -> DataFrame:
    """Add ``suspect`` to rows with a ``key``: whether the text may occur again.

    The sketch is broadcast; ``MAX_PAGES`` bounds its size.
    """
    held = F.broadcast(sketch.select(F.col("page").alias("_page"), F.col("bits").alias("_bits")))
    probed = rows.withColumn("_page", _page(F.col("key"), pages)).join(held, "_page", "left")
    return probed.select(*rows.columns, (~surely_single(F.col("key"), F.col("_bits"))).alias("suspect"))


def audited(docs: DataFrame) -> DataFrame:
    """``doc_id, source, mask, n``: how many documents fail which filters, as bits in the order of ``FILTERS``.

    A document is a copy if the same whole text stands under a smaller ``doc_id`` anywhere
    in the table. A null id counts as larger than all others; rows that share id and text
    are copies together or not at all. Rows that agree in everything are counted together
    from the start.
    """
    spark = docs.sparkSession
    flags = docs.select("doc_id", "source", failures(F.col("text")).alias("mask"), text_key(F.col("text")).alias("key"))
    flags = materialise(
        flags.groupBy(*flags.columns).agg(F.count("*").alias("n")), scratch_path(spark, "audit-flags")
    )
    pages = min(MAX_PAGES, max(1, -(-flags.count() * CELLS_PER_TEXT // PAGE_CELLS)))
    sketch = materialise(single_cells(flags, pages), scratch_path(spark, "audit-sketch"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("key"))
    # Grouped by the whole text; copies combine in each task before they are shuffled.
    firsts = with_suspects(texts, sketch, pages).where("suspect").groupBy("text").agg(
        F.min("doc_id").alias("_first"), F.first("key").alias("_key")
    )
    firsts = materialise(firsts.select("_first", "_key"), scratch_path(spark, "audit-firsts"))
    # Joined by text and id, so that the many copies of one text are spread over the tasks.
    first = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    found = with_suspects(flags, sketch, pages).join(firsts, first, "left")
    copy = F.when(F.col("suspect") & F.col("_key").isNull(), COPY).otherwise(0)
    return found.groupBy("doc_id", "source", (F.col("mask") + copy).alias("mask")).agg(F.sum("n").alias("n"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per source and set of failed filters, and those labelled so.

    A null source is the part with an empty name. A document is good (toxic) if any label of its id says so.
    """
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.expr("int(quality <=> 1)")).alias("_good"), F.max(F.expr("int(toxic <=> 1)")).alias("_toxic")
    )
    return (
        audited(docs).join(judged, F.col("doc_id") == F.col("_id"), "left")
        .groupBy(F.coalesce("source", F.lit("")).alias("part"), "mask")
        .agg(F.sum("n").alias("n"), *(F.sum(F.expr(f"n * coalesce(_{k}, 0)")).alias(k) for k in ("good", "toxic")))
    )


def _steps() -> Column:
    """Every step of every order: its filter's bit, and the bits of those before it."""
    rows = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(letter) for letter in order]
        rows += [f"named_struct('filter_order', '{''.join(order)}', 'step', {k + 1}, 'bit', {bits[k]}, 'before', {sum(bits[:k])})" for k in range(len(bits))]
    return F.expr(f"array({', '.join(rows)})")


def _summed(counts: str, condition: str) -> Column:
    return F.expr(f"aggregate(masks, 0L, (total, m) -> total + CASE WHEN {condition} THEN m.{counts} ELSE 0L END)")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with what the step does.

    ``kept`` are left after the step and ``removed`` go in it; ``redundant`` fail its filter
    but went before; ``unique_fails`` fail it alone; ``good_lost`` and ``toxic_lost`` are the
    labelled among the removed; ``shapley`` adds up what its filter removes over all orders: a
    document that fails ``k`` filters goes by each of them in a ``k``-th of the orders.

    Null texts count as empty; an empty table has no parts and gives an empty result; other
    columns are not read.
    """
    counts = mask_counts(docs, labels)
    # At most one row per mask and part.
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = per_part.select("part", "masks", F.explode(_steps()).alias("_step")).select("part", "masks", "_step.*")
    goes, fails = "m.mask & before = 0 AND m.mask & bit <> 0", "m.mask & bit <> 0"
    turns = F.expr(f"aggregate(masks, 0L, (total, m) -> total + CASE WHEN {fails} THEN m.n * (120 div bit_count(m.mask)) ELSE 0L END)")
    return steps.select(
        "part", "filter_order", "step",
        _summed("n", "m.mask & (before | bit) = 0").alias("kept"),
        _summed("n", goes).alias("removed"),
        _summed("n", f"{fails} AND m.mask & before <> 0").alias("redundant"),
        _summed("n", "m.mask = bit").alias("unique_fails"),
        _summed("good", goes).alias("good_lost"),
        _summed("toxic", goes).alias("toxic_lost"),
        turns.alias("shapley"),
    )


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
), failed AS (
  SELECT doc_id, part,
    len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(first_id < coalesce(doc_id, 9223372036854775807), false) AS e
  FROM (SELECT *, regexp_extract_all(text, '[^ 	-]+') AS words FROM texts) JOIN firsts USING (text)
), judged AS (
  SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic
  FROM labels GROUP BY doc_id
), flat AS (
  SELECT part, a::INT || b::INT || c::INT || d::INT || e::INT AS mask, count(*) AS n,
    sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN judged USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), met AS (
  SELECT part, filter_order, step, f, n, good, toxic,
    substr(mask, ascii(f) - 64, 1) = '1' AS fails,
    len(list_filter(range(1, 6), lambda k: substr(mask, k, 1) = '1' AND contains(earlier, chr((64 + k)::INT)))) > 0 AS gone,
    len(replace(mask, '0', '')) = 1 AS alone
  FROM flat, steps
), summed AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""
