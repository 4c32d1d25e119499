"""The filter audit against plain counting, and its sketch."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import COLUMNS, SMALL, edge_rows
from wirepulse.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def plain(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """``docs`` are ``(doc_id, text, source)``; counts each document in each order."""
    smallest: dict = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    rows = []
    for part in {source or "" for _, _, source in docs}:
        failing = []
        for i, text, source in docs:
            if (source or "") != part:
                continue
            text = text or ""
            words = brute.WORD.findall(text)
            fails = [
                len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                bool(re.search("[#$%&*|]", text)), text in smallest and (i is None or smallest[text] < i),
            ]
            failing.append((i, {f for f, bad in zip("ABCDE", fails, strict=True) if bad}))
        here = []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                kept = sum(not fails & {*before, f} for _, fails in failing)
                removed = [i for i, fails in failing if f in fails and not fails & before]
                here.append((
                    part, "".join(order), step, kept, len(removed), sum(f in fails and bool(fails & before) for _, fails in failing),
                    sum(fails == {f} for _, fails in failing), sum(i in good for i in removed), sum(i in toxic for i in removed),
                ))
        total = Counter()
        for row in here:
            total[row[1][row[2] - 1]] += row[4]
        rows += [(*row, total[row[1][row[2] - 1]]) for row in here]
    return sorted(rows)


def audit(docs, labels) -> list[tuple]:
    return sorted(tuple(r) for r in filter_audit.filter_audit(docs, labels).collect())


def test_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "labels"))
    got = audit(docs, labels)
    assert got == plain([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert sum(row[5] for row in got) and sum(row[7] for row in got)


def copies() -> list[tuple]:
    prose = " ".join(f"w{k}" for k in range(60))
    rows = [(k, prose, "a") for k in range(5, 300)] + [(3, "SHOUT " * 60, None), (2, "SHOUT " * 60, ""), (4, "a $ b", "c")]
    return rows + [(None, "only", "c"), (None, "only", "c"), (None, prose, "a"), (5, prose, "b"), (700, None, "a"), (699, "", "b"), (698, "x " * 90_000, "b")]


@pytest.mark.parametrize("pages", [1, 1 << 16])
def test_copies_and_edge_cases(spark, monkeypatch, pages):
    monkeypatch.setattr(filter_audit, "MAX_PAGES", pages)
    labels = [(3, 1, 1), (3, 0, None), (5, 1, 0), (None, 1, 1), (250, None, 1), (4, 1, 1)]
    docs = [*copies(), *((i, text, source) for i, text, _, source, *_ in edge_rows())]
    table = spark.createDataFrame([(i, text, "en", source, None, 9, "k", 0, 1, "w", "s", 2, 0.5) for i, text, source in docs], COLUMNS)
    assert audit(table.repartition(4), spark.createDataFrame(labels, LABELS)) == plain(docs, labels)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit(spark.createDataFrame([], COLUMNS), labels) == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert audit(one, labels) == plain([(1, None, None)], [])


def test_sketch_clears_most_unique_texts_and_no_other(spark):
    rows = spark.range(20_000).select(filter_audit.text_key(F.concat(F.lit("t"), F.least("id", F.lit(15_000)).cast("string"))).alias("key"), "id")
    sketch = filter_audit.single_cells(rows, 64)
    found = filter_audit.with_suspects(rows, sketch, 64)
    repeated, unique = found.where("id >= 15000"), found.where("id < 15000")
    assert repeated.where("NOT suspect").count() == 0
    assert unique.where("suspect").count() < 300
    assert sketch.select(F.size("bits")).distinct().collect() == [(filter_audit.PAGE_WORDS,)]


def test_only_possible_copies_are_shuffled_whole(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    keyed = docs.select("doc_id", "text", filter_audit.text_key(F.col("text")).alias("key"))
    sketch = filter_audit.single_cells(keyed, 64)
    plan = filter_audit.with_suspects(keyed, sketch, 64).where("suspect")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
