"""The pipeline against its stages in plain code, and the registration of the queries."""

from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from tests.llm import brute
from wirepulse.llm import decontamination, mixing, queries, quality_rules, token_files

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID output",
    ]


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_run_against_plain_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs}
    measured = quality_rules.measure(None, [t.encode() for t in texts.values()])
    kept = [i for i, good in zip(texts, measured["kept"], strict=True) if good]
    classes = brute.near_classes([(i, texts[i]) for i in kept])
    kept = [i for i in kept if classes[i] == i]
    items = [decontamination.normal(r["text"].encode()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [i for i in kept if not any(item in decontamination.normal(texts[i].encode()) for item in items)]
    left = spark.createDataFrame([r for r in docs if r["doc_id"] in set(kept)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix_plan(left).collect()}
    library = Tokenizer.from_file(token_files.vocabulary())
    want, start = [], 0
    for doc_id in sorted(kept):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        for _ in range(plan[doc_id]):
            want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = [tuple(r) for r in corpus_pipeline.run(spark, SMALL).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert got == want
