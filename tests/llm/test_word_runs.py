"""Runs of words against plain search, and their report on edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.test_operators import COLUMNS, SMALL, edge_rows
from wirepulse.llm import word_runs


def plain_runs(words: list) -> list[tuple]:
    """Every stretch of a period that cannot be extended, each at its smallest period."""
    numbers = {word: k for k, word in enumerate(words)}
    ids = np.array([numbers[word] for word in words], np.int64)
    best = {}
    for q in range(len(ids) // 4, 0, -1):
        edges = np.diff(np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(int))
        for start, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            if end - start + q >= max(6, 4 * q):
                best[start, end - start + q] = q
    return sorted((s, length, q) for (s, length), q in best.items())


def planted(doc_id: int | None, text: str | None) -> list[str]:
    words = brute.WORD.findall(text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id: int | None, text: str | None) -> tuple:
    words = planted(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    first = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    shown = (*first, 1000 * first[1] // first[2]) if first else (None,) * 4
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listing, left)]
    return (doc_id, len(runs), *shown, *digests, len(words))


def report(docs) -> list[tuple]:
    return [tuple(row) for row in word_runs.run_report(word_runs.with_planted_runs(docs)).collect()]


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            words = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(rng.choice([2, 20, 130])))]
            for _ in range(rng.randrange(3)):
                a, p = rng.randrange(len(words) + 1), rng.randrange(1, 12)
                for i in range(a + p, rng.randrange(len(words) + 1)):
                    words[i] = words[i - p]
            texts.append(words)
        got = word_runs.find_runs([np.array(words, np.int64) for words in texts])
        assert [[tuple(r) for r in rows.tolist()] for rows in got] == [plain_runs(words) for words in texts]


def test_agreeing_places():
    rng = random.Random(9)
    words = [rng.randrange(2) for _ in range(200)] + [0] * 60 + [0, 1] * 50 + [7]
    symbols, n = np.array(words + [9], np.int64), len(words)
    rounds = word_runs.recompress(symbols, np.zeros(n + 1, np.int64))
    one = np.array([rng.randrange(n - 1) for _ in range(3000)])
    other = np.array([rng.randrange(i + 1, n) for i in one.tolist()])
    onward = word_runs.agreeing(rounds, one, other, True)
    before = word_runs.agreeing(rounds, one, other, False)
    for i, j, f, b in zip(one.tolist(), other.tolist(), onward.tolist(), before.tolist(), strict=True):
        assert words[i:i + f] == words[j:j + f] and (j + f == n or words[i + f] != words[j + f])
        assert words[i - b:i] == words[j - b:j] and (b == i or words[i - b - 1] != words[j - b - 1])


def test_rounds_are_few_where_words_repeat():
    symbols = np.append(np.arange(20_000) % 7, 99)
    rounds = word_runs.recompress(symbols, np.zeros(len(symbols), np.int64))
    assert len(rounds) < 30 and sum(len(r.symbols) for r in rounds) < 8 * len(symbols)


def test_report_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = [expected(r["doc_id"], r["text"]) for r in docs.collect()]
    got = report(docs)
    assert in_order(got) == in_order(want) and sum(row[1] > 0 for row in got) > 3


def test_edge_cases(spark):
    more = [(None, "a " * 9), (48, None), (6, "x y")]
    rows = [*edge_rows(), *((i, text, *edge_rows()[0][2:]) for i, text in more)]
    assert in_order(report(spark.createDataFrame(rows, COLUMNS))) == in_order([expected(r[0], r[1]) for r in rows])
    long = spark.createDataFrame([(49, "b c " * 30_000)], "doc_id long, text string")
    assert [row[1:5] for row in report(long)] == [(1, 0, 60_000, 2)]
    empty = word_runs.run_report(word_runs.with_planted_runs(spark.createDataFrame([], COLUMNS)))
    assert empty.collect() == [] and empty.columns[0] == "doc_id"


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "so a b a b a b a b it goes"), (2, None), (3, "no no no no no")], "doc_id long, text string")
    got = {r["doc_id"]: (r["collapsed"], [tuple(x) for x in r["runs"]]) for r in word_runs.word_runs(docs).collect()}
    assert got == {1: ("so a b it goes", [(1, 8, 2)]), 2: ("", []), 3: ("no no no no no", [])}
