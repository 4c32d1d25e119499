"""Groups of near copies: rows grow with the group, and tiles give the classes of all pairs."""

from __future__ import annotations

import random
from collections import Counter

from tests.llm import brute
from wirepulse.llm import near_dedup, open_groups


def group(n: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(60)]
    docs = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    return docs


def test_rows_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    sizes: dict[int, Counter] = {}
    materialise, tiles = near_dedup.materialise, open_groups.tiles
    for n in (250, 500):
        rows = sizes[n] = Counter()

        def counted(df, path, rows=rows):
            out = materialise(df, path)
            rows[path.rsplit("/", 1)[1].rsplit("-", 1)[0]] += out.count()
            return out

        def dealt(*args, rows=rows):
            out = tiles(*args)
            rows["tiles"] += out.count()
            return out

        monkeypatch.setattr(near_dedup, "materialise", counted)
        monkeypatch.setattr(open_groups, "tiles", dealt)
        docs = group(n)
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == brute.near_classes(docs)
    # Twice the rows for twice the texts; buckets that outgrow the small ones change from pairs to
    # tiles, which have a row per text and band at most. All pairs would be 125 000 rows.
    for label, held in sizes[500].items():
        assert held <= max(2.3 * sizes[250][label], 24 * 500), (label, sizes)
    assert sum(sizes[500].values()) <= 2.6 * sum(sizes[250].values()), sizes


def test_small_tiles_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(open_groups, "TILE", 16)
    monkeypatch.setattr(open_groups, "OPEN_TILE", 4)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    docs = group(120, 2) + [(k + 1000, text) for k, text in group(60, 3)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.near_classes(docs)
