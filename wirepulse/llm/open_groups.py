"""Links between components that share larger buckets, without a row per pair.

Where a bucket of near copies still holds several components, each text outside its largest
one is compared with all texts that share such a bucket. Texts are dealt to tiles, and a task
gets two of them: it compares sketches as arrays, and keeps the components that it finds
joined, so that only pairs which could join two more are looked at closely. What leaves a task
is a forest: fewer links than texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.text import utf8
from wirepulse.session import materialise, scratch_path

#: Texts of a tile, and of a tile of texts outside the largest component; and bytes of either.
TILE, OPEN_TILE = 2048, 512
TILE_BYTES = 4 << 20
#: Texts with the best sketches that are looked at before all others together.
FIRST = 6


def tiles(opened: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``home, i, j, open, key, root, planes, text``: the rows of each pair of tiles.

    ``opened`` has ``value, key, root``. Both texts of any pair of roots in a bucket are rows of
    the bucket's largest root, and one at least is not of that root, so it is in an open tile.
    """
    spark = opened.sparkSession
    counts = opened.groupBy("value", "root").agg(F.count("*").alias("n"))
    homes = counts.groupBy("value").agg(F.max(F.struct("n", "root")).alias("_most")).select("value", F.col("_most.root").alias("home"))
    placed = opened.join(homes, "value").select("home", "key", "root").distinct()
    rows = placed.join(nodes.select("key", "planes"), "key").join(texts.select("key", "text"), "key")
    rows = materialise(rows.withColumn("open", F.col("root") != F.col("home")), scratch_path(spark, "near-open-texts"))
    size = F.octet_length("text").cast("long")
    many = rows.groupBy("home").agg(
        F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(size) / TILE_BYTES)).cast("int").alias("_tiles"),
        F.greatest(F.ceil(F.count_if("open") / OPEN_TILE), F.ceil(F.coalesce(F.sum(F.when(F.col("open"), size)), F.lit(0)) / TILE_BYTES)).cast("int").alias("_open_tiles"),
    )
    dealt = rows.join(many, "home")
    i = F.pmod(F.xxhash64("key"), F.greatest("_tiles", F.lit(1))).cast("int")
    j = F.pmod(F.xxhash64("key", F.lit(1)), F.greatest("_open_tiles", F.lit(1))).cast("int")
    every = [F.explode(F.sequence(F.lit(0), F.greatest(F.col(name), F.lit(1)) - 1)) for name in ("_tiles", "_open_tiles")]
    held = ["key", "root", "planes", "text"]
    plain = dealt.select("home", i.alias("i"), every[1].alias("j"), F.lit(False).alias("open"), *held)
    opens = dealt.where("open").select("home", every[0].alias("i"), j.alias("j"), F.lit(True).alias("open"), *held)
    return plain.unionByName(opens)


def agreeing(one: np.ndarray, others: np.ndarray, slots: int) -> np.ndarray:
    """Slots in which a sketch's planes agree with those of each other one."""
    differ = others ^ one
    halves = [differ[:, half] | differ[:, 2 + half] | differ[:, 4 + half] | differ[:, 6 + half] for half in (0, 1)]
    return slots - np.bitwise_count(halves[0]).astype(np.int64) - np.bitwise_count(halves[1])


def joined(
    keys: list[bytes], roots: list[bytes], planes: np.ndarray, texts: list[bytes], opens: np.ndarray,
    shingles: Callable, similar: Callable[[bytes, bytes], bool], least: tuple[int, int], slots: int, enough: int,
) -> list[tuple[bytes, bytes]]:
    """A forest of links between the roots of some texts, each between an open text and another one."""
    parent = {root: root for root in roots}

    def find(root: bytes) -> bytes:
        while parent[root] != root:
            parent[root] = parent[parent[root]]
            root = parent[root]
        return root

    hashes, weights, owners = shingles(texts)
    first = np.searchsorted(owners, np.arange(len(texts) + 1))
    total = np.bincount(owners, weights=weights, minlength=len(texts)).astype(np.int64)
    known: dict[bytes, int] = {}
    label = np.array([known.setdefault(root, len(known)) for root in roots], np.int64)
    links = []

    def link(x: int, y: int) -> bool:
        if keys[x] == keys[y] or not similar(texts[x], texts[y]):
            return False
        parent[find(roots[x])] = find(roots[y])
        links.append((min(keys[x], keys[y]), max(keys[x], keys[y])))
        return True

    for x in opens.tolist():
        agreed = agreeing(planes[x], planes, slots)
        near = np.flatnonzero((agreed >= enough) & (label != label[x]))
        near = near[np.argsort(-agreed[near], kind="stable")]
        for y in near[:FIRST].tolist():
            if find(roots[x]) != find(roots[y]):
                link(x, y)
        apart = np.array([y for y in near[FIRST:].tolist() if find(roots[x]) != find(roots[y])], np.int64)
        if not len(apart):
            continue
        # Shared shingles by hash with all of them at once; a shared hash can only add.
        mine = slice(first[x], first[x + 1])
        held = first[apart + 1] - first[apart]
        at = np.repeat(first[apart] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        place = np.minimum(np.searchsorted(hashes[mine], hashes[at]), max(0, first[x + 1] - first[x] - 1))
        both = np.where(hashes[mine][place] == hashes[at], np.minimum(weights[mine][place], weights[at]), 0)
        shared = np.bincount(np.repeat(np.arange(len(apart)), held), weights=both, minlength=len(apart)).astype(np.int64)
        passed = least[1] * shared >= least[0] * (total[x] + total[apart] - shared)
        for y in apart[passed].tolist():
            if find(roots[x]) != find(roots[y]):
                link(x, y)
    return links


def open_links(
    opened: DataFrame, nodes: DataFrame, texts: DataFrame,
    shingles: Callable, similar: Callable[[bytes, bytes], bool], least: tuple[int, int], slots: int, enough: int,
) -> DataFrame:
    """``a, b``: links that join the roots of ``opened`` (``value, key, root``) as all its similar pairs would.

    The work left grows with the open texts times all texts of a group, as comparisons of
    sketches inside tasks; rows grow with that product only by a tile's size.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, roots = table["key"].to_pylist(), table["root"].to_pylist()
        column = table["planes"].combine_chunks()
        planes = column.flatten().to_numpy().reshape(len(keys), -1).view(np.uint64)
        opens = np.flatnonzero(table["open"].to_numpy())
        found = joined(keys, roots, planes, utf8(table["text"]), opens, shingles, similar, least, slots, enough)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    rows = tiles(opened, nodes, texts)
    return rows.groupBy("home", "i", "j").applyInArrow(run, "a binary, b binary").distinct()
