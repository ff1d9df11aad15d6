"""Connected components of a distributed edge list, by local forests and large-star / small-star."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, staged


#: Edges united at once, nodes of a forest that a task holds before it sends it, and edges that one task takes.
EDGES, NODES, SINGLE = 100_000, 1_000_000, 400_000


def _forest(it):
    """A task's edges as stars: every node of a local component to the component's least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def unite(held):
        u, v = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        for x, y in zip(u[new].tolist(), v[new].tolist()):
            a, c = root(x), root(y)
            if a != c:
                parent[max(a, c)] = min(a, c)

    def stars():
        rows = np.array([(x, root(x)) for x in parent], np.int64).reshape(-1, 2)
        rows = rows[rows[:, 0] != rows[:, 1]]
        parent.clear()
        for i in range(0, len(rows), 10_000):
            yield pa.record_batch({"u": pa.array(rows[i : i + 10_000, 0]), "v": pa.array(rows[i : i + 10_000, 1])})

    held, size = [], 0
    for b in batches(it):
        held.append((b["u"].to_numpy(), b["v"].to_numpy()))
        size += b.num_rows
        if size >= EDGES:
            unite(held)
            held, size = [], 0
            if len(parent) >= NODES:
                yield from stars()
    if held:
        unite(held)
    yield from stars()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node with an edge.

    edges: u, v (long, no nulls).  Each task first reduces its edges to a forest, so a hub costs at
    most one row per task and node.  If no more than SINGLE are left, one task unites them; else star
    steps shrink distances, where a hub's neighbours are only aggregated and joined by key.  Every
    round is written to the shared folder.
    """
    edges = staged(edges.select("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long").distinct(), "edges")
    if edges.count() <= SINGLE:
        edges = staged(edges.coalesce(1).mapInArrow(_forest, "u long, v long"), "edges")
        max_rounds = 0
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours to the least one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "edges-large")
        # small star: u is larger than v throughout; smaller neighbours and u itself to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = staged(small, "edges-small")
        # settled when every leaf has one centre and no centre is a leaf
        edges = small
        several = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        chained = small.join(small.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if several.unionByName(chained).isEmpty():
            break
    else:
        if max_rounds:
            raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return leaves.unionByName(centres)
