"""Approximate nearest neighbours: NN-descent builds the graph, queries search it greedily.

Equal vectors are one node.  Rounds of NN-descent join every node's neighbours and reverse
neighbours with each other ("a neighbour of a neighbour is likely a neighbour"); new pairs are tried
once, and each node keeps its K nearest.  Reverse neighbours of a popular node are dealt to several
groups, so no group grows with the data.  A query walks the graph from the nearest of a few fixed nodes,
in rounds of Spark joins that expand the best unexpanded nodes of every query at once, until each of
its BEAM best nodes is expanded.

Distances are Euclidean in double precision on the original vectors.  Vectors that are null, zero,
of another length than most rows' or hold null or non-finite components take no part.  A null id takes no
part either.  Ties go to the smaller id; repeated ids are separate candidates.  Empty tables give no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, drop_staged, read_table, staged, tune

#: Graph degree, rounds of NN-descent, members of a joined group, neighbours that a group draws from.
DEGREE, ROUNDS, GROUP = 32, 8, 64
#: A round that changes less than this share of all edges is the last.
SETTLED = 0.002
#: Beam of the search, and nodes expanded per query and round.
BEAM, EXPAND = 192, 24
#: Entry nodes common to all queries (a fixed number, by hash of the id): the driver gets their vectors.
ENTRIES = 512
BLOB = "vector binary"


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (float64 bytes): the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not top:
        return rows.select("id", F.lit(b"").cast("binary").alias("vector")).where("false")

    def to_bytes(it):
        for b in batches(it):
            flat = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(b["id"]), -1) + 0.0  # -0.0 becomes 0.0
            yield pa.record_batch({"id": b["id"], "vector": pa.array([x.tobytes() for x in flat], pa.binary())})

    return rows.where(F.size("v") == top[0]["dim"]).mapInArrow(to_bytes, f"id long, {BLOB}")


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact, by differences."""
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def _best(df: DataFrame, k: int) -> DataFrame:
    """The k nearest (u, v, dist, fresh) of every u: one row per u, nearest first.

    Kept as a bounded sorted array by a two-level aggregate: tasks keep k per u before the shuffle.
    """

    def top(it):
        for b in batches(it):
            u, v, d = (b[c].to_numpy(zero_copy_only=False) for c in ("u", "v", "dist"))
            f = b["fresh"].to_numpy(zero_copy_only=False)
            order = np.lexsort((f, v, d, u))
            u, v, d, f = u[order], v[order], d[order], f[order]
            same = np.zeros(len(u), bool)
            same[1:] = (u[1:] == u[:-1]) & (v[1:] == v[:-1]) & (d[1:] == d[:-1])
            u, v, d, f = u[~same], v[~same], d[~same], f[~same]
            new = np.concatenate([[True], u[1:] != u[:-1]])
            rank = np.arange(len(u)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            keep = rank < k
            yield pa.record_batch({"u": pa.array(u[keep]), "v": pa.array(v[keep]), "dist": pa.array(d[keep]), "fresh": pa.array(f[keep])})

    schema = "u long, v long, dist double, fresh boolean"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def per_task(it):
        """Over all batches of a task: merged whenever many rows are held."""
        held, size, limit = [], 0, 500_000
        for b in batches(it):
            held.append(b)
            size += b.num_rows
            if size > limit:
                held = list(top([pa.Table.from_batches(held).combine_chunks().to_batches()[0]]))
                size = sum(b.num_rows for b in held)
                limit = 2 * size + 500_000  # what stays must not be sorted again and again
        if held:
            yield from top([pa.Table.from_batches(held).combine_chunks().to_batches()[0]])

    local = df.select("u", "v", "dist", "fresh").mapInArrow(per_task, schema)
    return local.repartition(n, "u").mapInArrow(per_task, schema)


def _pairs_of_groups(rows: DataFrame, k: int) -> DataFrame:
    """Pairs (u, v, dist) of a group of which one is fresh and v may be nearer to u than u's worst neighbour.

    rows: g, part, id, fresh, reach (distance of the worst neighbour, or infinite), vector.
    """

    def join(it):
        at, ids, fresh, reach, blobs = None, [], [], [], []

        def close():
            if len(ids) < 2 or not any(fresh):
                return None
            x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(ids), -1)
            i, f = np.array(ids), np.array(fresh)
            square = (x * x).sum(axis=1)
            d = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)
            # a little slack: these distances are only for choosing
            far = d > (np.array(reach) ** 2 * (1 + 1e-9) + 1e-9 * square)[:, None]
            d[far | ~(f[:, None] | f[None, :]) | (i[:, None] == i[None, :])] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            a = np.repeat(np.arange(len(i)), near.shape[1])
            b = near.reshape(-1)
            ok = np.isfinite(d[a, b])
            a, b = a[ok], b[ok]
            return i[a], i[b], _distances(x[a], x[b])

        out, size = [], 0

        def flush():
            u, v, d = (np.concatenate(c) for c in zip(*out))
            return pa.record_batch({"u": pa.array(u), "v": pa.array(v), "dist": pa.array(d), "fresh": pa.array(np.ones(len(u), bool))})

        for b in batches(it):
            for g, part, i, f, r, x in zip(*(b[c].to_pylist() for c in ("g", "part", "id", "fresh", "reach", "vector"))):
                if (g, part) != at:
                    if found := close():
                        out.append(found)
                        size += len(found[0])
                        if size > 50_000:
                            yield flush()
                            out, size = [], 0
                    at, ids, fresh, reach, blobs = (g, part), [], [], [], []
                if not ids or ids[-1] != i:
                    ids.append(i)
                    fresh.append(f)
                    reach.append(r)
                    blobs.append(x)
        if found := close():
            out.append(found)
        if out:
            yield flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(n, "g", "part").sortWithinPartitions("g", "part", "id", F.desc("fresh"))
    return sorted_rows.select("g", "part", "id", "fresh", "reach", "vector").mapInArrow(join, "u long, v long, dist double, fresh boolean")


def build_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """u, v, dist: about `degree` near neighbours of every node.  nodes (staged): id, vector, distinct vectors.

    The first graph joins nodes that random projections order next to each other; rounds of
    neighbours of neighbours then improve it until few edges change.
    """
    n = nodes.count()
    if n < 2:
        return nodes.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("dist")).where("false")
    n_groups = max(1, n // GROUP)

    # order along random directions; neighbours in order share a group
    starts = []
    for seed in range(3):
        def project(it, seed=seed):
            for b in batches(it):
                x = _matrix(b["vector"])
                w = np.random.default_rng(seed).standard_normal(x.shape[1])
                yield pa.record_batch({"id": b["id"], "at": pa.array(x @ w), "vector": b["vector"]})

        placed = nodes.mapInArrow(project, f"id long, at double, {BLOB}")
        tasks = max(1, min(n_groups, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        ranged = placed.repartitionByRange(tasks, "at", "id").sortWithinPartitions("at", "id")

        def cut(it, seed=seed):
            from pyspark import TaskContext

            part, k = TaskContext.get().partitionId(), 0
            for b in batches(it):
                at = np.arange(k, k + b.num_rows) // GROUP
                k += b.num_rows
                yield pa.record_batch({"g": pa.array(at.astype(np.int64)), "part": pa.array(np.full(len(at), part * 8 + seed, np.int64)), "id": b["id"], "fresh": pa.array(np.ones(len(at), bool)), "reach": pa.array(np.full(len(at), np.inf)), "vector": b["vector"]})

        starts.append(ranged.mapInArrow(cut, f"g long, part long, id long, fresh boolean, reach double, {BLOB}"))
    first = starts[0].unionByName(starts[1]).unionByName(starts[2])
    graph = staged(_best(_pairs_of_groups(first, degree), degree), "ann-graph")

    for _ in range(rounds):
        # members of u's group: u, its neighbours, those it is a neighbour of; a popular u gets several groups
        edges = graph.select(F.col("u").alias("g"), F.col("v").alias("id"), "fresh").unionByName(graph.select(F.col("v").alias("g"), F.col("u").alias("id"), "fresh"))
        parts = edges.groupBy("g").agg(F.count("*").alias("c")).select("g", F.ceil(F.col("c") / (2 * GROUP)).cast("long").alias("parts"))
        dealt = edges.join(parts, "g").select("g", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "fresh")
        own = parts.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("g").alias("id"), F.lit(False).alias("fresh"))
        worst = graph.groupBy("u").agg(F.max("dist").alias("far"), F.count("*").alias("c"))
        known = nodes.join(worst, nodes["id"] == worst["u"], "left").select("id", "vector", F.when(F.col("c") >= degree, F.col("far")).otherwise(F.lit(float("inf"))).alias("reach"))
        members = dealt.unionByName(own).join(known, "id").select("g", "part", "id", "fresh", "reach", "vector")
        tried = _pairs_of_groups(members, degree)
        old = graph.select("u", "v", "dist", F.lit(False).alias("fresh"))
        better = staged(_best(tried.unionByName(old), degree), "ann-graph")
        changed = better.where("fresh").count()
        drop_staged(nodes.sparkSession, graph)
        graph = better
        if changed <= SETTLED * n * degree:
            break
    return graph.select("u", "v", "dist")


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, node, dist: the k nearest nodes that a greedy walk of each query finds.

    graph (staged): u, v; nodes (staged): id, vector; queries: query_id, vector.  The walk starts at
    the nearest of ENTRIES common nodes; a query that is itself a node starts there too.  What falls out
    of a beam never comes back, as the beam only gets nearer, so the walk ends by itself.
    """
    # both directions, but a popular node only the nearest of those that point to it
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "dist")
    local = F.row_number().over(Window.partitionBy("u", F.pmod(F.xxhash64("v"), F.lit(16))).orderBy("dist", "v"))
    back = back.withColumn("r", local).where(F.col("r") <= 2).select("u", "v")
    links = graph.select("u", "v").unionByName(back).distinct().groupBy("u").agg(F.collect_list("v").alias("near"))
    links = staged(links, "ann-links")

    q = staged(queries.select("query_id", F.col("vector").alias("q")), "ann-queries")
    entries = nodes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).collect()
    ids, at = np.array([r["id"] for r in entries], np.int64), np.array([np.frombuffer(r["vector"], np.float64) for r in entries])

    def enter(it):
        """The nearest of the entry nodes, for every query of a task."""
        for b in batches(it):
            dists = [_distances(at, x) for x in _matrix(b["q"])]
            near = [np.lexsort((ids, d))[:BEAM] for d in dists]
            n = min(BEAM, len(ids))
            yield pa.record_batch({"query_id": pa.array(np.repeat(b["query_id"].to_numpy(), n)), "id": pa.array(ids[np.concatenate(near)]), "dist": pa.array(np.concatenate([d[k] for d, k in zip(dists, near)])), "done": pa.array(np.zeros(n * len(near), bool))})

    walk = "query_id long, id long, dist double, done boolean"
    first = q.mapInArrow(enter, walk) if entries else q.select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("dist"), F.lit(False).alias("done")).where("false")
    same = q.join(nodes.withColumnRenamed("vector", "q"), "q").select("query_id", "id", F.lit(0.0).alias("dist"), F.lit(False).alias("done"))

    def measure(pairs: DataFrame) -> DataFrame:
        def dist(it):
            for b in batches(it):
                yield pa.record_batch({"query_id": b["query_id"], "id": b["id"], "dist": pa.array(_distances(_matrix(b["q"]), _matrix(b["vector"]))), "done": pa.array(np.zeros(b.num_rows, bool))})

        return pairs.join(q, "query_id").join(nodes, "id").select("query_id", "id", "q", "vector").mapInArrow(dist, walk)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    beam = staged(first.unionByName(same).distinct().withColumn("r", rank).where(F.col("r") <= BEAM).drop("r"), "ann-beam")
    while True:  # every round expands a node of each query that is still on its way, and none twice
        todo = F.row_number().over(Window.partitionBy("query_id", "done").orderBy("dist", "id"))
        marked = beam.withColumn("r", todo)
        go = marked.where(~F.col("done") & (F.col("r") <= EXPAND)).select("query_id", F.col("id").alias("u"))
        if go.isEmpty():
            break
        reached = go.join(links, "u").select("query_id", F.explode("near").alias("id")).distinct().join(beam, ["query_id", "id"], "left_anti")
        known = marked.select("query_id", "id", "dist", (F.col("done") | (F.col("r") <= EXPAND)).alias("done"))
        before, beam = beam, staged(known.unionByName(measure(reached)).withColumn("r", rank).where(F.col("r") <= BEAM).drop("r"), "ann-beam")
        drop_staged(nodes.sparkSession, before)
    return beam.withColumn("r", rank).where(F.col("r") <= k).select("query_id", F.col("id").alias("node"), "dist")


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: k nearest rows other than the query's own, ties to the smaller id.

    queries: rows of the same form; ids name them.
    """
    tune(df.sparkSession)
    rows = staged(vectors(df, id_col, vector_col), "ann-rows")
    wanted = vectors(queries, id_col, vector_col).select(F.col("id").alias("query_id"), "vector")

    # equal vectors: a node named by the least id, with its k + 1 least members and their number
    nodes = staged(rows.groupBy("vector").agg(F.min("id").alias("id")), "ann-nodes")
    graph = staged(build_graph(nodes), "ann-final")
    one = nodes.select(F.octet_length("vector")).first()
    wanted = wanted.where(F.octet_length("vector") == (one[0] if one else -1))
    found = search(graph, nodes, wanted, k + 1)
    # members of the nodes found: at most k + 1 of each, the least
    hit = staged(found, "ann-found")
    named = hit.select("node").distinct().join(nodes, hit["node"] == nodes["id"]).select("node", "vector")
    members = rows.join(named, "vector").select("node", "id")
    members = least_members(members, k + 1)
    out = hit.join(members, "node").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("dist").alias("score"))


def least_members(members: DataFrame, k: int) -> DataFrame:
    """The k least ids of every node: tasks keep k before the shuffle, so a node of a third of the rows is small."""

    def least(it):
        held: dict[int, list[int]] = {}
        for b in batches(it):
            for node, i in zip(b["node"].to_pylist(), b["id"].to_pylist()):
                own = held.setdefault(node, [])
                own.append(i)
                if len(own) > 4 * k:
                    own.sort()
                    del own[k:]
        rows = [(n, i) for n, own in held.items() for i in sorted(own)[:k]]
        for s in range(0, len(rows), 10_000):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[s : s + 10_000])], names=["node", "id"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.mapInArrow(least, "node long, id long").repartition(n, "node").mapInArrow(least, "node long, id long")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    return nearest(df, df.where("vec_id % 100 = 0"))
