"""Leakage-safe splits: whole clusters are dealt to splits by deficit.

The greedy rule is a fold over clusters in order, but clusters of one tier and size are alike: the
fold runs over (tier, size, number of clusters) on the driver, a table bounded by the distinct
sizes, and clusters pick their split by their place in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.stats import numbered
from lattica.sources.staging import staged

#: Places of clusters that meet a run of places together.
BLOCK = 10_000
SPLITS = ["train", "validation", "test"]
RATIOS = [0.9, 0.05, 0.05]


def deal(counts: list[tuple[int, int, int]], ratios: list[float] = RATIOS, relative: bool = True) -> list[tuple[int, int, int, int, int]]:
    """[(tier, size, first place, last place, split)] for clusters in order of tier, then falling size.

    relative: the split with the largest share of its target open gets the cluster, the last one of
    equals; else the one with most places open, the first of equals.  A split without target is full.
    """
    total = sum(size * n for _, size, n in counts)
    targets = [round(total * r) for r in ratios] if relative else [total * r for r in ratios]
    given = [0] * len(ratios)
    out = []
    for tier, size, n in sorted(counts, key=lambda c: (c[0], -c[1])):
        for place in range(1, n + 1):
            if relative:
                best = max(range(len(ratios)), key=lambda i: ((targets[i] - given[i]) / targets[i] if targets[i] else float("-inf"), i))
            else:
                best = max(range(len(ratios)), key=lambda i: (targets[i] - given[i], -i))
            given[best] += size
            if out and out[-1][:2] == (tier, size) and out[-1][4] == best:
                out[-1] = (*out[-1][:3], place, best)
            else:
                out.append((tier, size, place, place, best))
    return out


def assign(records: DataFrame, cluster: str, tier: str, order: str, ratios: list[float] = RATIOS, relative: bool = True) -> DataFrame:
    """SP2, SP3: records with a split; clusters stay whole.  Clusters of one tier and size go by their first record.

    Clusters are numbered over all tiers and sizes at once, and a run of numbers gets a split: no task
    holds all clusters of a size.
    """
    clusters = records.groupBy(cluster).agg((-F.count("*")).alias("_less"), F.coalesce(F.min(tier).cast("int"), F.lit(-1)).alias("_tier"), F.min(order).alias("_first"))
    clusters = staged(clusters, "clusters")
    like = [(r["_tier"], -r["_less"], r["n"]) for r in clusters.groupBy("_tier", "_less").agg(F.count("*").alias("n")).collect()]
    runs, at, before = [], None, 0
    for t, size, low, high, split in deal(like, ratios, relative):
        if (t, size) != at:
            at, start = (t, size), before
        before = start + high
        runs.append((start + low, start + high, SPLITS[split]))
    spark = records.sparkSession
    ranges = spark.createDataFrame(runs, "_low long, _high long, split string")
    dealt = numbered(clusters, ["_tier", "_less", "_first"], "_place")
    # runs are few where clusters are alike, but may be as many as clusters: meet by blocks of places
    block = lambda c: F.floor(c / BLOCK)
    spread = ranges.select("*", F.explode(F.sequence(block(F.col("_low")), block(F.col("_high")))).alias("_block"))
    dealt = dealt.withColumn("_block", block(F.col("_place"))).join(spread, "_block").where("_place BETWEEN _low AND _high").select(F.col(cluster).alias("_cluster"), "split")
    return records.join(dealt, F.col(cluster).eqNullSafe(F.col("_cluster"))).drop("_cluster")


def straddling(records: DataFrame, cluster: str) -> DataFrame:
    """JO18: clusters with records in several splits; there must be none."""
    return records.groupBy(cluster).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
