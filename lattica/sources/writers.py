"""Sinks: projected JSON lines, shards with a manifest, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import stats

MANIFEST = "range_id string, first_id string, last_id string, records long, skipped long, shard_sha256 string, status string, completed_at string"


def export_lines(df: DataFrame, path: str, reviewed: str = "reviewed") -> None:
    """SK2: reviewed rows as JSON lines; nulls stay out as fields."""
    df.where(F.coalesce(F.col(reviewed), F.lit(False))).drop(reviewed).write.json(path)


def with_ranges(df: DataFrame, id_col: str, size: int) -> DataFrame:
    """SK3, WI6, PR28: range_id of size consecutive ids each."""
    n = stats.numbered(df, [id_col], "_n")
    return n.withColumn("range_id", F.format_string("r%04d", F.floor((F.col("_n") - 1) / size).cast("int"))).drop("_n")


def manifest(df: DataFrame, id_col: str, reason: str | None = None) -> DataFrame:
    """SK3, AG22: one row per range_id: ids, counts and an order-free checksum of its rows.

    The checksum adds up row hashes, so ranges of any size aggregate before the shuffle.
    """
    row = F.xxhash64(*(c for c in df.columns))
    bad = F.col(reason).isNotNull() if reason else F.lit(False)
    return df.groupBy("range_id").agg(
        F.min(F.col(id_col).cast("string")).alias("first_id"), F.max(F.col(id_col).cast("string")).alias("last_id"),
        F.count_if(~bad).alias("records"), F.count_if(bad).alias("skipped"),
        F.sha2(F.concat_ws(":", F.sum(F.shiftright(row, 32)), F.sum(row.bitwiseAND(F.lit(0xFFFFFFFF))), F.count("*")), 256).alias("shard_sha256"),
        F.lit("complete").alias("status"), F.first(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("completed_at"),
    )


def write_shards(df: DataFrame, id_col: str, size: int, path: str, reason: str | None = None) -> DataFrame:
    """SK3, SK4: shards under path/shards by range_id, rejected rows under path/rejected; returns the manifest."""
    from lattica.sources.staging import staged

    ranged = staged(with_ranges(df, id_col, size), "ranged")
    good = ranged.where(F.col(reason).isNull()).drop(reason) if reason else ranged
    good.repartition("range_id").write.partitionBy("range_id").mode("append").json(f"{path}/shards")
    if reason:
        ranged.where(F.col(reason).isNotNull()).select(id_col, reason).write.mode("append").json(f"{path}/rejected")
    return manifest(ranged, id_col, reason)


def resume_plan(wanted: DataFrame, recorded: DataFrame, present: DataFrame) -> DataFrame:
    """ST2: what to do with each range: wanted (range_id), recorded (manifest), present (range_id, observed_sha256)."""
    joined = wanted.join(recorded.select("range_id", "status", "shard_sha256"), "range_id", "left").join(present, "range_id", "left")
    action = (
        F.when(F.col("status").isNull() & F.col("observed_sha256").isNotNull(), "orphan_shard_skipped")
        .when((F.col("status") == "complete") & (F.col("shard_sha256") == F.col("observed_sha256")), "skip")
        .when((F.col("status") == "complete") & F.col("observed_sha256").isNotNull(), "checksum_conflict_skipped")
        .otherwise("write")
    )
    return joined.select("range_id", action.alias("action"))
