"""Sources: JSON lines, directories of JSON, manifests and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "struct<nodes:array<struct<id:string,type:string>>,edges:array<struct<source:string,target:string,label:string>>>"
RAW = "id BIGINT, mermaid STRING, domain STRING, style STRING, cloud STRING, target_complexity STRING, constraints ARRAY<STRING>, diagram_type STRING, nodes INT, edges INT"


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC3: a malformed line fails the read; blank lines don't count."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """SC4: (good rows, malformed lines)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC5, SC7: one document per file, with the file's name; order by it where order counts."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def by_manifest(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """SC8: rows of shards that the manifest calls complete and whose checksum it confirms."""
    ok = manifest.where("status = 'complete' AND shard_sha256 = observed_sha256").select("range_id")
    return shards.join(ok, "range_id", "left_semi")


def split_rows(df: DataFrame, split: str, ids: list | None = None, id_col: str = "id", limit: int | None = None) -> DataFrame:
    """SC9: a split's rows, some ids only, the first ones."""
    out = df.where(F.col("split") == split)
    if ids is not None:
        out = out.where(F.col(id_col).isin(ids))
    return out if limit is None else out.orderBy(id_col).limit(limit)


def last_match(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """SC10: per file the first group of the pattern's last match."""
    logs = spark.read.text(path, wholetext=True)
    found = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
    return logs.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.when(F.size(found) > 0, F.element_at(found, -1)).alias("found"))


def template(text: Column, pattern: str) -> Column:
    """SC11: the pattern's first group, over lines."""
    return F.regexp_extract(text, f"(?s){pattern}", 1)


def first_seen_codes(df: DataFrame, label: str, order: str) -> DataFrame:
    """SC12: labels numbered from 0 in order of first appearance; labels that appear together go by name."""
    from lattica.operators.stats import numbered

    first = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("_first"))
    return numbered(first, ["_first", label], "code").select(label, (F.col("code") - 1).cast("long").alias("code"))


def describe(df: DataFrame) -> DataFrame:
    """SC2: column, type."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column string, type string")


def split_sizes(df: DataFrame, split: str) -> DataFrame:
    """SC2: rows of every split; rows without one count as train."""
    return df.groupBy(F.coalesce(F.col(split).cast("string"), F.lit("train")).alias("split")).agg(F.count("*").alias("rows"))
