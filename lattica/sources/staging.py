"""Tables in the folder that all executors share, to cut lineage and to fix what must not change when recomputed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; a local one only where that is not set in a local session, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lattica/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df for a join of two tables that both grow with the input: never broadcast.

    Spark judges a staged table by its compressed files; rows that repeat each other take many times as much
    in the driver, which gathers whatever is broadcast.
    """
    return df.hint("merge")
