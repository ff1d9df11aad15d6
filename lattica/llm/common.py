"""Shared helpers: the cluster's shared folder, staged tables, Arrow batches, word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: a batch of long texts must still fit in a Python worker.
BATCH_ROWS = "1000"
BATCH_BYTES = str(16 << 20)


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python stages of this subpackage receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    Only where the setting is missing in a local session, as in tests, a local folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lattica/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back, so that lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by staged() that nothing reads any more."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps whose results are staged.

    Its cleaner only acts when the driver collects garbage, which a small driver heap rarely does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where df has such columns already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names; extra columns can't clash. Null text is empty."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def tasks_for(spark: SparkSession, total_bytes: int, per_task: int) -> int:
    return max(1, -(-int(total_bytes) // per_task))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            yield b
