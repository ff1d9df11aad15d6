"""Token files: frequency-ranked ids in 1 to 4 bytes, lengths in separate control bytes.

A shard file holds a contiguous range of documents in ascending doc_id order, as blocks one after the
other, each closed by a line feed.  A block ranks its ids by their own frequency in it, so it is read
without any other; a file is rebuilt alone if its task is lost.

    magic 4s | bytes of the block u64 | n_docs u32 | n_tokens u64 | n_vocab u32 | vocab u32[n_vocab], most frequent first
    | doc_id i64[n_docs] | doc_id is null u8[n_docs] | tokens per doc u32[n_docs]
    | control u8[ceil(n_tokens / 4)], two bits a token: bytes less one | data

Nothing is sampled.  Null text counts as empty; a null doc_id sorts first and stays null; repeated
ids are kept as rows of their own, in text order; an empty table gives no rows.  Very long texts
make a longer shard.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, read_table, shared_path, staged, tasks_for, text_rows, tune
from .tokenize import tokenizer, vocabulary_path, with_end

MAGIC = b"LTK1"
#: UTF-8 bytes of text in a block, which a worker holds at a time, and in a shard file, about.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 32 << 20

_LEN = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int64)
_OFF = np.cumsum(_LEN, axis=1) - _LEN
_TOTAL = _LEN.sum(axis=1)


def pack_ids(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """(vocabulary by falling frequency, control bytes, data bytes)."""
    counts = np.bincount(ids)
    vocab = np.flatnonzero(counts)
    vocab = vocab[np.argsort(-counts[vocab], kind="stable")].astype(np.uint32)
    rank = np.zeros(len(counts), np.uint32)
    rank[vocab] = np.arange(len(vocab), dtype=np.uint32)
    ranks = rank[ids]
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return vocab, control.astype(np.uint8).tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack_ids(vocab: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Look up each control byte's lengths and offsets, gather the bytes, map ranks to ids."""
    if not n:
        return np.zeros(0, np.uint32)
    base = np.cumsum(_TOTAL[control]) - _TOTAL[control]
    at = (base[:, None] + _OFF[control]).reshape(-1)[:n]
    size = _LEN[control].reshape(-1)[:n]
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    ranks = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        ranks[longer] |= padded[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return vocab[ranks]


def write_block(doc_ids: np.ndarray, null_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    vocab, control, data = pack_ids(ids)
    sizes = len(doc_ids).to_bytes(4, "little") + len(ids).to_bytes(8, "little") + len(vocab).to_bytes(4, "little")
    arrays = (vocab.astype("<u4"), doc_ids.astype("<i8"), null_ids.astype(np.uint8), counts.astype("<u4"))
    body = b"".join([sizes, *(x.tobytes() for x in arrays), control, data])
    return MAGIC + (len(body) + 12).to_bytes(8, "little") + body


def read_blocks(blob) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, null_ids, counts, ids) of every block of a shard file."""
    begin = 0
    while len(blob) - begin > 1:
        if bytes(blob[begin : begin + 4]) != MAGIC:
            raise ValueError("not a token shard")
        size, n_docs, n, n_vocab = (int.from_bytes(bytes(blob[begin + a : begin + b]), "little") for a, b in ((4, 12), (12, 16), (16, 24), (24, 28)))
        at = begin + 28

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        vocab, doc_ids, nulls, counts = take("<u4", n_vocab), take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
        control = take("u1", -(-n // 4))
        data = take("u1", int(_LEN[control].reshape(-1)[:n].sum()))
        if at != begin + size:
            raise ValueError("damaged token shard")
        yield doc_ids, nulls.astype(bool), counts, unpack_ids(vocab, control, data, n)
        begin += size + 1


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write shards to path, one range of doc_id each.

    vocabulary: a byte-level tokenizers file.  Shards go through Spark's committing text writer
    (a block's bytes as one value, closed by a line feed), so a retried task leaves one copy.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = text_rows(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = tasks_for(spark, total, SHARD_BYTES)

    def encode(it):
        t = tokenizer(vocabulary, True)
        parts, size = [], 0

        def block() -> pa.RecordBatch:
            doc_id = pa.concat_arrays([p[0] for p in parts])
            blob = write_block(doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False), np.concatenate([p[2] for p in parts]), np.concatenate([p[1] for p in parts]))
            return pa.record_batch({"value": pa.array([blob], pa.binary())})

        for b in batches(it):
            ids, counts = with_end(*t.encode(b["text"]), end_id)
            parts.append((b["doc_id"], ids, counts))
            size += b["text"].nbytes
            if size >= BLOCK_BYTES:
                yield block()
                parts, size = [], 0
        if parts:
            yield block()

    ranged = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path)


def _decoded(spark: SparkSession, path: str, column: str, kind: str, make) -> DataFrame:
    """Per document of the shards under path, with make(ids as bytes) as a column."""
    tune(spark)

    def decode(it):
        for b in batches(it):
            for name, blob in zip(b["path"].to_pylist(), b["content"]):
                shard, before = int(name.rsplit("/part-", 1)[1].split("-")[0]), 0
                for doc_ids, nulls, counts, ids in read_blocks(blob.as_buffer()):
                    raw = memoryview(ids.astype("<u4", copy=False)).cast("B") if len(ids) else memoryview(b"")
                    ends = np.cumsum(counts.astype(np.int64))
                    for i in range(0, len(doc_ids), 500):
                        s = slice(i, i + 500)
                        yield pa.record_batch(
                            {
                                "shard": pa.array(np.full(len(counts[s]), shard, np.int32)),
                                "doc_id": pa.array(doc_ids[s], mask=nulls[s]),
                                "local_start": pa.array(before + (ends - counts)[s]),
                                "n_tokens": pa.array(counts[s].astype(np.int64)),
                                column: pa.array([make(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends[s].tolist(), counts[s].tolist())], kind),
                            }
                        )
                    before += len(ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(decode, f"shard int, doc_id long, local_start long, n_tokens long, {column} {'binary' if kind == 'binary' else 'long'}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards under path: shard, doc_id, local_start, n_tokens, ids (u32, little endian)."""
    return _decoded(spark, path, "ids", "binary", bytes)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start over all shards, n_tokens, ids_crc32.

    The ids' checksums are taken next to the decoder; only a few numbers per document are staged.
    Shards are numbered in the order of their documents; one row per shard meets in the running sum.
    """
    rows = staged(_decoded(spark, path, "ids_crc32", "int64", zlib.crc32), "token-index")
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    offsets = sizes.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0).cast("long")).alias("before"))
    return rows.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path, vocabulary_path("byte_bpe_50k.json"), end_id=2)
    return token_index(spark, path)
