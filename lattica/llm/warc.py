"""WARC archives and their capture index.

Writing: one gzip member per record, as crawlers do, behind a warcinfo record.  A page's block is an
HTTP response whose body is the payload; a revisit's block is the HTTP head alone.  Archives go through Spark's committing text
writer, each as one value, so any file system of the cluster will do and a retried task leaves one
copy; the writer's line separator is an empty gzip member, which every reader skips.

Index: every archive that is read gives a run of captures sorted by (URL key, timestamp, id).
Runs are cut at common range bounds and each range is merged from its runs by a loser tree, so the
concatenated ranges are the globally ordered capture histories.

Nulls: a null payload is empty; a null URL gives an empty key and its record names the page itself as
target; rows with a null id are written and read too.  Repeated ids are records of their own.  Empty tables give no rows.  Extra columns are
ignored.  Payloads are never cut.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, read_table, shared_path, staged, tasks_for, tune

#: Equal payloads of at least this many bytes are written once.
REVISIT_BYTES = 1000
#: Uncompressed bytes of an archive, about.
ARCHIVE_BYTES = 64 << 20
#: Captures in a merge range, about; a task holds one range's slices of all runs.
RANGE_ROWS = 50_000
#: The revisits are broadcast up to so many rows (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000

CAPTURE = "urlkey string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_bytes long"
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then the path without scheme, port, www. and fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)", (url or "").strip(), re.I)
    if not m:
        return (url or "").strip().split("#")[0].lower()
    host = m[1].rpartition("@")[2].lower()
    host = re.sub(r":\d*$", "", host).removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/").lower()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _block(headers: list[str], body: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *headers, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def _named(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _info(path: str) -> bytes:
    """The record that opens an archive."""
    body = b"software: lattica\r\nformat: WARC File Format 1.1\r\n"
    return _block(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>", f"WARC-Date: {_captured(0)}", "Content-Type: application/warc-fields"], body)


def _record(kind: str, page_id, url, captured: str, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = _named(page_id)[1:-1] if url is None else re.sub(r"[\r\n]+", " ", url)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_named(page_id)}", f"WARC-Date: {captured}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_named(refers_to)}"]
    return _block([*head, "Content-Type: application/http;msgtype=response"], http + payload if kind == "response" else http)


def _captured(page_id) -> str:
    """Without a capture time of its own, a record is dated by its id in seconds from the epoch."""
    return datetime.fromtimestamp((page_id or 0) % (1 << 32), UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def read_records(blob: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """(offset, compressed bytes, headers, HTTP headers, payload) of every page's record of an archive."""
    at = 0
    while at < len(blob):
        z = zlib.decompressobj(31)
        data = z.decompress(memoryview(blob)[at:])
        size = len(blob) - at - len(z.unused_data)
        if data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            n = int(headers["Content-Length"])
            if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
                raise ValueError(f"damaged record at {at}")
            if headers["WARC-Type"] != "warcinfo":
                http, _, payload = rest[:n].partition(b"\r\n\r\n")
                yield at, size, headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload
        at += size


def resolve_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, payload) with digest and refers_to (null: a response).

    The responder of equal payloads is their largest id: a maximum per digest, combined before the
    shuffle, so a payload that a third of the pages share costs one row per task.
    """
    marked = pages.withColumn("digest", F.sha1("payload"))
    keys = marked.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1")
    groups = staged(groups.select("digest", "response_id"), "warc-groups")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    joined = marked.join(groups, "digest", "left")
    is_revisit = (F.octet_length("payload") >= REVISIT_BYTES) & (F.col("page_id") != F.col("response_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(is_revisit, F.col("response_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record per row of pages (page_id, url, html) to archives under path."""
    tune(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))

    def archive(it):
        members, size = [], 0
        info = _member(_info(path))
        for b in batches(it):
            for page_id, url, payload, digest, refers_to in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                kind = "response" if refers_to is None else "revisit"
                members.append(_member(_record(kind, page_id, url, _captured(page_id), payload, digest, refers_to)))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield pa.record_batch({"value": pa.array([b"".join([info, *members])], pa.binary())})
                    members, size = [], 0
        if members:
            yield pa.record_batch({"value": pa.array([b"".join([info, *members])], pa.binary())})

    blobs = resolve_revisits(rows).mapInArrow(archive, "value binary").select(F.col("value").cast("string").alias("value"))
    blobs.write.option("maxRecordsPerFile", 1).option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """A locally sorted run of captures per archive, checked against the payloads; run names the archive."""

    def index(it):
        number = re.compile(r"<urn:page:(null|-?\d+)>")

        def the_id(x: str | None):
            return None if x is None or (m := number.fullmatch(x)[1]) == "null" else int(m)

        for b in batches(it):
            for name, blob in zip(b["path"].to_pylist(), b["content"]):
                rows = []
                for at, size, h, http, body in read_records(blob.as_py()):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload differs from its digest: {name} at {at}")
                    url = h["WARC-Target-URI"]
                    url = None if f"<{url}>" == h["WARC-Record-ID"] else url
                    rows.append((url_key(url), h["WARC-Date"], the_id(h["WARC-Record-ID"]), url, int(http["Content-Length"]), digest, h["WARC-Type"], the_id(h.get("WARC-Refers-To")), name, at, size))
                rows.sort(key=sort_key)
                for i in range(0, len(rows), 5000):
                    columns = list(zip(*rows[i : i + 5000]))
                    names = [x.split()[0] for x in CAPTURE.split(",")]
                    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in CAPTURE.split(",")]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(index, CAPTURE)


def sort_key(row: tuple) -> tuple:
    """(URL key, timestamp, id): nulls first; archive and offset settle repeated ids."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


class LoserTree:
    """Merge of k sorted lists: inner nodes keep the loser of their match, the top the winner."""

    def __init__(self, runs: list[list], key) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k > 1 else 0

    def _head(self, i: int):
        return (0, self.key(self.runs[i][self.at[i]])) if self.at[i] < len(self.runs[i]) else (1,)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.k and len(self.heads[self.winner]) == 2:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self._head(w)
            node = (w + self.k) // 2
            while node:
                other = self.losers[node]
                if self.heads[other] < self.heads[w]:
                    self.losers[node], w = w, other
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame) -> DataFrame:
    """runs (staged) merged into ranges: range_no, place in it, and the captures in global order.

    Bounds come from (URL key, timestamp, id), so that one hot URL is cut into several ranges too.
    """
    spark = runs.sparkSession
    n = tasks_for(spark, runs.count(), RANGE_ROWS)
    names = ["range_no", "place", *runs.columns]
    kinds = [pa.int32(), pa.int64(), *(pa.int64() if t == "bigint" else pa.string() for _, t in runs.dtypes)]

    def merge(it):
        from pyspark import TaskContext

        by_run: dict[str, list] = {}
        for b in batches(it):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                by_run.setdefault(row[8], []).append(row)
        for rows in by_run.values():  # a shuffle may deliver a run's blocks in any order
            if any(sort_key(a) > sort_key(b) for a, b in zip(rows, rows[1:])):
                rows.sort(key=sort_key)
        place, part, out = 0, TaskContext.get().partitionId(), []

        def flush():
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for row in LoserTree(list(by_run.values()), sort_key):
            out.append((part, place, *row))
            place += 1
            if len(out) == 5000:
                yield flush()
                out = []
        if out:
            yield flush()

    ranged = runs.repartitionByRange(n, F.col("urlkey").asc_nulls_first(), "captured", F.col("page_id").asc_nulls_first())
    return ranged.mapInArrow(merge, f"range_no int, place long, {CAPTURE}")


def histories(merged: DataFrame) -> DataFrame:
    """Per URL key: captures, first and last date and distinct payloads."""
    return merged.groupBy("urlkey").agg(F.count("*").alias("captures"), F.min("captured").alias("first_captured"), F.max("captured").alias("last_captured"), F.count_distinct("payload_digest").alias("payloads"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    runs = staged(capture_runs(spark, path), "warc-runs")
    return merge_runs(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
w AS (SELECT payload_digest, max(page_id) AS response_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN page_id <> response_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> response_id THEN response_id END AS refers_to
FROM d LEFT JOIN w ON d.payload_digest = w.payload_digest AND payload_bytes >= 1000
"""
