"""Best-fit packing by exact-complement hashing over the histogram of piece lengths.

Only lengths decide a packing, so the plan is made on counts per length (at most `capacity` numbers,
whatever the corpus) and pieces are then dealt to its slots by their rank within their length.

Plan: lengths are indexed by single, pair and triple sums; an item a consumes, as often as counts
allow, combinations that fill its gap capacity - a exactly; what is left over goes best-fit,
longest first, into the tightest open gap.  A step always moves a whole multiplicity.

Nulls: null text is empty (only the end id); a null doc_id stays null.  Repeated rows are pieces of
their own.  Empty tables give no rows.  Extra columns are ignored.  Ties go by partition and row.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, read_table, staged, text_rows, tune
from .tokenize import tokenizer, vocabulary_path, with_end

CAPACITY = 2048

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def make_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, append end_id, cut longer documents into pieces of `capacity`.

    part and nth: the writing task and the piece's rank among that task's pieces of its length.
    keep_ids adds the ids (u32, little endian).
    """
    tune(docs.sparkSession)

    def cut(it):
        from pyspark import TaskContext

        t, part, seen = tokenizer(vocabulary, False), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches(it):
            ids, counts = with_end(*t.encode(b["text"]), end_id)
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = np.repeat(np.cumsum(counts) - counts, pieces) + start
            raw = memoryview(ids.astype("<u4").tobytes())
            slices = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(ordered)) - first
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            out = {
                "doc_id": b["doc_id"].take(pa.array(row)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(x) for x in slices], pa.int64()),
                "part": pa.array(np.full(len(row), part, np.int32)),
                "nth": pa.array(nth),
            }
            if keep_ids:
                out["ids"] = pa.array([bytes(x) for x in slices], pa.binary())
            yield pa.record_batch(out)

    return text_rows(docs, id_col, text_col).mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """[(times, lengths of one sequence)] that uses every length exactly as often as counted.

    Steps are bounded by the number of distinct lengths, not by the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[int, tuple[int, ...]]] = []

    def consume(*lengths: int) -> None:
        uses = defaultdict(int)
        for n in lengths:
            uses[n] += 1
        times = min(int(left[n]) // k for n, k in uses.items())
        if times:
            out.append((times, lengths))
            for n, k in uses.items():
                left[n] -= k * times

    def mates(gap: int, below: int) -> np.ndarray:
        """x of every pair x >= y, x + y == gap, whose lengths are both at hand."""
        if gap < 2:
            return np.zeros(0, np.int64)
        x = np.arange(-(-gap // 2), min(gap - 1, below) + 1)
        return x[(left[x] > 0) & (left[gap - x] > 0)]

    consume(capacity)
    for a in range(capacity - 1, 0, -1):  # single complements
        if left[a] and 2 * a >= capacity:
            consume(a, capacity - a)
    for a in range(capacity - 1, 0, -1):  # pair sums
        if left[a]:
            for x in mates(capacity - a, a)[::-1].tolist():
                consume(a, x, capacity - a - x)
                if not left[a]:
                    break
    for a in range(capacity - 1, 0, -1):  # triple sums
        gap = capacity - a
        for x in range(min(a, gap - 2), -(-gap // 3) - 1, -1) if left[a] else ():
            if left[x]:
                for y in mates(gap - x, x)[::-1].tolist():
                    consume(a, x, y, gap - x - y)
                    if not left[a] or not left[x]:
                        break
                if not left[a]:
                    break

    # best fit: open sequences by gap, each an (entries, times) group
    open_by_gap: dict[int, list[list]] = defaultdict(list)
    gaps: list[int] = []  # sorted

    def opened(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if not open_by_gap[gap]:
            bisect.insort(gaps, gap)
        open_by_gap[gap].append([lengths, times])

    for n in range(capacity, 0, -1):
        c = int(left[n])
        while c:
            i = bisect.bisect_left(gaps, n)
            if i == len(gaps):
                per = capacity // n  # fresh sequences, each filled with as many of n as fit
                if c >= per:
                    opened(capacity - per * n, (n,) * per, c // per)
                    c %= per
                else:
                    opened(capacity - c * n, (n,) * c, 1)
                    c = 0
                continue
            gap = gaps[i]
            group = open_by_gap[gap][-1]
            times = min(c, group[1])
            group[1] -= times
            if not group[1]:
                open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    gaps.pop(i)
            opened(gap - n, (*group[0], n), times)
            c -= times
    for gap in open_by_gap:
        out += [(times, lengths) for lengths, times in open_by_gap[gap]]
    return out


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (first ranks, first sequence, offset) of each slot, in order of rank."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for n in lengths:
            found[n].append((rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in found.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (staged: it is read three times) with sequence_id and offset.

    The driver gets one count per length.  Ranks within a length come from counts per task and
    length, so no task meets all pieces of a length.
    """
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    per_task = staged(per_task, "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length = slots(plan_packing(histogram, capacity))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_task.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"])
    kept = [c for c in pieces.columns if c not in ("part", "nth")]

    def deal(it):
        for b in batches(it):
            length = b["length"].to_numpy()
            rank = b["nth"].to_numpy() + b["before"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                firsts, sequences, places = by_length[int(length[rows[0]])]
                k = np.searchsorted(firsts, rank[rows], "right") - 1
                sequence[rows] = sequences[k] + rank[rows] - firsts[k]
                offset[rows] = places[k]
            yield pa.record_batch({**{c: b[c] for c in kept}, "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(deal, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in order (packed with keep_ids) and the pieces it is made of."""
    entry = F.struct("offset", "doc_id", "piece", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    ids = F.aggregate("entries", F.lit(b"").cast("binary"), lambda a, e: F.concat(a, e["ids"]))
    return rows.select(
        "sequence_id",
        F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["length"]).alias("length"),
        ids.alias("ids"),
        F.transform("entries", lambda e: F.struct(e["doc_id"].alias("doc_id"), e["piece"].alias("piece"), e["offset"].alias("offset"))).alias("pieces"),
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = staged(make_pieces(docs, vocabulary_path("word_bpe_49k.json"), end_id=0), "pieces")
    return pack(pieces)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
