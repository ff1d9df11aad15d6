"""Exact n-gram Jaccard join by parity sketches.

A document's word shingles are dealt by hash to the chunks of a sketch, where XOR toggles them: a
shingle in one of two sets flips one place, so the sketches' Hamming distance is at most the
symmetric difference.  Sets of a size band whose similarity reaches the threshold differ in at most
d shingles; with d + 1 + s chunks at least s + 1 are toggled alike in both (pigeonhole), which is an
equi-join on (band, chunk, chunk value).  So each set may leave out its first s chunks in any order
that holds for all sets alike: it leaves out the thinnest, and after all were counted the values that
most sets have, such as those of a passage that many documents quote.

Values of few sets give pairs.  The sets of the others are cut into units (what those values connect,
or one value where that is large) and blocks, and compared by a dense sketch of the same kind, two to
four bits wide per shingle, which folds by XOR onto a narrower one.  A unit never gives all its
pairs: a few leaders that cover it are tested by whole texts first, links are closed to components,
and what still lies between components follows in the next round, until nothing is left to test.
So no link between components is lost.  Copies (equal sets) are one class.  Shingles are compared by
64-bit hashes.

Null or empty text has no shingles and no links.  Rows are judged one by one: a repeated id with
different texts takes part with each of them.  A component goes by its least id; a null id is never a
component's name unless all are null.  Repeated rows stay.  Very long texts are hashed in segments and
count whole.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, drop_staged, fresh, mix64, read_table, released, staged, text_rows, tune
from .components import components

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Bytes of text hashed at once.
SEGMENT = 1 << 18
#: Least bits of the dense sketch.
DENSE = 512
#: Key entries that a task holds before it sends them, entries of one key that it sends to the key's own range, and entries of a range.
HELD, CROWD, RANGE = 400_000, 64, 2_000_000
#: A key of so many classes at most gives its pairs at once.
FEW = 8
#: Ids and names of sets are broadcast up to so many (at most 40 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Classes of a block and of a unit that is not one key, and members of one leader compared in a task.
BLOCK, UNIT, FOLLOWERS = 2048, 1 << 16, 300

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = int(_BASE), pow(int(_BASE), -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, x, np.uint64)])) for x in (base, inverse))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's words begin.

    data: UTF-8 bytes of the texts in a row; bounds: where each text begins, and the end.
    """
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    starts = np.flatnonzero(solid & (first[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (first[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    out = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):  # segments of whole words
        stop = max(w + 1, int(np.searchsorted(ends, starts[w] + SEGMENT, "right")))
        low, high = starts[w], ends[stop - 1]
        power, inverse = _powers(max(SEGMENT, 1 << int(high - low - 1).bit_length()))
        term = (_LOWER[data[low:high]].astype(np.uint64) + _U(1)) * power[: high - low]
        term[_SPACE[data[low:high]]] = 0
        total = np.concatenate([[_U(0)], np.cumsum(term)])
        a, b = starts[w:stop] - low, ends[w:stop] - low
        out[w:stop] = mix64((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        w = stop
    return out, np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; shorter texts are one shingle."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    hashes, at = word_hashes(data, (offsets - offsets[0]).astype(np.int64))
    seeds = mix64(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | _U(1)
    rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        rolled += hashes[j : j + len(rolled)] * seeds[j]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix64((hashes[a:b] * seeds[: b - a]).sum(dtype=np.uint64, keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two sums over the set: equal sets have equal ones."""
    if not len(s):
        return 0, 0
    return tuple(int(mix64(s ^ _U(c)).sum(dtype=np.uint64).view(np.int64)) for c in (0x1B873593, 0xCC9E2D51))


@lru_cache(maxsize=1)
def _band_starts() -> list[int]:
    out = [1]
    while len(out) <= 128:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


def distance_bound(total: int, num: int, den: int) -> int:
    """Largest symmetric difference of two sets of `total` elements together whose Jaccard reaches num / den."""
    return total * (den - num) // (den + num)


def spares(d: int) -> tuple[int, int]:
    """Chunks beyond d + 1: how many a set may leave out as thin, and how many as common."""
    return (d + 1) // 8, (d + 1) // 5


def signature(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """64-bit keys, one for each (band, chunk, chunk value) under which the set can be met.

    A set enters its own band and every further one where a larger partner may be.  The low seven
    bits of a key are its band.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    starts, keys = _band_starts(), []
    own = bisect.bisect_right(starts, n) - 1
    for band in itertools.count(own):
        if band > own and n * den < starts[band] * num:
            break
        d = distance_bound(2 * (starts[band + 1] - 1), num, den)
        if not d:
            continue  # only equal sets qualify, and those are one class
        thin, common = spares(d)
        chunks = d + 1 + thin + common
        chunk = ((s >> _U(32)) * _U(chunks)) >> _U(32)
        order = np.argsort(chunk, kind="stable")
        counts = np.bincount(chunk.astype(np.int64), minlength=chunks)
        value = np.zeros(chunks, np.uint64)
        filled = counts > 0
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        value[filled] = np.bitwise_xor.reduceat(mix64(s[order]), at[filled])
        key = mix64(value + mix64(np.arange(chunks, dtype=np.uint64) + _U(band << 32))) >> _U(7) << _U(7) | _U(band)
        first = np.lexsort((key, counts))[:thin]
        use = np.ones(chunks, bool)
        use[first[counts[first] < 2]] = False
        keys.append(key[use])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def dense_sketch(s: np.ndarray) -> bytes:
    """Bits toggled by every shingle: the least power of two of at least twice as many as shingles."""
    width = max(DENSE, 1 << (2 * len(s) - 1).bit_length())
    bits = np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(bits).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of `size` bytes that the same shingles would have toggled."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)


def _few(df: DataFrame) -> DataFrame:
    """df to be broadcast, if it has no more than BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _signed(rows: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, text_hash, n, set_a, set_b, sketch."""

    def sign(it):
        for b in batches(it):
            sets = shingle_sets(b["text"], k)
            prints = [fingerprint(s) for s in sets]
            yield pa.record_batch(
                {
                    "doc_id": b["doc_id"],
                    "text_hash": b["text_hash"],
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "set_a": pa.array([p[0] for p in prints], pa.int64()),
                    "set_b": pa.array([p[1] for p in prints], pa.int64()),
                    "sketch": pa.array([dense_sketch(s) if len(s) else b"" for s in sets], pa.binary()),
                }
            )

    return rows.mapInArrow(sign, "doc_id long, text_hash long, n long, set_a long, set_b long, sketch binary")


def _packed(key: np.ndarray, other: np.ndarray, wide: bool) -> bytes:
    """Entries in order of other: their number, bytes of a step, first other, six or eight bytes of each key, steps."""
    step = np.diff(other.view(np.uint64))
    width = max(1, -(-int(step.max(initial=0)).bit_length() // 8))
    head = len(key).to_bytes(4, "little") + bytes([width]) + other[:1].tobytes()
    cut = lambda x, size: np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
    return head + cut(key, 8 if wide else 6) + cut(step, width)


def _unpacked(blob: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    n, width, size = int.from_bytes(blob[:4], "little"), blob[4], 8 if wide else 6
    key, step = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
    key[:, :size] = np.frombuffer(blob, np.uint8, n * size, 13).reshape(n, size)
    step[0] = np.frombuffer(blob, np.uint8, 8, 5)
    step[1:, :width] = np.frombuffer(blob, np.uint8, (n - 1) * width, 13 + n * size).reshape(n - 1, width)
    return key.reshape(-1).view(np.uint64), np.cumsum(step.reshape(-1).view(np.uint64)).view(np.int64)


def _counted(keys: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by key: where each key begins, its entries, and all columns."""
    order = np.lexsort((*rest[::-1], keys))
    keys, rest = keys[order], [c[order] for c in rest]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(keys))), keys, *rest


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b) with a < b, each once."""
    rows = np.concatenate(pairs)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[new & (rows[:, 0] < rows[:, 1])]


def _shared_keys(classes: DataFrame, total: int, k: int, num: int, den: int) -> DataFrame:
    """What classes share keys.  classes: id, set_a, set_b, text; total: shingles of all of them, about.

    Rows (role, key, a, b): 0, a class a of a key that b classes have, more than FEW; 1, a crowded key of b
    classes; 2, a class a of a crowded key; 3, classes a < b of a key of FEW at most (key is null).

    Keys are made here, from the texts once more, as they would take more room than anything else if they
    were kept.  They meet by range, as packed arrays, and a task holds one range at a time.  Of a key that
    many classes of a task have only the number goes to its range; those classes are spread over all.
    """
    spark = classes.sparkSession
    entries = total * (den - num) // max(1, den + num) * 6 + 1
    ranges = min(1 << 16, max(1024, 1 << (entries // RANGE).bit_length()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(ranges, entries * 9 >> 26))

    def combine(it):
        from pyspark import TaskContext

        held, size, spread = [], 0, TaskContext.get().partitionId()

        def emit(kind: int, bucket: np.ndarray, key: np.ndarray, other: np.ndarray):
            order = np.lexsort((other, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(ranges + 1))
            full, key, other = np.flatnonzero(np.diff(cuts)), key[order], other[order]
            for i in range(0, len(full), 256):
                some = full[i : i + 256]
                blobs = [_packed(key[cuts[p] : cuts[p + 1]], other[cuts[p] : cuts[p + 1]], kind == 2) for p in some.tolist()]
                yield pa.record_batch({"bucket": pa.array(some.astype(np.int32)), "kind": pa.array([kind] * len(some), pa.int32()), "blob": pa.array(blobs, pa.binary())})

        def flush():
            nonlocal spread
            keys = np.concatenate([x for x, _ in held])
            ids = np.repeat(np.array([i for _, i in held], np.int64), [len(x) for x, _ in held])
            begin, times, keys, ids = _counted(keys, ids)
            bucket = ((keys >> _U(48)) % _U(ranges)).astype(np.int64)
            keys = keys & _U((1 << 48) - 1) | bucket.astype(np.uint64) << _U(48)
            crowd = np.repeat(times > CROWD, times)
            yield from emit(0, bucket[~crowd], keys[~crowd], ids[~crowd])
            if crowd.any():
                heads = begin[times > CROWD]
                yield from emit(1, bucket[heads], keys[heads], times[times > CROWD])
                spread += 7919
                yield from emit(2, np.full(int(crowd.sum()), spread % ranges), keys[crowd], ids[crowd])

        for b in batches(it):
            for i, x, y, s in zip(*(b[c].to_pylist() for c in ("id", "set_a", "set_b")), shingle_sets(b["text"], k)):
                if fingerprint(s) != (x, y):
                    continue  # another text under a repeated id
                held.append((signature(s, num, den), i))
                size += len(held[-1][0])
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def rows(role: int, key, a, b):
        for i in range(0, len(b), 10_000):
            at = slice(i, i + 10_000)
            yield pa.record_batch({"role": pa.array([role] * len(b[at]), pa.int32()), "key": pa.nulls(len(b[at]), pa.int64()) if key is None else pa.array(key[at].view(np.int64)), "a": pa.array(a[at]), "b": pa.array(b[at])})

    def reduce(it):
        at, singles, crowds, pairs, size = None, [], [], [], 0

        def close():
            nonlocal pairs, size
            key, ids = (np.concatenate(c) for c in zip(*singles)) if singles else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            key |= _U(at << 48)
            begin, times, key, ids = _counted(key, ids)
            if crowds:
                crowd_key, many = (np.concatenate(c) for c in zip(*crowds))
                first, _, crowd_key, many = _counted(crowd_key | _U(at << 48), many)
                crowd_key, many = crowd_key[first], np.add.reduceat(many, first)
                place = np.minimum(np.searchsorted(key[begin], crowd_key), max(0, len(begin) - 1))
                here = key[begin][place] == crowd_key if len(begin) else np.zeros(len(crowd_key), bool)
                many[here] += times[place[here]]
                totals = times.copy()
                totals[place[here]] = many[here]
                yield from rows(1, crowd_key, many, many)
            else:
                totals = times
            large = np.repeat(totals > FEW, times)
            yield from rows(0, key[large], ids[large], np.repeat(totals, times)[large])
            for c in range(2, FEW + 1):
                group = ids[begin[(totals == c)][:, None] + np.arange(c)]
                for i, j in itertools.combinations(range(c), 2):
                    pairs.append(group[:, [i, j]])
                    size += len(group)
            if size > HELD:
                pairs = [_distinct(pairs)]
                size = len(pairs[0])
                if size > HELD // 2:
                    yield from rows(3, None, *pairs[0].T)
                    pairs, size = [], 0

        for b in batches(it):
            for bucket, kind, blob in zip(*(b[c].to_pylist() for c in ("bucket", "kind", "blob"))):
                if bucket != at:
                    if at is not None:
                        yield from close()
                    at, singles, crowds = bucket, [], []
                key, other = _unpacked(blob, kind == 2)
                if kind == 2:
                    yield from rows(2, key, other, other)
                else:
                    (crowds if kind else singles).append((key, other))
        if at is not None:
            yield from close()
        if size:
            yield from rows(3, None, *_distinct(pairs).T)

    packed = classes.select("id", "set_a", "set_b", "text").mapInArrow(combine, "bucket int, kind int, blob binary")
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, "role int, key long, a long, b long")


def _members(found: DataFrame, num: int, den: int) -> DataFrame:
    """(key, id): the large keys that each class keeps after it left out its most common ones."""
    crowded = found.where("role = 1").select("key", F.col("b").alias("n"))
    members = found.where("role = 0").select("key", F.col("a").alias("id"), F.col("b").alias("n"))
    members = members.unionByName(found.where("role = 2").select("key", F.col("a").alias("id")).join(_few(crowded), "key"))
    starts = _band_starts()
    common = F.array(*(F.lit(spares(distance_bound(2 * (x - 1), num, den))[1]) for x in starts[1:129]))
    place = F.dense_rank().over(Window.partitionBy("id", "band").orderBy(F.desc("n"), "key"))
    kept = members.withColumn("band", F.col("key").bitwiseAND(127).cast("int")).withColumn("place", place)
    return kept.where(F.col("place") > F.element_at(common, F.col("band") + 1)).select("key", "id").distinct()


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that sizes and dense sketches don't exclude."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"n_a * {den} >= n_b * {num} AND n_b * {den} >= n_a * {num}")

    def keep(it):
        for b in batches(it):
            apart = np.empty(b.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(b["s_a"].to_pylist(), b["s_b"].to_pylist())):
                size = min(len(x), len(y))
                apart[k] = _POP[folded(x, size) ^ folded(y, size)].sum(dtype=np.int64)
            total = b["n_a"].to_numpy() + b["n_b"].to_numpy()
            ok = apart <= total * (den - num) // (den + num)
            yield pa.record_batch({c: b[c].filter(pa.array(ok)) for c in "ab"})

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b, common, united) whose texts reach the threshold.  pairs: staged.

    A leader a meets its followers b in tasks of FOLLOWERS each; a task holds one leader's set.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("followers")).select(F.col("a"), F.ceil(F.col("followers") / FOLLOWERS).cast("int").alias("parts"))
    leaders = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("id"))
    followers = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("id"))
    wanted = staged(leaders.unionByName(followers).join(classes.select("id", "row", "text_hash", "set_a", "set_b"), "id"), "jaccard-wanted")
    ids = _few(wanted.select("row", "text_hash").distinct())
    parts = wanted.join(rows.join(ids, ["row", "text_hash"], "left_semi"), ["row", "text_hash"])
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.select("a", "part", "role", "id", "set_a", "set_b", "text").repartition(n, "a", "part").sortWithinPartitions("a", "part", "role")

    def compare(it):
        at, leader = None, None
        for b in batches(it):
            found = []
            for a, part, role, i, x, y, s in zip(*(b[c].to_pylist() for c in ("a", "part", "role", "id", "set_a", "set_b")), shingle_sets(b["text"], k)):
                if fingerprint(s) != (x, y):
                    continue  # another text under a repeated id
                if role == 0:
                    at, leader = (a, part), s
                elif at == (a, part):
                    common = len(np.intersect1d(leader, s, assume_unique=True))
                    united = len(leader) + len(s) - common
                    if common * den >= united * num:
                        found.append((a, i, common, united))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b", "common", "united"])

    return parts.mapInArrow(compare, "a long, b long, common long, united long")


def _units(members: DataFrame) -> DataFrame:
    """(unit, of_key, id, blocks): what the keys connect, or each key by itself where that is more than UNIT classes."""
    keys = members.groupBy("key").agg(F.min("id").alias("u"), F.count("*").alias("size")).where("size > 1")
    edges = members.join(keys, "key").select("u", F.col("id").alias("v"))
    groups = staged(components(edges), "jaccard-groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    sized = staged(groups.join(sizes, "component").select(F.col("node").alias("id"), "component", "size"), "jaccard-sizes")
    units = sized.where(f"size <= {UNIT}").select(F.col("component").alias("unit"), F.lit(False).alias("of_key"), "id", "size")
    large = sized.where(f"size > {UNIT}").select("id")
    if not large.isEmpty():
        units = units.unionByName(members.join(keys, "key").join(large, "id").select(F.col("key").alias("unit"), F.lit(True).alias("of_key"), "id", "size"))
    return staged(units.select("unit", "of_key", "id", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "jaccard-units")


def _adjacent(sizes: np.ndarray, sketches: list[bytes], groups: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets (of rising size, in different groups) may reach the threshold, by sizes and sketches."""
    out = np.zeros((len(sizes), len(sizes)), bool)
    widths = np.array([len(x) for x in sketches])
    levels = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
    for (v, left), (w, right) in itertools.combinations_with_replacement(sorted(levels.items()), 2):
        if sizes[left[-1]] * den < sizes[right[0]] * num:
            continue
        few = np.stack([np.frombuffer(sketches[i], np.uint64) for i in left])
        many = few if v == w else np.stack([folded(sketches[i], v).view(np.uint64) for i in right])
        low = np.searchsorted(sizes[right] * den, sizes[left] * num)
        high = np.searchsorted(sizes[right] * num, sizes[left] * den, "right")
        for i, bits, a, b in zip(left.tolist(), few, low.tolist(), high.tolist()):
            others = right[a:b]
            apart = np.bitwise_count(many[a:b] ^ bits).sum(axis=1, dtype=np.int64)
            near = others[(apart <= (sizes[others] + sizes[i]) * (den - num) // (den + num)) & (groups[others] != groups[i])]
            out[i, near] = out[near, i] = True
    return out


def _cover(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs in which each set that is near to any occurs, made by few leaders."""
    out, free, degree = [], near.any(axis=1), near.sum(axis=1)
    while free.any():
        lead = int(degree.argmax())
        if not degree[lead]:  # only near to sets that are covered
            return out + [(int(i), int(near[i].argmax())) for i in np.flatnonzero(free)]
        led = np.flatnonzero(near[lead] & free)
        out += [(lead, int(i)) for i in led]
        led = np.append(led, lead) if free[lead] else led
        free[led] = False
        degree -= near[:, led].sum(axis=1)
    return out


def _to_test(units: DataFrame, labels: DataFrame | None, tested: DataFrame | None, classes: DataFrame, per: int, num: int, den: int) -> DataFrame:
    """(a, b) of classes of a unit but different components that sketches don't exclude and that are not tested yet.

    Of a unit's block or two with more such pairs than `per` times its classes only leaders' pairs come,
    and a row with null a whose b is the unit.  Every two blocks of a unit meet in a task of their own.
    """
    named = units.withColumn("component", F.col("id"))
    if labels is not None:
        named = units.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    still = named.groupBy("unit", "of_key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("unit", "of_key")
    rows = named.join(still, ["unit", "of_key"]).join(classes.select("id", "n", "sketch"), "id")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    task = ["unit", "of_key", "x", "y"]
    rows = rows.withColumn("block", block("id")).withColumn("m", F.explode(meet)).select("unit", "of_key", "m.x", "m.y", F.lit(0).alias("role"), "block", "id", "component", "n", "sketch")
    if tested is not None:
        other = units.select("unit", "of_key", F.col("id").alias("b"))
        done = tested.join(units.withColumnRenamed("id", "a"), "a").join(other, ["unit", "of_key", "b"])
        done = done.select("unit", "of_key", F.least(block("a"), block("b")).alias("x"), F.greatest(block("a"), block("b")).alias("y"), F.lit(1).alias("role"), F.lit(0).alias("block"), F.col("a").alias("id"), F.col("b").alias("component"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("sketch"))
        rows = rows.unionByName(done)
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *task).sortWithinPartitions(*task, "role", "n", "id")

    def chosen(unit: int, own: bool, group: list, done: list):
        if len(group) < 2:
            return
        block, ids, comps, sizes = (np.array([r[c] for r in group], np.int64) for c in range(4))
        if (comps == comps[0]).all():
            return
        near = _adjacent(sizes, [r[4] for r in group], comps, num, den)
        if not own:
            near &= block[:, None] != block
        place = {i: at for at, i in enumerate(ids.tolist())}
        for a, b in done:
            if a in place and b in place:
                near[place[a], place[b]] = near[place[b], place[a]] = False
        if near.sum() <= 2 * per * len(group):
            pairs = np.argwhere(np.triu(near))
        else:
            pairs = np.array(_cover(near))
            yield None, unit
        for i, j in ids[pairs].tolist() if len(pairs) else ():
            yield min(i, j), max(i, j)

    def choose(it):
        at, group, done, found = None, [], [], []
        for b in batches(it):
            for unit, of_key, x, y, role, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (unit, of_key, x, y) != at:
                    if at is not None:
                        found += chosen(at[0], at[2] == at[3], group, done)
                    at, group, done = (unit, of_key, x, y), [], []
                if role:
                    done.append((row[1], row[2]))
                else:
                    group.append(row)
            if len(found) > 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
                found = []
        if at is not None:
            found += chosen(at[0], at[2] == at[3], group, done)
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return rows.mapInArrow(choose, "a long, b long").distinct()


def _linked(found: DataFrame, rows: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, component) of the classes that have links."""
    spark = rows.sparkSession
    members = staged(_members(found, num, den), "jaccard-members")
    units = _units(members)
    drop_staged(spark, members)
    few = staged(found.where("role = 3").select("a", "b").distinct(), "jaccard-few")
    small = _near(few, classes, num, den)
    labels = tested = edges = None
    for turn in itertools.count():
        chosen = staged(_to_test(units, labels, tested, classes, 4 << 3 * turn, num, den), "jaccard-chosen")
        pairs = chosen.where("a IS NOT NULL")
        pairs = staged(pairs.unionByName(small).distinct(), "jaccard-pairs") if not turn else pairs
        links = staged(_verified(pairs, rows, classes, k, num, den), "jaccard-links").select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = links if edges is None else edges.unionByName(links)
        labels = staged(components(edges), "jaccard-labels")
        released(spark)
        again = chosen.where("a IS NULL").select(F.col("b").alias("unit")).distinct()
        if again.isEmpty():
            return labels
        units = units.join(again, "unit", "left_semi")
        missed = pairs.join(links.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
        tested = missed if tested is None else tested.unionByName(missed)


def _joined(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """join_components() with text_hash and component, which tells apart components of the same name (null without shingles)."""
    if not 0 < num <= den:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    tune(spark)
    rows = text_rows(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    signed = staged(_signed(rows, k), "jaccard-signed", codec="lz4")
    rows = rows.withColumn("row", F.coalesce("doc_id", F.lit(0)))

    # ids that name several sets
    held = F.xxhash64("set_a", "set_b", "n")
    twice = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(held).alias("low"), F.max(held).alias("high")).where("low <> high").select("doc_id", F.lit(True).alias("twice"))
    full = signed.where("n > 0").join(_few(staged(twice, "jaccard-twice")), "doc_id", "left")
    full = full.withColumn("shared", F.col("twice").isNotNull() | F.col("doc_id").isNull()).withColumn("row", F.coalesce("doc_id", F.lit(0))).drop("twice")
    # a class is read from one of its rows, and goes by that row's id where this names no other set, else by a hash of the set
    by_set = full.groupBy("set_a", "set_b", "n").agg(F.min(F.struct("shared", "row", "text_hash")).alias("read"), F.min("doc_id").alias("class_id")).select("set_a", "set_b", "n", "class_id", "read.*")
    by_set = staged(by_set.withColumn("id", F.when(F.col("shared"), F.xxhash64("set_a", "set_b")).otherwise(F.col("row"))), "jaccard-classes")
    own = _few(by_set.select("set_a", "set_b", "row", "text_hash", "id"))
    small = staged(full.join(own, ["set_a", "set_b", "row", "text_hash"]).select("id", "row", "text_hash", "n", "set_a", "set_b", "sketch").dropDuplicates(["id"]), "jaccard-small")
    texts = rows.join(own, ["row", "text_hash"]).select("id", "set_a", "set_b", "text")
    total = small.agg(F.sum("n")).first()[0] or 0
    found = staged(_shared_keys(texts, total, k, num, den), "jaccard-found")
    released(spark)
    labels = _linked(found, rows, small, k, num, den)
    drop_staged(spark, found, small)

    named = by_set.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    if by_set.where("shared").isEmpty():  # classes go by their least id, and so do components
        named = named.withColumn("name", F.col("component"))
    else:
        names = named.groupBy("component").agg(F.min("class_id").alias("name"))
        named = named.join(names, "component")
    named = named.select("set_a", "set_b", "n", "class_id", "component", "name")
    out = signed.select("doc_id", "text_hash", "n", "set_a", "set_b").join(named, ["set_a", "set_b", "n"], "left")
    linked = F.col("component").isNotNull()
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "component", F.when(linked, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def join_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (least id of the equal sets), component_id (least id reachable by links)."""
    return _joined(docs, k, num, den, id_col, text_col).select("doc_id", "n_shingles", "class_id", "component_id")


def without_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row left of each component: one of the least id in it (a null id comes last).

    Rows are judged by their own text.  Rows without shingles stay.  Of equal rows of one id and text that
    differ in other columns only, one stays.
    """
    key, hashed, place = fresh(docs, "id", "text_hash", "place")
    named = _joined(docs, k, num, den, id_col, text_col).where("component IS NOT NULL").select("component", F.col("doc_id").alias(key), F.col("text_hash").alias(hashed))
    named = staged(named.groupBy("component", key, hashed).agg(F.count("*").alias("copies")), "jaccard-named")
    first = named.groupBy("component").agg(F.count("*").alias("several"), F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("i"), F.col(hashed).alias("h"))).alias("first"))
    judged = named.join(first, "component")
    stays = F.col(key).eqNullSafe(F.col("first.i")) & (F.col(hashed) == F.col("first.h"))
    gone = staged(judged.where("several > 1").where(~stays).select(key, hashed), "jaccard-gone")
    own, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    here = own.eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(hashed))
    rest = docs.join(_few(gone), here, "left_anti")
    twice = staged(judged.where("copies > 1").where(stays).select(key, hashed), "jaccard-repeated")
    if twice.isEmpty():
        return rest
    twice = _few(twice)
    order = F.row_number().over(Window.partitionBy(key, hashed).orderBy(F.col(f"`{text_col}`")))
    again = rest.join(twice, here).withColumn(place, order).where(F.col(place) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
    return rest.join(twice, here, "left_anti").unionByName(again)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100).drop("class_id")
