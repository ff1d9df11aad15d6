"""Archives, the Jaccard join and neighbour search against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import ann, jaccard, warc
from lattica.llm.common import shared_path, staged
from lattica.llm.components import components


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(8):
        runs = [sorted(rnd.randrange(20) for _ in range(rnd.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.Blog.example.com:8080/A?x=1#top") == "com,example,blog)/a?x=1"
    assert warc.url_key("http://example.com") == "com,example)/"
    assert warc.url_key(None) == ""


def test_archives(spark):
    big, other = "<p>ä</p>" * 200, "x" * 999
    rows = [(1, "http://b.com/1", big), (2, "http://a.com/", big), (5, None, big), (3, "u", other), (4, "u", other), (6, "http://a.com/", None), (7, "http://a.com/", ""), (None, "n", big + "1"), (8, "http://a.com/", "a\r\n\r\nWARC/1.1\r\n" * 100)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = shared_path(spark, "w")
    warc.write_archives(pages, path)
    runs = staged(warc.capture_runs(spark, path), "r")
    merged = sorted(warc.merge_runs(runs).collect(), key=lambda r: (r["range_no"], r["place"]))
    assert len(merged) == len(rows)
    keys = [(r["urlkey"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in merged]
    assert keys == sorted(keys)
    for r in merged:
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if r["page_id"] in (1, 2) else ("response", None))
    blobs = {f["path"]: bytes(f["content"]) for f in spark.read.format("binaryFile").load(path).collect()}
    r = next(r for r in merged if r["page_id"] == 8)
    (record,) = list(warc.read_records(blobs[r["archive"]][r["record_offset"] : r["record_offset"] + r["record_bytes"]]))
    assert record[4].decode() == "a\r\n\r\nWARC/1.1\r\n" * 100 and record[3]["Content-Length"] == str(len(record[4]))
    assert record[2]["Content-Type"] == "application/http;msgtype=response" and record[2]["WARC-Target-URI"] == "http://a.com/"
    for blob in filter(None, blobs.values()):
        first = zlib.decompressobj(31).decompress(blob)
        assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        assert all("WARC-Target-URI" in h and h["WARC-Date"] for _, _, h, _, _ in warc.read_records(blob))
    assert next(r for r in merged if r["page_id"] == 5)["url"] is None
    assert warc.histories(warc.merge_runs(runs)).count() == len({r["urlkey"] for r in merged})


def test_empty_archives(spark):
    path = shared_path(spark, "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.merge_runs(staged(warc.capture_runs(spark, path), "r")).count() == 0


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, k, num, den):
    """Per row: doc_id, number of shingles, least doc_id of the rows that links reach."""
    sets = [shingles(r[1], k) for r in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if n * den >= (len(s) + len(sets[j]) - n) * num:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(docs):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(docs))


def found(rows):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows.collect())


def copies(seed):
    rnd = random.Random(seed)
    words, docs = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(300)], []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([5, 9, 10, 11, 14, 20, 40, 90, 200]))]
        for _ in range(rnd.choice([1, 2, 5, 25])):
            x = list(base)
            for _ in range(rnd.randrange(0, 1 + len(x) // 12)):
                p = rnd.randrange(len(x))
                x[p : p + 1] = rnd.choice([[], [rnd.choice(words)], [rnd.choice(words), x[p]]])
            docs.append((len(docs), rnd.choice([" ", "  ", "\n"]).join(x).upper().replace("É", "é") if rnd.random() < 0.3 else " ".join(x)))
    n = len(docs)
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "a"), (n + 4, "A"), (n + 5, "a b"), (n + 6, "a\x00b c d e " * 3000)]


#: Small bounds, so that a small table meets every case: by value or by unit, crowded values, several blocks and rounds.
BOUNDS = [{"BLOCK": 7, "FOLLOWERS": 5, "CROWD": 3, "FEW": 2, "UNIT": 0}, {"BLOCK": 7, "CROWD": 3, "FEW": 2, "HELD": 500, "BROADCAST_IDS": -1}, {"FEW": 2}]


@pytest.mark.parametrize(("k", "num", "den", "bounds"), [(3, 90, 100, BOUNDS[0]), (5, 80, 100, BOUNDS[1]), (5, 80, 100, BOUNDS[2])])
def test_jaccard(spark, monkeypatch, k, num, den, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(jaccard, name, value)
    docs = copies(k)
    docs += [(len(docs) - 1 - i, t) for i, t in docs[::7]] + [(None, t) for _, t in docs[::11]]  # repeated and null ids
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    assert found(jaccard.join_components(df, k, num, den)) == brute(docs, k, num, den)


def test_dense_group_takes_rounds(spark, monkeypatch):
    chosen = jaccard._to_test
    monkeypatch.setattr(jaccard, "_to_test", lambda u, labels, tested, c, per, num, den: chosen(u, labels, tested, c, per // 4 - 1, num, den))
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[:j] + [f"x{i}"] * e + base[j + e :])) for i, (j, e) in enumerate((j, e) for e in (1, 2, 4) for j in range(0, 54, 2))]
    assert found(jaccard.join_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80, 100)) == brute(docs, 3, 80, 100)


def test_leaders_cover_all():
    rng = np.random.default_rng(5)
    for n, p in [(2, 1), (9, 0.3), (40, 0.05), (60, 0.5)]:
        near = np.triu(rng.random((n, n)) < p, 1)
        near |= near.T
        pairs = np.array(jaccard._cover(near.copy())).reshape(-1, 2)
        assert near[pairs[:, 0], pairs[:, 1]].all()
        assert set(pairs.ravel()) == set(np.flatnonzero(near.any(axis=1))) and len(pairs) <= n


def test_packed_entries():
    rng = np.random.default_rng(3)
    for n in (1, 2, 500):
        key, other = rng.integers(0, 1 << 48, n, np.uint64), np.sort(rng.integers(-(1 << 62), 1 << 62, n))
        for wide in (False, True):
            k, o = jaccard._unpacked(jaccard._packed(key, other, wide), wide)
            assert (k == key).all() and (o == other).all()


def test_jaccard_odd_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text), (5, text), (None, text), (3, text + " thirteen"), (3, "something else entirely here"), (None, "all alone on this line"), (0, "all alone on this line at zero")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.join_components(df, 3, 80, 100)) == brute(rows, 3, 80, 100)
    assert jaccard.join_components(df.limit(0)).count() == 0 and jaccard.without_near_copies(df.limit(0)).count() == 0
    left = Counter((r["doc_id"], r["text"]) for r in jaccard.without_near_copies(df, 3).collect())
    assert left == Counter([(3, rows[3][1]), rows[4], rows[5], rows[6]])


@pytest.mark.parametrize("broadcast", [-1, 500_000])
def test_jaccard_repeated_ids_link(spark, monkeypatch, broadcast):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", broadcast)
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(5, x), (5, x), (5, y), (9, x), (12, x + " end"), (1, z), (1, "unlike all others here"), (7, z + " end"), (2, "alone among them"), (2, None), (None, y + " end"), (4, y + " end or not")]
    assert found(jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)) == brute(rows, 3, 90, 100)


def test_near_copies_by_row(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(1, x), (4, x + " end"), (4, "clean and alone"), (4, "clean and alone"), (6, y), (6, z), (7, None), (7, ""), (7, "seven"), (8, ""), (None, x), (9, z.upper()), (9, z)]
    more = spark.createDataFrame([(*r, 3, 4, 5) for r in rows], "doc_id long, text string, id int, text_hash int, component int")
    left = Counter((r["doc_id"], r["text"], r["id"], r["text_hash"], r["component"]) for r in jaccard.without_near_copies(more).collect())
    want = [(1, x), (4, "clean and alone"), (6, y), (6, z), (7, None), (7, ""), (7, "seven"), (8, "")]
    assert left == Counter((*r, 3, 4, 5) for r in want)


@pytest.mark.parametrize(("small", "num", "den"), [(100, 50, 100), (30, 25, 100), (160, 80, 100)])
def test_partners_of_distant_sizes_share_a_key(small, num, den):
    rng = np.random.default_rng(small)
    for large in range(small, small * den // num + 1):
        s = np.unique(rng.integers(0, 2**63, large, np.uint64))
        assert len(s) == large
        assert np.intersect1d(jaccard.signature(s, num, den), jaccard.signature(np.sort(rng.permutation(s)[:small]), num, den)).size or large == small


def test_jaccard_of_low_threshold(spark):
    words = [f"w{i}" for i in range(192)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:102])), (3, " ".join(words[100:140]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 50, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    with pytest.raises(ValueError):
        jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0, 100)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 80, np.uint64))
        b = np.unique(np.concatenate([a[:60], rng.integers(0, 2**63, 10, np.uint64)]))
        x, y = (np.frombuffer(jaccard.dense_sketch(s), np.uint8) for s in (a, b))
        assert np.unpackbits(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(139, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 100}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 16)) * 4
    x = (centres[rng.integers(0, 6, 1200)] + rng.standard_normal((1200, 16))).astype(np.float32)
    x[50:90] = x[50]  # copies
    rows = [(i, v.tolist(), 9) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [1.0, None] * 8, 0), (5400, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 100 = 0 OR vec_id = 55")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 1200, 100), 55}
    exact, hits = x.astype(np.float64), 0
    for q, found in got.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-9 for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len(set(best.tolist()) & {f[1] for f in found})
    assert sorted(v for _, v, _ in got[55]) == [*range(50, 55), *range(56, 61)][:10] or [v for _, v, _ in sorted(got[55])] == [50, 51, 52, 53, 54, 56, 57, 58, 59, 60]
    assert hits >= 0.9 * 10 * len(got)


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
