"""Readers, writers and incremental runs on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import stats
from lattica.plans import response
from lattica.sources import readers, writers
from lattica.streaming.incremental import append_new, run_available, windowed_counts


def test_tolerant_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "s": "a"}\n\n{"id": 2, "s"\n{"id": 3}\n')
    good, bad = readers.tolerant_lines(spark, str(tmp_path), "id BIGINT, s STRING")
    assert sorted((r["id"], r["s"]) for r in good.collect()) == [(1, "a"), (3, None)]
    assert [r[0] for r in bad.collect()] == ['{"id": 2, "s"']
    with pytest.raises(Exception, match="MALFORMED"):
        readers.strict_lines(spark, str(tmp_path), "id BIGINT, s STRING").collect()


def test_json_files(spark, tmp_path):
    for i in (2, 1):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": i}, indent=2))
    rows = readers.json_files(spark, str(tmp_path), "id BIGINT").orderBy("file").collect()
    assert [(r["id"], r["file"]) for r in rows] == [(1, "1.json"), (2, "2.json")]


def test_last_match(spark, tmp_path):
    (tmp_path / "a.log").write_text("loss=0.5\nloss=0.25\n")
    (tmp_path / "b.log").write_text("nothing")
    found = {r["file"]: r["found"] for r in readers.last_match(spark, str(tmp_path), r"loss=([0-9.]+)").collect()}
    assert found == {"a.log": "0.25", "b.log": None}


def test_manifest_scan(spark):
    shards = spark.createDataFrame([("r0", 1), ("r1", 2), ("r2", 3)], "range_id string, x int")
    manifest = spark.createDataFrame([("r0", "complete", "a", "a"), ("r1", "complete", "a", "b"), ("r2", "open", "a", "a")], "range_id string, status string, shard_sha256 string, observed_sha256 string")
    assert [r["x"] for r in readers.by_manifest(shards, manifest).collect()] == [1]


def test_shards(spark, tmp_path):
    df = spark.range(25).select("id", F.when(F.col("id") % 10 == 9, "odd one").alias("reason"), (F.col("id") * 2).alias("x"))
    m = {r["range_id"]: r for r in writers.write_shards(df, "id", 10, str(tmp_path), "reason").collect()}
    assert [(k, m[k]["records"], m[k]["skipped"]) for k in sorted(m)] == [("r0000", 9, 1), ("r0001", 9, 1), ("r0002", 5, 0)]
    assert spark.read.json(f"{tmp_path}/shards").count() == 23 and spark.read.json(f"{tmp_path}/rejected").count() == 2
    again = {r["range_id"]: r["shard_sha256"] for r in writers.manifest(writers.with_ranges(df.repartition(3), "id", 10), "id", "reason").collect()}
    assert again == {k: r["shard_sha256"] for k, r in m.items()}


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    for n in (1, 7):
        got = stats.numbered(df.repartition(n), ["k"]).orderBy("k").collect()
        assert [(r["k"], r["n"]) for r in got] == [(i, i + 1) for i in range(1000)]


def test_incremental(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    run = lambda: run_available(spark, str(source), "id BIGINT", lambda d: d.where("id > 0"), target, str(tmp_path / "check"))
    (source / "1.json").write_text('{"id": 1}\n{"id": -1}\n')
    run()
    (source / "2.json").write_text('{"id": 2}\n')
    run()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2]


def test_append_new(spark, tmp_path):
    target = str(tmp_path / "t")
    assert append_new(spark.range(3), target, "id") == 3
    assert append_new(spark.range(5), target, "id") == 2
    assert append_new(spark.range(5), target, "id") == 0
    assert spark.read.parquet(target).count() == 5


def test_windows_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("2024-01-01T01:00:00", "a"), ("2024-01-01T02:00:00", "a"), ("2024-01-03T00:00:00", "b")]
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps({"ts": t, "event_type": e}) for t, e in rows))
    stream = windowed_counts(spark.readStream.schema("ts TIMESTAMP, event_type STRING").json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["n"]) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]


def test_import(spark):
    text = '{"nodes": [{"id": "a"}, {"id": ""}, {"id": "b", "kind": "ui"}], "edges": [{"source": "a", "target": "b", "label": "Async"}, {"source": "a", "target": "z"}, {"source": "b", "target": "a", "label": "http"}]}'
    r = response.imported(spark.createDataFrame([(1, text), (2, "nope")], "i int, t string"), "t").orderBy("i").collect()
    assert [(n["id"], n["kind"]) for n in r[0]["nodes"]] == [("a", "service"), ("b", "ui")]
    assert [(e["source"], e["target"], e["label"]) for e in r[0]["edges"]] == [("a", "b", "Async"), ("b", "a", "HTTP")]
    assert r[1]["nodes"] == [] and r[1]["edges"] == []


def test_responses(spark):
    raw = [(1, 'x {"nodes": [{"id": "web", "type": "ui"}, {"id": "redis"}], "edges": [["web", "redis"]]} // y'), (2, "  "), (3, "no graph"), (4, None)]
    got = {r["arch_id"]: r for r in response.respond(spark.createDataFrame(raw, "i long, t string"), "i", "t").collect()}
    assert got[1]["error"] is None and got[1]["valid"] and not got[1]["structurally_weak"]
    assert [(n["icon"], n["layer"]) for n in got[1]["nodes"]] == [(None, "ui"), ("redis", "data")]
    assert got[2]["error"] == "no_text" == got[4]["error"] and got[3]["error"] == "no_object" == got[3]["detail"]["message"] and got[3]["valid"] is None
    assert {i: r["status"] for i, r in got.items()} == {1: 200, 2: 400, 3: 422, 4: 400}


def test_variants(spark):
    response.VARIANTS.clear()
    response.variant("up")(lambda d: d.select(F.upper("s").alias("s")))
    response.variant("as is")(lambda d: d)
    out = response.all_variants(spark.createDataFrame([("a",)], "s string"))
    assert sorted((r["variant"], r["s"]) for r in out.collect()) == [("as is", "a"), ("up", "A")]
