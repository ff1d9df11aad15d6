"""Hand-made graphs whose results are known."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.functions import dims, parsing, scalar
from lattica.operators import extract, graph, security, splits
from lattica.sources.staging import staged


def frames(spark, types, edges, arch=1):
    nodes = [(arch, i, n, t) for i, (n, t) in enumerate(types)]
    rows = [(arch, i, *e) for i, e in enumerate(edges)]
    return spark.createDataFrame(nodes, "arch_id long, pos long, node_id string, node_type string"), spark.createDataFrame(rows, "arch_id long, pos long, source string, target string, label string")


def services(names, *pairs):
    return [(n, "service") for n in names], [(a, b, "HTTP") for a, b in pairs]


@pytest.mark.parametrize(
    ("names", "pairs", "connected", "orphan"),
    [("abcd", ["ab", "cd"], False, False), ("abc", ["ab"], False, True), ("abc", ["ab", "cc"], False, False), ("ab", ["ab"], True, False), ("ab", [], False, True)],
)
def test_connectivity(spark, names, pairs, connected, orphan):
    r = graph.connectivity(*frames(spark, *services(names, *pairs))).first()
    assert (r["connected"], r["has_orphan"], r["structurally_weak"]) == (connected, orphan, orphan or not connected)


def test_issues(spark):
    types = [("a", "service"), ("a", "ui"), ("b", "foo")]
    edges = [("a", "a", "HTTP"), ("a", "b", "HTTP"), ("a", "b", "Async"), ("a", "z", "HTTP"), ("b", "a", "XYZ")]
    rules = [(r["rule"], r["severity"][0]) for r in graph.issues(*frames(spark, types, edges)).collect()]
    assert sorted(rules) == sorted([("unsupported_node_type", "e"), ("node_id_collision", "e"), ("self_loop", "w"), ("duplicate_edge", "w"), ("dangling_edge", "e"), ("unsupported_edge_label", "w")])


def test_assessment(spark):
    n, e = frames(spark, [("web-ui", "ui"), ("api", "service"), ("orders-db", "database")], [("web-ui", "api", "HTTP"), ("api", "orders-db", "DB Query")])
    a = security.assessment(n)
    r = a.first()
    assert r["missing"] == ["API Gateway", "Audit Logging", "Authentication", "Encryption Service", "Monitoring", "RBAC", "WAF"]
    assert (r["score"], r["risk"], r["surface_score"], r["public_endpoints"], r["services"], r["databases"]) == (5, "HIGH", 35, 2, 1, 1)
    found = {t["threat"]: t["control"] for t in security.threats(a).collect()}
    assert len(found) == 11 and found["DDoS"] == "API Gateway"
    hit = security.node_threats(n, security.threats(a)).where("control = 'API Gateway'").select("node_id").distinct().collect()
    assert [x[0] for x in hit] == ["api"]
    assert security.edge_threats(n, e, security.threats(a)).where("control = 'API Gateway'").select("edge").distinct().count() == 2


def test_control_both_present_and_missing(spark):
    r = security.assessment(frames(spark, [("x-encryption", "service"), ("db", "database")], [])[0]).first()
    assert "Encryption Service" in r["missing"] and "Encryption Service" in r["required"]


def test_canonical_ids(spark):
    n, e = frames(spark, [("z", "service"), ("a", "service"), ("web", "ui"), ("db", "database")], [("web", "z", "HTTP"), ("z", "db", "DB Query"), ("web", "a", "HTTP")])
    ids = {r["node_id"]: r["new_id"] for r in graph.canonical_ids(n).collect()}
    assert ids == {"db": "database-1", "a": "service-1", "z": "service-2", "web": "ui-1"}
    assert sorted((r["source"], r["target"]) for r in graph.canonicalize(n, e)[1].collect()) == [("service-2", "database-1"), ("ui-1", "service-1"), ("ui-1", "service-2")]


DIAGRAMS = [
    ("WebUI[Web UI] -->|HTTPS| APIGW[API Gateway]\nAPIGW --> DB[(Orders DB)]", {"WebUI": "ui", "APIGW": "service", "DB": "database"}, [("WebUI", "APIGW", "HTTP"), ("APIGW", "DB", "HTTP")]),
    ("A -- sends query --> B", {"A": "service", "B": "service"}, [("A", "B", "DB Query")]),
    ("A & B --> C", {"B": "service", "C": "service"}, [("B", "C", "HTTP")]),
    ("A{Choice} --> B", {"A": "service"}, []),
    ("A --> B --> C", {"A": "service", "B": "service", "C": "service"}, [("A", "B", "HTTP"), ("B", "C", "HTTP")]),
    ("A-->B[x]", {"A": "service", "B": "service", "A--": "service"}, [("A", "B", "HTTP")]),
    ("A --> A", {"A": "service"}, []),
    ("subgraph S[Zone]\nA --> B\nend", {"A": "service", "B": "service"}, [("A", "B", "HTTP")]),
    ("%% note\nclassDef x fill:#fff\nA --> B %% tail", {"A": "service", "B": "service"}, [("A", "B", "HTTP")]),
]


def listed(row):
    return {n["id"]: n["type"] for n in row["nodes"]}, [tuple(e) for e in row["edges"]]


def test_diagrams(spark):
    rows = spark.createDataFrame([(i, "flowchart LR\n" + d[0]) for i, d in enumerate(DIAGRAMS)], "i int, t string")
    for r in parsing.with_diagram(rows, "t").collect():
        assert listed(r) == DIAGRAMS[r["i"]][1:] and r["error"] is None


def test_arrow_sources():
    assert parsing.arrows('A["x --> y"] -->|a --> b| B') == [("x", "y", ""), ("A", "B", "a --> b"), ("a", "b", "")]
    assert parsing.arrows("A--->B") == [] and parsing.arrows("web-1--xdb") == [("web-1", "db", "")]


@pytest.mark.parametrize(("text", "error"), [("sequenceDiagram\nA->>B: hi", parsing.OTHER_DIAGRAM), ("flowchart LR;\nA --> B", parsing.NO_HEADER), ("", parsing.NO_TEXT), ("  \n", parsing.NO_TEXT), (None, parsing.NO_TEXT)])
def test_no_diagram(spark, text, error):
    r = parsing.with_diagram(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert r["error"] == error and not r["nodes"] and not r["edges"]


def test_prose_before_header(spark):
    r = parsing.with_diagram(spark.createDataFrame([("Here is it\nflowchart LR\nA --> B",)], "t string"), "t").first()
    assert [n["id"] for n in r["nodes"]] == ["Here", "is", "it", "A", "B"]


def test_payload(spark):
    dirty = {"nodes": [{"id": " a ", "type": "service"}, {"id": "a", "type": "ui"}, {"id": "b", "type": "foo"}], "edges": [["a", "a"], ["a", " b"], {"from": "a", "to": "b", "protocol": "sql"}, {"source": "a", "target": "z"}, {"source": None, "from": "b", "target": "a", "label": "XYZ"}]}
    chain = lambda n, m: {"nodes": [f"n{i}" for i in range(n)], "edges": [[f"n{i % n}", f"n{(i * 3 + 1 + i // n) % n}"] for i in range(m)]}
    cases = [
        (dirty, None), ({"nodes": {}, "edges": []}, parsing.NOT_LISTS), ({"nodes": [], "edges": []}, parsing.NOTHING_LISTED), ({"nodes": ["a", {"id": 5}], "edges": [["a", "b"]]}, parsing.NODE_WITHOUT_ID),
        ({"nodes": ["a" * 65], "edges": [["a", "b"]]}, parsing.LONG_ID), (chain(11, 10), parsing.TOO_MANY_NODES), ({"nodes": ["a"], "edges": [["a"]]}, parsing.EDGE_WITHOUT_ENDS), ({"nodes": ["a"], "edges": [[1, "a"]]}, parsing.EDGE_WITHOUT_ENDS),
        ({"nodes": [f"n{i}" for i in range(9)], "edges": [[f"n{i}", f"n{j}"] for i in range(9) for j in range(2)]}, parsing.TOO_MANY_EDGES), ({"nodes": ["a"], "edges": [["a", "b"]]}, parsing.NO_EDGE), ({"nodes": ["a"]}, parsing.NO_OBJECT),
    ]
    rows = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: r for r in parsing.with_payload(rows, "t").collect()}
    assert {i: r["error"] for i, r in got.items()} == {i: c[1] for i, c in enumerate(cases)}
    assert listed(got[0]) == ({"a": "service", "b": "service"}, [("a", "b", "HTTP"), ("b", "a", "HTTP")])
    free = {r["i"]: r for r in parsing.with_payload(rows, "t", limits=False).collect()}
    assert len(free[5]["nodes"]) == 11 and len(free[8]["edges"]) == 16


def test_json_in_prose():
    text = 'x {"a": 1} ```json\n{"nodes": [], "edges": []}``` y'
    assert parsing.find_object(text) == {"nodes": [], "edges": []}
    assert parsing.find_object('{"nodes": ["http://x"], // why\n "edges": ["a",],}', comments=True) == {"nodes": ["http://x"], "edges": ["a"]}
    assert parsing.find_object("{nope") is None and parsing.find_object('{"nodes":' + "[" * 100_000) is None


def test_labels_and_types(spark):
    rows = spark.createDataFrame([("HTTPS",), ("sends query",), ("event api",), ("restore",), ("foo",), (None,)], "x string")
    assert [r[0] for r in rows.select(scalar.normal_label(rows["x"])).collect()] == ["HTTP", "DB Query", "HTTP", "HTTP", None, None]
    raw = spark.createDataFrame([("",), ("no braces",), ('{"nodes":[',), ('{"a":1}',), (None,)], "x string")
    assert [r[0] for r in raw.select(scalar.parse_failure(raw["x"])).collect()] == ["EMPTY_OUTPUT", "NO_JSON", "INCOMPLETE_JSON", "OTHER_PARSE", "EMPTY_OUTPUT"]
    kinds = spark.createDataFrame([(" DB ", "x"), ("component", "kafka-1"), (None, "zzz"), ("ui", "db")], "t string, i string")
    assert [r[0] for r in kinds.select(scalar.normal_type(kinds["t"], kinds["i"])).collect()] == ["database", "queue", "service", "ui"]


def test_instruction(spark):
    r = spark.createDataFrame([("Media", "CQRS", "AWS", ["A", "B"]), (None, "", None, [])], "d string, s string, c string, x array<string>")
    out = [x[0] for x in r.select(scalar.instruction(*map(F.col, "dscx"))).collect()]
    assert out == ["Design a Media architecture. using a CQRS style. deployed on AWS. satisfying: A, B.", "."]


def test_extraction_bounds():
    nodes = [{"id": f"api-{i:02}", "type": "service"} for i in range(30)] + [{"id": "orders-db", "type": "database"}, {"id": "vault", "type": "service"}]
    edges = [{"source": f"api-{i:02}", "target": f"api-{j:02}", "label": "HTTP"} for i in range(30) for j in (i + 1, i + 2) if j < 30]
    edges += [{"source": "api-29", "target": "orders-db", "label": "DB Query"}, {"source": "api-04", "target": "vault", "label": "HTTP"}]
    chosen, kept, reason = extract.grow(nodes, edges)
    assert reason is None and len(chosen) == dims.MAX_NODES and len(set(chosen)) == 10 and len(kept) <= dims.MAX_EDGES
    assert extract.grow(nodes[:1], edges)[2] == "insufficient_nodes"
    assert extract.grow(nodes, [])[2] == "no_edges"
    assert extract.grow(nodes + nodes[:1], edges)[2] == "duplicate_node_ids"
    assert extract.grow(nodes[:2], [{"source": "api-00", "target": "api-00", "label": "HTTP"}])[2] == "component_too_small"
    dense = [{"source": a["id"], "target": b["id"], "label": "HTTP"} for a in nodes[:10] for b in nodes[:10] if a["id"] < b["id"]]
    chosen, kept, reason = extract.grow(nodes[:10], dense)
    assert reason is None and len(chosen) == 10 and len(kept) == 15
    joined = {chosen[0]}
    for _ in range(10):
        joined |= {x for e in kept for x in (e["source"], e["target"]) if {e["source"], e["target"]} & joined}
    assert joined == set(chosen)


def test_records_and_their_checks(spark):
    parents = spark.createDataFrame([(1, [("web", "ui"), ("api", "service"), ("db", "database")], [("web", "api", "HTTP"), ("api", "db", "DB Query")]), (2, [("a", "service")], []), (3, None, [])], "arch_id long, nodes array<struct<id:string,type:string>>, edges array<struct<source:string,target:string,label:string>>")
    reasons = {r["arch_id"]: r["reason"] for r in extract.extract(parents).collect()}
    assert reasons == {1: None, 2: "insufficient_nodes", 3: "malformed_record"}
    made = extract.records(parents)
    r = made.first()
    assert r["id"] == "1#S1" and r["provenance"]["selected_edge_ids"] == ["web->api[HTTP]", "api->db[DB Query]"] and r["provenance"]["contract"]["max_nodes"] == 10
    assert r["security"]["security_score"] == r["security"]["security_score"] and {t["name"] for t in r["security"]["threats"]} and r["security"]["security_summary"].startswith("Architecture contains a frontend, an API service and a database but lacks")
    assert [x["problems"] for x in extract.verify(made, parents).collect()] == [[]]
    unlinked = made.withColumn("edges", F.slice("edges", 1, 1))
    assert [x["problems"] for x in extract.verify(unlinked, parents).collect()] == [["disconnected", "provenance_edge_ids", "provenance_edge_ratio"]]


def test_records_are_joined_by_shuffle(spark):
    """Staged files are small, their rows are not: no join of records or of their checks sends a table through the driver."""
    parents = staged(spark.createDataFrame([(1, [("web", "ui"), ("db", "database")], [("web", "db", "HTTP")])], "arch_id long, nodes array<struct<id:string,type:string>>, edges array<struct<source:string,target:string,label:string>>"), "parents")
    made = extract.records(parents)
    checked = extract.verify(made, parents)
    assert made.first()["security"]["node_threats"] and [x["problems"] for x in checked.collect()] == [[]]
    for df in (made, checked):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_late_rejections(spark):
    nodes = [("web", "ui"), ("api", "odd")]
    g = spark.createDataFrame([(1, nodes, [("web", "api", "HTTP")])], "arch_id long, nodes array<struct<id:string,type:string>>, edges array<struct<source:string,target:string,label:string>>")
    assert extract.extract(g).first()["reason"] == "contract_violation:unsupported_node_type"


def test_command_line(capsys):
    from lattica.__main__ import main

    assert main([]) == 0 and "gr9_components" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["unknown", "/nowhere"])


def test_split_fold():
    dealt = splits.deal([(1, 1, 20)])
    assert [(r[2], r[3], splits.SPLITS[r[4]]) for r in dealt] == [(1, 1, "test"), (2, 2, "validation"), (3, 20, "train")]
    assert splits.deal([(1, 2, 3)], [0.9, 0.05, 0.05])  # targets of zero are full


def test_split_totals(spark):
    rows = spark.createDataFrame([(i, f"c{i // 3}", i % 7 // 7) for i in range(300)], "id long, cluster string, tier int")
    out = splits.assign(rows, "cluster", "tier", "id")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(counts.values()) == 300 and abs(counts["train"] - 270) <= 3
    assert splits.straddling(out, "cluster").count() == 0
