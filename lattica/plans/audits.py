"""Registered queries of gates, audits, security records, sources and hooks, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lattica.functions import dims, parsing, scalar
from lattica.operators import extract, graph, security, splits, stats
from lattica.plans import gates
from lattica.plans.registry import _ASSESS, _BAD, _CC, _LISTED, _NODE_THREATS, _RISK, _SCORES, _THREATS, _bad_graph, _docs, _listed, _nested_events, query
from lattica.plans.views import EG, SG, _sql_first, event_graph, security_graph, table
from lattica.sources import readers, writers
from lattica.sources.staging import shared_path, staged

# ---------------------------------------------------------------- security records

_ENGLISH = "CASE len({x}) WHEN 0 THEN '' WHEN 1 THEN {x}[1] ELSE array_to_string({x}[1:-2], ', ') || ' and ' || {x}[-1] END"
_PARTS = ", ".join(f"CASE WHEN bool_or(regexp_matches(t, '{w}')) THEN '{k}' END" for k, w in dims.SUMMARY_PARTS.items())
_SUMMARY = f"""
part AS (SELECT arch_id, list_filter([{_PARTS}], lambda x: x IS NOT NULL) AS parts FROM (SELECT arch_id, lower('{{''id'': ''' || node_id || ''', ''type'': ''' || node_type || '''}}') AS t FROM nodes) GROUP BY 1),
said AS (SELECT arch_id, score, {_RISK} AS risk, 'Architecture contains ' || CASE WHEN len(parts) = 0 THEN 'various components' ELSE {_ENGLISH.format(x="parts")} END || CASE WHEN len(missing) > 0
  THEN ' but lacks ' || {_ENGLISH.format(x="missing")} || '. Overall security posture is ' || {_RISK} || ' RISK and ' || CASE WHEN {_RISK} IN ('HIGH', 'MEDIUM') THEN 'requires immediate remediation.' ELSE 'is acceptable.' END
  ELSE ' and meets all baseline security requirements. Overall security posture is ' || {_RISK} || ' RISK.' END AS summary FROM assessed JOIN part USING (arch_id))
"""


@query(f"WITH {SG}, {_ASSESS}, {_SUMMARY} SELECT * FROM said")
def sr9_pr23_summaries(spark, d):
    return security.assessment(security_graph(spark, d)[0]).select("arch_id", "score", "risk", "summary")


@query(f"""WITH {SG}, {_ASSESS}, {_THREATS}, {_NODE_THREATS}, {_SUMMARY},
et AS (SELECT DISTINCT e.arch_id, source||'->'||target AS edge, threat FROM edges e JOIN nt ON nt.arch_id = e.arch_id AND (nt.node_id = source OR nt.node_id = target)),
a AS (SELECT arch_id, string_agg(threat, ',' ORDER BY threat) AS threats FROM found GROUP BY 1), b AS (SELECT arch_id, string_agg(node_id||'='||n, ' ' ORDER BY node_id) AS nodes FROM (SELECT arch_id, node_id, count(*) AS n FROM nt GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT arch_id, string_agg(edge||'='||n, ' ' ORDER BY edge) AS edges FROM (SELECT arch_id, edge, count(*) AS n FROM et GROUP BY 1, 2) GROUP BY 1)
SELECT arch_id, s.score, s.risk, s.summary, coalesce(threats, '') AS threats, coalesce(nodes, '') AS nodes, coalesce(edges, '') AS edges FROM said s LEFT JOIN a USING (arch_id) LEFT JOIN b USING (arch_id) LEFT JOIN c USING (arch_id)""")
def sr9_security_records(spark, d):
    """SR9: the assembled record of every graph; threats by graph, node and edge."""
    r = security.records(*security_graph(spark, d)).select("arch_id", "security.*")
    count = lambda c, key: F.array_join(F.transform(c, lambda x: F.concat(x[key], F.lit("="), F.size(x["threats"]).cast("string"))), " ")
    names = F.array_join(F.array_sort(F.transform("threats", lambda t: t["name"])), ",")
    return r.select("arch_id", F.col("security_score").alias("score"), F.col("risk_level").alias("risk"), F.col("security_summary").alias("summary"), names.alias("threats"), count("node_threats", "node").alias("nodes"), count("edge_threats", "edge").alias("edges"))


@query(f"WITH {SG}, {_ASSESS}, {_THREATS}, {_NODE_THREATS}, et AS (SELECT DISTINCT e.arch_id, source||'->'||target AS edge, threat FROM edges e JOIN nt ON nt.arch_id = e.arch_id AND (nt.node_id = source OR nt.node_id = target)) SELECT arch_id, edge, count(threat) AS threats FROM (SELECT arch_id, source||'->'||target AS edge FROM edges) LEFT JOIN et USING (arch_id, edge) GROUP BY 1, 2")
def jo17_all_edges(spark, d):
    """JO17: edges without threats stay."""
    n, e = security_graph(spark, d)
    return security.edge_threats(n, e, security.threats(security.assessment(n)), keep_all=True).groupBy("arch_id", "edge").agg(F.count("threat").alias("threats"))


@query(f"WITH {SG} SELECT DISTINCT node_id, {_sql_first('lower(node_id)', {w: w for w in dims.ICONS}, 'NULL')} AS icon, CASE node_type WHEN 'ui' THEN 'ui' WHEN 'database' THEN 'data' WHEN 'cache' THEN 'data' ELSE 'service' END AS layer FROM (SELECT node_id, node_type FROM nodes UNION ALL SELECT 'orders-postgres', 'database' UNION ALL SELECT 'Docker-host', 'container')")
def pr16_icons(spark, d):
    more = spark.createDataFrame([("orders-postgres", "database"), ("Docker-host", "container")], "node_id string, node_type string")
    n = security_graph(spark, d)[0].select("node_id", "node_type").unionByName(more)
    return n.select("node_id", scalar.icon(F.col("node_id")).alias("icon"), scalar.layer(F.col("node_type")).alias("layer")).distinct()


@query(f"WITH {EG} SELECT arch_id, source, target, label = 'Async' AS dashed, CASE WHEN arch_id % 2 = 0 THEN 'Cache' ELSE label END AS label FROM edges")
def pr11_pr16_labels_at_hand(spark, d):
    """PR11: a label at hand wins over the types; PR16: dashed lines."""
    n, e = event_graph(spark, d)
    typed = graph.proper_edges(n, e)
    given = F.when(F.col("arch_id") % 2 == 0, "REDIS").when(F.col("arch_id") % 3 == 0, "unheard of")
    return typed.select("arch_id", "source", "target", scalar.dashed(F.col("label")).alias("dashed"), scalar.infer_label(F.col("source_type"), F.col("target_type"), given).alias("label"))


# ---------------------------------------------------------------- records and gates

_K = "arch_id % 8"


def _tampered(spark, d):
    """(records, parents): event graphs as records of themselves, seven of eight damaged in a known way."""
    p = _nested_events(spark, d).where(F.size("edges") > 0)
    k, one = F.col("arch_id") % 8, F.col("arch_id").cast("string")
    made = dict(zip(extract.PROVENANCE, (one, one, F.lit(extract.METHOD), F.when(k != 7, extract.VERSION), F.transform("nodes", lambda n: n["id"]), extract.edge_keys(F.col("edges")), F.when(k == 5, 0.5).otherwise(F.lit(1.0)), F.lit(1.0))))
    ghost = F.array(F.struct(F.lit("ghost").alias("id"), F.lit("service").alias("type")))
    other = lambda n: F.struct(n["id"].alias("id"), F.when(n["type"] == "cache", "ui").otherwise("cache").alias("type"))
    nodes = F.when(k == 1, F.concat("nodes", ghost)).when(k == 2, F.concat(F.transform(F.slice("nodes", 1, 1), other), F.expr("slice(nodes, 2, size(nodes))"))).otherwise(F.col("nodes"))
    first = F.slice("edges", 1, 1)
    lost = F.transform(first, lambda e: F.struct(e["source"].alias("source"), F.lit("nowhere").alias("target"), e["label"].alias("label")))
    edges = F.when(k == 3, F.concat("edges", first)).when(k == 6, F.concat("edges", lost)).otherwise(F.col("edges"))
    security_part = F.struct(*(F.lit("x").alias(s) for s in extract.SECURITY))
    records = p.select(F.concat(one, F.lit("#S1")).alias("id"), F.when(k == 4, "none").otherwise(one).alias("parent_id"), nodes.alias("nodes"), edges.alias("edges"), F.struct(*(c.alias(n) for n, c in made.items())).alias("provenance"), security_part.alias("security"))
    return records, p


@query(f"""WITH {EG}, {_LISTED}, c AS (SELECT *, {_K} AS k, n + ({_K} = 1)::INT AS nn, m + ({_K} IN (3, 6))::INT AS mm FROM s WHERE m > 0)
SELECT arch_id || '#S1' AS id, array_to_string(list_sort(list_filter([CASE WHEN nn > 10 OR mm > 15 OR k = 6 THEN 'contract_violation' END, CASE WHEN k = 1 THEN 'fabricated_node' END, CASE WHEN k = 2 THEN 'node_value_mismatch' END, CASE WHEN k IN (3, 6) THEN 'edge_not_in_parent' END,
CASE WHEN k = 3 THEN 'duplicate_edges' END, CASE WHEN k = 4 THEN 'parent_not_found' END, CASE WHEN k = 4 THEN 'provenance_parent' END, CASE WHEN k = 6 THEN 'edge_outside_subgraph' END, CASE WHEN k IN (3, 6) THEN 'provenance_edge_ids' END, CASE WHEN k = 1 THEN 'provenance_node_ids' END,
CASE WHEN k = 7 THEN 'provenance_missing' END, CASE WHEN k = 5 OR (k = 1 AND round((n + 1) / n, 4) <> 1) THEN 'provenance_node_ratio' END, CASE WHEN k IN (3, 6) AND round((m + 1) / m, 4) <> 1 THEN 'provenance_edge_ratio' END], lambda x: x IS NOT NULL)), ',') AS problems FROM c""")
def gr18_broken_records(spark, d):
    """GR18: every check finds the damage done for it.  Whether a record is in one piece has a query of its own."""
    records, parents = _tampered(spark, d)
    found = extract.verify(records, parents)
    return found.select("id", F.array_join(F.array_remove("problems", "disconnected"), ",").alias("problems"))


@query(f"""WITH RECURSIVE {EG}, g AS (SELECT DISTINCT arch_id FROM edges), l(arch_id, node_id, low) AS (SELECT arch_id, node_id, node_id FROM nodes WHERE arch_id IN (SELECT arch_id FROM g) UNION
  SELECT l.arch_id, CASE WHEN e.source = l.node_id THEN e.target ELSE e.source END, l.low FROM l JOIN edges e ON e.arch_id = l.arch_id AND (e.source = l.node_id OR e.target = l.node_id)),
c AS (SELECT arch_id, count(DISTINCT low) AS parts FROM (SELECT arch_id, node_id, min(low) AS low FROM l GROUP BY 1, 2) GROUP BY 1) SELECT arch_id || '#S1' AS id, parts > 1 OR arch_id % 8 = 1 AS disconnected FROM c""")
def gr18_connected_records(spark, d):
    """GR18, GR4: records that fell apart; a fabricated node is never linked."""
    records, parents = _tampered(spark, d)
    return extract.verify(records, parents).select("id", F.array_contains("problems", "disconnected").alias("disconnected"))


@query(f"""WITH RECURSIVE {EG}, {_CC}, {_SCORES}, c AS (SELECT arch_id, component, max(entry_score) AS entry, count(*) AS size, arg_min(node_id, (-root_score, node_id)) AS root FROM cc JOIN scores USING (arch_id, node_id) GROUP BY 1, 2),
main AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arch_id ORDER BY entry DESC, size DESC, component) AS r FROM c) WHERE r = 1), ids AS (SELECT arch_id, component, string_agg(node_id, ',' ORDER BY node_id) AS ids FROM cc GROUP BY 1, 2),
inside AS (SELECT e.arch_id, cc.component, count(*) AS m FROM edges e JOIN cc ON cc.arch_id = e.arch_id AND cc.node_id = e.source GROUP BY 1, 2), total AS (SELECT arch_id, sum(size) AS n FROM c GROUP BY 1), g AS (SELECT arch_id, CASE WHEN n < 2 THEN 'insufficient_nodes' WHEN arch_id NOT IN (SELECT arch_id FROM edges) THEN 'no_edges' WHEN size < 2 THEN 'component_too_small' END AS reason, root, size, ids, m
FROM main JOIN total USING (arch_id) JOIN ids USING (arch_id, component) LEFT JOIN inside USING (arch_id, component)) SELECT arch_id, reason, CASE WHEN reason IS NULL THEN root END AS root, CASE WHEN reason IS NULL THEN least(10, size) ELSE 0 END AS n_nodes, CASE WHEN reason IS NULL AND size <= 10 THEN ids END AS ids, CASE WHEN reason IS NULL AND size <= 10 THEN least(15, m) END AS n_edges FROM g""")
def gr13_gr16_extraction_bounds(spark, d):
    """GR13, GR14, GR16: reason, root and size of every extraction; its nodes and edges too where the component is within the limit."""
    g = _nested_events(spark, d)
    n, e = event_graph(spark, d)
    size = graph.main_components(n, e).select(F.col("arch_id").cast("long").alias("arch_id"), "size")
    small = F.col("reason").isNull() & (F.col("size") <= dims.MAX_NODES)
    names = F.transform("nodes", lambda x: x["id"])
    return extract.extract(g).join(size, "arch_id").select("arch_id", "reason", F.get(names, F.lit(0)).alias("root"), F.size("nodes").alias("n_nodes"), F.when(small, F.array_join(F.array_sort(names), ",")).alias("ids"), F.when(small, F.size("edges")).alias("n_edges"))


_CLEAN = "x AS (SELECT arch_id, n, m, row_number() OVER (ORDER BY arch_id) AS place FROM s WHERE m > 0)"
_TEMPLATE = "Task: {description} End"


@query(f"""WITH {EG}, {_LISTED}, {_CLEAN}, f AS (SELECT 'record count' AS "check", ((SELECT count(*) FROM x) <> 100)::INT::BIGINT AS failed UNION ALL SELECT 'sequential unique ids', (SELECT count(*) FROM x WHERE arch_id % 11 = 0)
UNION ALL SELECT 'contract issues', (SELECT count(*) FROM x WHERE n > 10 OR m > 15) UNION ALL SELECT 'response fidelity', (SELECT count(*) FROM x WHERE arch_id % 13 = 0) UNION ALL SELECT 'parent architecture fidelity', (SELECT count(*) FROM x WHERE arch_id % 7 <> 0 AND arch_id % 17 = 0)
UNION ALL SELECT 'prompt drift', (SELECT count(*) FROM x WHERE arch_id % 7 <> 0 AND arch_id % 5 = 0) UNION ALL SELECT 'provenance present', (SELECT count(*) FROM x WHERE arch_id % 19 = 0) UNION ALL SELECT 'parents in manifest', (SELECT count(*) FROM x WHERE arch_id % 7 = 0)
UNION ALL SELECT 'subgraph contract', (SELECT count(*) FROM x WHERE arch_id % 7 <> 0 AND arch_id % 23 = 0) UNION ALL SELECT 'sequence length', (SELECT count(*) FROM x WHERE n * 20 > 120)
UNION ALL SELECT 'split counts exact', ((SELECT count(*) FROM x WHERE arch_id % 7 <> 0 AND arch_id % 10 < 9) <> 50)::INT + ((SELECT count(*) FROM x WHERE arch_id % 7 <> 0 AND arch_id % 10 = 9) <> 5)::INT
UNION ALL SELECT 'cluster integrity', (SELECT count(*) FROM (SELECT ids FROM (SELECT x.arch_id, string_agg(node_id, ',' ORDER BY node_id) AS ids FROM x JOIN nodes USING (arch_id) WHERE x.arch_id % 7 <> 0 GROUP BY 1) GROUP BY 1 HAVING count(DISTINCT arch_id % 10 = 9) > 1)))
SELECT "check", failed, failed = 0 AS pass, (SELECT bool_and(failed = 0) FROM f) AS all_pass FROM f""")
def qg2_twelve_checks(spark, d):
    """QG2, AG28: a training file made of the event graphs, with faults of every kind."""
    p = staged(stats.numbered(_nested_events(spark, d).where(F.size("edges") > 0), ["arch_id"], "place"), "artifact")
    k, name = F.col("arch_id"), F.col("arch_id").cast("string")
    bad = lambda m, then, other: F.when(k % m == 0, then).otherwise(other)
    r = p.select(
        bad(11, F.lit("SFT-x"), F.format_string("SFT-%06d", "place")).alias("id"), "place", bad(5, F.lit("Task: "), F.concat(F.lit("Task: graph "), name, F.lit(" End"))).alias("instruction"), bad(13, F.lit("{}"), F.to_json(F.struct("nodes", "edges"))).alias("response"), "nodes", "edges",
        name.alias("parent_source_id"), bad(19, F.lit(""), name).alias("parent_architecture_id"), bad(23, F.lit("other"), F.lit(extract.METHOD)).alias("method"), F.lit(10).alias("max_nodes"), F.lit(15).alias("max_edges"),
        F.when(k % 10 == 9, "test").otherwise("train").alias("split"), (F.size("nodes") * 20).alias("n_tokens"),
    )
    parents = p.where(k % 7 != 0).select(name.alias("parent_source_id"), F.concat(F.lit(" graph "), name, F.lit(" ")).alias("instruction"), bad(17, F.slice("nodes", 1, 1), F.col("nodes")).alias("nodes"), "edges")
    return gates.artifact_gate(r, parents, _TEMPLATE, 100, {"train": 50, "test": 5}, 120)


@query(f"""WITH {EG}, {_LISTED}, r AS (SELECT sum((m > 0)::INT) / count(*) AS parse_rate, sum((m > 0 AND n <= 10 AND m <= 15)::INT) / count(*) AS within, count(*) AS n FROM s), g(gate, pass) AS (VALUES ('G1 corpus immutable', TRUE), ('G2 artifact immutable', FALSE), ('G3 adapter exists', TRUE) UNION ALL SELECT 'G4 generation evaluation', n = 50 FROM r
UNION ALL SELECT 'G5 parse_rate >= 0.80', parse_rate >= 0.8 FROM r UNION ALL SELECT 'G5 schema_valid_rate >= 0.80', within >= 0.8 FROM r UNION ALL SELECT 'G5 connected_rate == 1.0', TRUE UNION ALL SELECT 'G5 structurally_weak_rate == 0.0', TRUE UNION ALL SELECT 'G5 guardrail on parsed == 1.0', within = parse_rate FROM r) SELECT gate, pass, (SELECT bool_and(pass) FROM g) AS all_pass FROM g""")
def qg3_phase_gates(spark, d):
    """QG3, AG28: G1 to G5 over the rates of the event graphs."""
    g = _nested_events(spark, d).select(F.size("nodes").alias("n"), F.size("edges").alias("m"))
    share = lambda c: F.count_if(c) / F.count("*")
    fits = share((F.col("m") > 0) & (F.col("n") <= 10) & (F.col("m") <= 15))
    rates = g.agg(F.count("*").alias("n"), share(F.col("m") > 0).alias("parse_rate"), share(F.col("m") > 0).alias("parse_ok"), fits.alias("schema_valid_rate"), F.lit(1.0).alias("connected_rate"), F.lit(None).cast("double").alias("structurally_weak_rate"), F.lit(0.0).alias("orphan_rate"), fits.alias("within_guardrail"))
    hashes = spark.createDataFrame([("G1 corpus immutable", "a", "a"), ("G2 artifact immutable", "a", "MISSING")], "gate string, expected string, actual string")
    return gates.phase_gates(hashes, ["adapter_config.json", "adapter_model.safetensors", "README"], rates, 50)


@query(f"""WITH {EG}, {_BAD}, b AS (SELECT arch_id, count(*) AS n, count(DISTINCT (node_id, node_type)) AS dn, bool_and(node_type <> 'unknown') AS known FROM bad_nodes GROUP BY 1), e AS (SELECT arch_id, count(*) AS m, count(DISTINCT (source, target, label)) AS dm, bool_and(label <> 'smoke signals') AS labels FROM bad_edges GROUP BY 1)
SELECT CASE WHEN arch_id % 2 = 0 THEN printf('CSA-%06d', arch_id) ELSE 'X' || arch_id END AS id, arch_id % 2 = 0 AND arch_id < 1000000 AS id_form, length('Design graph ' || arch_id || '.') BETWEEN 20 AND 2000 AS instruction_length, n BETWEEN 2 AND 100 AS node_count, coalesce(m, 0) BETWEEN 1 AND 200 AS edge_count, TRUE AS node_ids, known AS node_types,
coalesce(labels, TRUE) AS edge_labels, n = dn AS nodes_unique, coalesce(m = dm, TRUE) AS edges_unique, arch_id % 3 <> 0 AS risk_level, (arch_id % 150) BETWEEN 0 AND 100 AS score FROM b LEFT JOIN e USING (arch_id)""")
def fi11_contract_clauses(spark, d):
    """FI2, FI11: the record contract, clause by clause, over dirty graphs."""
    g, k = extract.nested(*_bad_graph(spark, d)), F.col("arch_id")
    id_ = F.when(k % 2 == 0, scalar.sample_id(k)).otherwise(F.concat(F.lit("X"), k.cast("string")))
    return gates.contract_clauses(g.select(id_.alias("id"), F.concat(F.lit("Design graph "), k.cast("string"), F.lit(".")).alias("instruction"), "nodes", "edges", F.when(k % 3 != 0, "LOW").otherwise("NONE").alias("risk_level"), (k % 150).alias("score")))


@query("""WITH d AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'a' WHEN toxic = 1 THEN 'r' WHEN doc_id % 3 = 0 THEN 's' ELSE 'e' END AS decision FROM labels), q AS (SELECT max(doc_id) AS stop FROM labels)
SELECT doc_id, CASE decision WHEN 'e' THEN 'a' ELSE decision END AS decision, decision = 'e' AS edited, length(CASE WHEN decision = 'e' AND doc_id % 2 = 0 THEN 'better' WHEN decision IN ('a', 'e') THEN text END) AS n FROM documents JOIN d USING (doc_id), q WHERE doc_id < stop""")
def qg5_review(spark, d):
    """QG5: approve, reject, edit (which approves), skip, and quit at the last labelled document."""
    labels = table(spark, d, "labels")
    stop = labels.agg(F.max("doc_id").alias("stop"))
    choice = F.when(F.col("doc_id") == F.col("stop"), "q").when(F.col("quality") == 1, " A").when(F.col("toxic") == 1, "r").when(F.col("doc_id") % 3 == 0, "s").otherwise("e")
    decisions = labels.join(F.broadcast(stop)).select("doc_id", choice.alias("decision"), F.when(F.col("doc_id") % 2 == 0, " better ").otherwise("").alias("new_text"))
    r = gates.review(_docs(spark, d), decisions, "doc_id", "text")
    return r.select("doc_id", "decision", "edited", F.length("reviewed_text").alias("n"))


@query("SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), ',') AS extra, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'v')), ',') AS other FROM events")
def pr25_se6_extra_keys(spark, d):
    """PR25, SE6: keys that a record should not have."""
    return table(spark, d, "events").select("event_id", F.array_join(gates.extra_keys(F.col("props"), ["k"]), ",").alias("extra"), F.array_join(gates.extra_keys(F.col("props"), ["v"]), ",").alias("other"))


@query("SELECT l_returnflag AS risk, sum(l_linenumber)::BIGINT AS num, sum(l_linenumber + 1)::BIGINT AS den, round(sum(l_linenumber) / greatest(1, sum(l_linenumber + 1)), 4) AS ratio FROM lineitem GROUP BY 1")
def ag22_merged_ratios(spark, d):
    """AG22: [numerator, denominator] pairs of shards, added up by key."""
    parts = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.array(F.sum("l_linenumber"), F.sum(F.col("l_linenumber") + 1)).alias("pair"))
    return stats.merged_ratios(parts, "l_returnflag", "pair").withColumnRenamed("l_returnflag", "risk")


@query("SELECT round(avg(n_chars), 1) AS mean, round(quantile_cont(n_chars, 0.5), 1) AS p50, round(quantile_cont(n_chars, 0.99), 1) AS p99 FROM documents")
def ag2_one_digit_summary(spark, d):
    return stats.summary(_docs(spark, d), "n_chars", digits=1).select("mean", "p50", "p99")


@query("SELECT lang, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def dd1_do3_first_rows(spark, d):
    """DD1, DO3: the first row of every key."""
    return stats.first_of(_docs(spark, d), ["lang"], ["doc_id"]).select("lang", "doc_id", "source")


# ---------------------------------------------------------------- graph edits, variants, hooks


@query(f"""WITH {EG}, w AS (SELECT DISTINCT a.arch_id, a.node_id AS source, a.node_type AS st, b.node_id AS target, b.node_type AS tt FROM nodes a JOIN nodes b ON a.arch_id = b.arch_id AND a.node_id LIKE '%-1' AND b.node_id LIKE '%-2')
SELECT arch_id, source, target, label FROM edges UNION ALL SELECT arch_id, source, target, CASE tt WHEN 'database' THEN 'DB Query' WHEN 'cache' THEN 'Cache' ELSE 'HTTP' END FROM w WHERE ((st = 'ui' AND tt = 'service') OR (st = 'service' AND tt IN ('database', 'cache'))) AND (arch_id, source, target) NOT IN (SELECT (arch_id, source, target) FROM edges)""")
def gr23_connect(spark, d):
    """GR23: connect every node *-1 with every node *-2 of its graph, where the editor allows it."""
    n, e = event_graph(spark, d)
    end = lambda c, s: n.where(F.col("node_id").endswith(s)).select("arch_id", F.col("node_id").alias(c))
    return gates.connect(n, e, end("source", "-1").join(end("target", "-2"), "arch_id"))


@query(f"WITH {EG} SELECT arch_id, node_id, node_type FROM nodes UNION ALL SELECT arch_id, node_id || '-copy', node_type FROM nodes WHERE node_type = 'ui'")
def gr23_clone(spark, d):
    n, _ = event_graph(spark, d)
    return gates.clone(n, n.where("node_type = 'ui'"))


@query(f"""WITH {EG}, p AS (SELECT arch_id, node_id, length(node_id) * 37 % 100 AS x, arch_id % 50 AS y FROM nodes), b AS (SELECT DISTINCT arch_id, c.* FROM nodes, (VALUES ('left', 0, 0, 50, 30), ('low', 0, 0, 99, 10)) c(container, x0, y0, x1, y1))
SELECT arch_id, node_id, min(container) AS container FROM p LEFT JOIN b USING (arch_id) WHERE FALSE GROUP BY 1, 2 UNION ALL SELECT p.arch_id, p.node_id, min(b.container) FROM p LEFT JOIN b ON p.arch_id = b.arch_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2""")
def gr23_drop(spark, d):
    """GR23: nodes dropped into the containers of their graph."""
    n, _ = event_graph(spark, d)
    points = n.select("arch_id", "node_id", (F.length("node_id") * 37 % 100).alias("x"), (F.col("arch_id") % 50).alias("y"))
    box = F.explode(F.array(*(F.struct(F.lit(c).alias("container"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(x).alias("x1"), F.lit(y).alias("y1")) for c, x, y in (("left", 50, 30), ("low", 99, 10)))))
    return gates.drop_into(points, n.select("arch_id").distinct().select("arch_id", box.alias("b")).select("arch_id", "b.*"))


@query(f"""WITH {EG}, c AS (SELECT arch_id, node_id, node_type, node_type || '-' || row_number() OVER (PARTITION BY arch_id, node_type ORDER BY node_id) AS new_id FROM nodes),
g AS (SELECT arch_id, string_agg(new_id, ',' ORDER BY new_id) AS ids FROM c GROUP BY 1), o AS (SELECT arch_id, string_agg(node_id, ',' ORDER BY node_id) AS ids FROM nodes GROUP BY 1)
SELECT arch_id, 'A' AS variant, 'Make it' AS prompt, ids FROM o UNION ALL SELECT arch_id, 'B', 'Make it', ids FROM g UNION ALL SELECT arch_id, 'C', 'Make it; at most 10 nodes. Name nodes by type and number.', ids FROM g""")
def pr5_pr29_sk9_variants(spark, d):
    """PR29, SK9, PR5, UD1: graphs as they are, under canonical ids, and with prompts that say so."""
    from lattica.plans import response

    n, e = event_graph(spark, d)
    listed = lambda x: x.groupBy("arch_id").agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("ids"))
    plain, canonical = listed(n), listed(graph.canonicalize(n, e)[0])
    prompt = F.lit("Make it")
    forms = {"A": lambda df: plain.withColumn("prompt", prompt), "B": lambda df: canonical.withColumn("prompt", prompt), "C": lambda df: canonical.withColumn("prompt", F.concat(scalar.insert_after(prompt, "Make it", "; at most 10 nodes."), F.lit(" Name nodes by type and number.")))}
    known = dict(response.VARIANTS)
    response.VARIANTS.clear()
    try:
        for name, f in forms.items():
            response.variant(name)(f)
        out = response.all_variants(n)
    finally:
        response.VARIANTS.clear()
        response.VARIANTS.update(known)
    return out.select("arch_id", "variant", "prompt", "ids")


def _stand_in():
    """A model that answers readably at a text's length modulo 5 th attempt, or only to a strict prompt, or never."""

    def answer(text: str, attempt: int, strict: bool) -> str:
        good = strict if len(text) % 5 == 4 else attempt > len(text) % 5
        return '{"nodes": ["a"], "edges": []}' if good and len(text) % 7 else ["", "no object", "{"][len(text) % 3]

    return answer


@query("""SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN 4 ELSE least(length(text) % 5 + 1, 4) END::INT AS attempts, CASE WHEN length(text) % 7 = 0 THEN CASE length(text) % 3 WHEN 0 THEN 'EMPTY_OUTPUT' WHEN 1 THEN 'NO_JSON' ELSE 'INCOMPLETE_JSON' END END AS failure FROM documents""")
def st3_ml1_ml6_predictions(spark, d):
    """ST3, ML1, ML6: answers of a stand-in model, asked up to three times and once more strictly."""
    return gates.predicted(_docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", _stand_in).select("doc_id", "attempts", "failure")


@query("""WITH t AS (SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, least(n + 3, 40)::INT AS n_tokens, greatest(least(n + 3, 40) - 3, 0)::INT AS n_target FROM t""")
def ml2_masked_tokens(spark, d):
    """ML2: three words of prompt, masked, and a turn's words; 40 at most."""
    c = table(spark, d, "conversations").where("text IS NOT NULL").withColumn("prompt", F.lit("Now say this"))
    m = gates.masked(c, "prompt", "text", gates.hashed_words, 40)
    return m.select("conv_id", "turn", F.size("tokens").alias("n_tokens"), F.size(F.filter("labels", lambda x: x != -100)).alias("n_target"))


# ---------------------------------------------------------------- sources


@query("SELECT CASE WHEN lang = 'en' THEN 'train' ELSE lang END AS split, count(*) AS rows FROM documents GROUP BY 1")
def sc2_split_sizes(spark, d):
    return readers.split_sizes(_docs(spark, d).select(F.when(F.col("lang") != "en", F.col("lang")).alias("split")), "split")


@query("SELECT sum((event_id % 10 <> 0)::INT)::BIGINT AS good, sum(CASE WHEN event_id % 10 <> 0 THEN event_id END)::BIGINT AS ids, sum((event_id % 10 = 0)::INT)::BIGINT AS bad FROM events")
def sc4_tolerant_lines(spark, d):
    """SC4: lines of which every tenth is cut off."""
    e, path = table(spark, d, "events"), shared_path(spark, "tolerant")
    line = F.to_json(F.struct("event_id", "event_type"))
    e.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.tolerant_lines(spark, path, "event_id BIGINT, event_type STRING")
    return good.agg(F.count("*").alias("good"), F.sum("event_id").alias("ids")).join(bad.agg(F.count("*").alias("bad")))


@query("SELECT r_regionkey::BIGINT AS id, r_name AS name, 2 AS tags FROM region")
def sc5_sc7_json_files(spark, d):
    """SC5, SC7: one document of several lines per file."""
    path = shared_path(spark, "files")
    text = F.concat(F.lit('{\n "id": '), "r_regionkey", F.lit(',\n "name": "'), "r_name", F.lit('",\n "tags": ["a",\n "b"]\n}'))
    table(spark, d, "region").select(text.alias("value"), F.col("r_regionkey").alias("part")).repartition("part").write.partitionBy("part").text(path)
    docs = readers.json_files(spark, path + "/*", "id BIGINT, name STRING, tags ARRAY<STRING>")
    return docs.select("id", "name", F.size("tags").alias("tags"))


@query("SELECT event_id FROM events WHERE (event_id // 100) % 3 <> 0 AND (event_id // 100) % 5 <> 0")
def sc8_manifest_scan(spark, d):
    """SC8: rows of complete shards whose checksum holds."""
    k = (F.col("event_id") / 100).cast("long")
    shards = table(spark, d, "events").select("event_id", k.cast("string").alias("range_id"))
    sizes = shards.select("range_id").distinct().withColumn("k", F.col("range_id").cast("long"))
    manifest = sizes.select("range_id", F.when(F.col("k") % 3 == 0, "failed").otherwise("complete").alias("status"), F.lit("a").alias("shard_sha256"), F.when(F.col("k") % 5 == 0, "b").otherwise("a").alias("observed_sha256"))
    return readers.by_manifest(shards, manifest).select("event_id")


@query("SELECT r_regionkey::BIGINT AS id, '0.' || r_regionkey AS found FROM region")
def sc10_last_matches(spark, d):
    """SC10: the last loss in every log."""
    path = shared_path(spark, "logs")
    log = F.concat(F.lit("step 1 loss=9.5\nstep 2 loss=0."), "r_regionkey", F.lit("\nbye"))
    table(spark, d, "region").select(log.alias("value"), F.col("r_regionkey").alias("part")).repartition("part").write.partitionBy("part").text(path)
    found = readers.last_match(spark, path + "/*", r"loss=([0-9.]+)")
    return found.select(F.substring("found", 3, 9).try_cast("long").alias("id"), "found")


@query(f"WITH {EG} SELECT arch_id, (SELECT count(*) FROM nodes n WHERE n.arch_id = g.arch_id) AS nodes, (SELECT count(*) FROM edges e WHERE e.arch_id = g.arch_id) AS edges FROM (SELECT DISTINCT arch_id FROM nodes) g")
def sc14_imports(spark, d):
    """SC14: saved graphs with nameless nodes and loose ends that an import drops."""
    from lattica.plans.response import imported

    g = _nested_events(spark, d)
    nodes = F.concat(F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), n["type"].alias("kind"))), F.array(F.struct(F.lit("").alias("id"), F.lit("x").alias("kind"))))
    edges = F.concat("edges", F.array(F.struct(F.lit("view-9").alias("source"), F.lit("gone").alias("target"), F.lit("HTTP").alias("label"))))
    saved = g.select("arch_id", F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges"))).alias("text"))
    return imported(saved, "text").select("arch_id", F.size("nodes").cast("long").alias("nodes"), F.size("edges").cast("long").alias("edges"))


_TYPE_SQL = _sql_first("lower(p_name)", dims.TYPE_WORDS, "'service'")


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'database' WHEN 1 THEN 'ui' ELSE {_TYPE_SQL} END AS node_type FROM part")
def pr9_normal_types(spark, d):
    """PR9: known types and aliases; anything else is derived from the id."""
    raw = F.when(F.col("p_partkey") % 4 == 0, " DB ").when(F.col("p_partkey") % 4 == 1, "UI").when(F.col("p_partkey") % 4 == 2, "component")
    return table(spark, d, "part").select("p_partkey", scalar.normal_type(raw, F.col("p_name")).alias("node_type"))
