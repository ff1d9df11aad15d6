"""Registered queries: each operator over the driver's tables, and the same in SQL.

event graph (clean or dirty) and the security graph of views.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import dims, parsing, scalar
from lattica.operators import evaluate, extract, graph, security, splits, stats
from lattica.plans.views import EG, SG, _sql_first, event_graph, security_graph, table
from lattica.sources import readers, writers
from lattica.sources.staging import shared_path, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "documents")


# ---------------------------------------------------------------- gate, structure

FIRST_REASON = """
gate AS (SELECT s.arch_id, n_nodes, n_edges, CASE WHEN n_nodes = 0 OR n_edges = 0 THEN 'empty graph' WHEN isolated > 0 THEN 'isolated node(s) present'
    WHEN n_nodes > 10 OR n_edges > 15 THEN 'size_guardrail' ELSE 'accepted' END AS reason
  FROM (SELECT n.arch_id, count(*) AS n_nodes, coalesce(any_value(m.c), 0) AS n_edges,
      sum(CASE WHEN n.node_id NOT IN (SELECT source FROM edges e WHERE e.arch_id = n.arch_id UNION ALL SELECT target FROM edges e WHERE e.arch_id = n.arch_id) THEN 1 ELSE 0 END) AS isolated
    FROM nodes n LEFT JOIN (SELECT arch_id, count(*) AS c FROM edges GROUP BY 1) m USING (arch_id) GROUP BY 1) s)
"""


@query(f"WITH {EG}, {FIRST_REASON} SELECT reason, count(*) AS graphs FROM gate GROUP BY 1")
def qg1_gate_funnel(spark, d):
    """QG1, FI3, FI10, AG1: graphs by the first reason to reject them."""
    return graph.gate(*event_graph(spark, d)).groupBy("reason").agg(F.count("*").alias("graphs"))


@query(f"WITH {EG}, {FIRST_REASON} SELECT * FROM gate")
def qg1_gate(spark, d):
    return graph.gate(*event_graph(spark, d))


_ORPHANS = """
orph AS (SELECT n.arch_id, count(*) AS isolated FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.arch_id = n.arch_id AND (e.source = n.node_id OR e.target = n.node_id)) GROUP BY 1),
sizes AS (SELECT a.arch_id, a.n AS n_nodes, coalesce(b.n, 0) AS n_edges FROM (SELECT arch_id, count(*) AS n FROM nodes GROUP BY 1) a LEFT JOIN (SELECT arch_id, count(*) AS n FROM edges GROUP BY 1) b USING (arch_id))
"""


@query(f"WITH {EG}, {_ORPHANS} SELECT arch_id, n_nodes, n_edges, coalesce(isolated, 0) AS isolated, (n_nodes = 0 OR n_edges = 0 OR coalesce(isolated, 0) > 0) AS has_orphan FROM sizes LEFT JOIN orph USING (arch_id)")
def gr5_orphans(spark, d):
    return graph.orphans(*event_graph(spark, d))


_CC = """
und AS (SELECT arch_id, source AS a, target AS b FROM edges UNION SELECT arch_id, target, source FROM edges),
reach AS (SELECT arch_id, node_id AS a, node_id AS b FROM nodes UNION SELECT r.arch_id, r.a, u.b FROM reach r JOIN und u ON u.arch_id = r.arch_id AND u.a = r.b),
cc AS (SELECT arch_id, a AS node_id, min(b) AS component FROM reach GROUP BY 1, 2)
"""


@query(f"WITH RECURSIVE {EG}, {_CC} SELECT * FROM cc")
def gr9_components(spark, d):
    return graph.component_labels(*event_graph(spark, d))


@query(f"WITH RECURSIVE {EG}, {_CC}, s AS (SELECT arch_id, component, count(*) AS size FROM cc GROUP BY 1, 2) SELECT arch_id, count(*) AS components, round(max(size) / sum(size), 4) AS largest_share FROM s GROUP BY 1")
def gr10_do5_component_counts(spark, d):
    return graph.component_counts(*event_graph(spark, d))


@query(f"""WITH RECURSIVE {EG}, {_CC}, {_ORPHANS}, k AS (SELECT arch_id, count(DISTINCT component) AS c FROM cc GROUP BY 1),
f AS (SELECT arch_id, c = 1 AS connected, (n_nodes = 0 OR n_edges = 0 OR coalesce(isolated, 0) > 0) AS has_orphan FROM sizes JOIN k USING (arch_id) LEFT JOIN orph USING (arch_id))
SELECT *, (has_orphan OR NOT connected) AS structurally_weak FROM f""")
def gr4_gr6_connectivity(spark, d):
    return graph.connectivity(*event_graph(spark, d))


_BAD = """
bad_nodes AS (SELECT arch_id, node_id, CASE WHEN node_id LIKE 'error-%' THEN 'unknown' ELSE node_type END AS node_type, event_id AS pos FROM ev),
bad_edges AS (SELECT arch_id, pos, source, CASE WHEN pos % 17 = 0 THEN 'nowhere' ELSE target END AS target, CASE WHEN pos % 13 = 0 THEN 'smoke signals' ELSE label END AS label FROM dirty)
"""
_ISSUES = f"""
{_BAD}, known AS (SELECT DISTINCT arch_id, node_id FROM bad_nodes),
issues AS (
  SELECT arch_id, 'unsupported_node_type' AS rule, 'error' AS severity, node_id AS subject FROM bad_nodes WHERE node_type = 'unknown'
  UNION ALL SELECT arch_id, 'node_id_collision', 'error', node_id FROM (SELECT *, row_number() OVER (PARTITION BY arch_id, node_id ORDER BY pos) AS r FROM bad_nodes) WHERE r > 1
  UNION ALL SELECT arch_id, 'dangling_edge', 'error', source||'->'||target FROM bad_edges e WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.arch_id = e.arch_id AND k.node_id = e.source) OR NOT EXISTS (SELECT 1 FROM known k WHERE k.arch_id = e.arch_id AND k.node_id = e.target)
  UNION ALL SELECT arch_id, 'self_loop', 'warning', source||'->'||target FROM bad_edges WHERE source = target
  UNION ALL SELECT arch_id, 'duplicate_edge', 'warning', source||'->'||target FROM (SELECT *, row_number() OVER (PARTITION BY arch_id, source, target ORDER BY pos) AS r FROM bad_edges) WHERE r > 1
  UNION ALL SELECT arch_id, 'unsupported_edge_label', 'warning', source||'->'||target FROM bad_edges WHERE label = 'smoke signals'
  UNION ALL SELECT arch_id, 'size_guardrail', 'error', '' FROM (SELECT arch_id, count(*) AS n FROM bad_nodes GROUP BY 1) LEFT JOIN (SELECT arch_id, count(*) AS m FROM bad_edges GROUP BY 1) USING (arch_id) WHERE n > 10 OR m > 15)
"""


def _bad_graph(spark, d):
    from lattica.plans.views import _event_nodes

    n = _event_nodes(spark, d).select("arch_id", "node_id", F.when(F.col("node_id").startswith("error-"), "unknown").otherwise(F.col("node_type")).alias("node_type"), F.col("event_id").alias("pos"))
    _, e = event_graph(spark, d, dirty=True)
    e = e.select("arch_id", "pos", "source", F.when(F.col("pos") % 17 == 0, "nowhere").otherwise(F.col("target")).alias("target"), F.when(F.col("pos") % 13 == 0, "smoke signals").otherwise(F.col("label")).alias("label"))
    return n, e


@query(f"WITH {EG}, {_ISSUES} SELECT * FROM issues")
def gr7_issues(spark, d):
    return graph.issues(*_bad_graph(spark, d))


@query(f"WITH {EG}, {_ISSUES} SELECT rule, severity, count(*) AS n, count(DISTINCT subject) AS subjects FROM issues GROUP BY 1, 2")
def ag21_issue_counts(spark, d):
    return graph.issues(*_bad_graph(spark, d)).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


@query(f"""WITH {EG}, {_ISSUES}, c AS (SELECT arch_id, sum((severity = 'error')::INT) AS errors, sum((severity = 'warning')::INT) AS warnings FROM issues GROUP BY 1)
SELECT arch_id, coalesce(errors, 0)::BIGINT AS errors, coalesce(warnings, 0)::BIGINT AS warnings, coalesce(errors, 0) = 0 AS valid FROM (SELECT DISTINCT arch_id FROM bad_nodes) LEFT JOIN c USING (arch_id)""")
def gr8_validation(spark, d):
    return graph.validation(*_bad_graph(spark, d))


@query(f"WITH {EG}, {_BAD} SELECT arch_id, pos, source, target, label FROM bad_edges e WHERE target = 'nowhere'")
def jo6_dangling_edges(spark, d):
    return graph.dangling(*_bad_graph(spark, d))


@query(f"WITH {EG} SELECT arch_id, pos, source, target, label FROM (SELECT *, row_number() OVER (PARTITION BY arch_id, source, target ORDER BY pos) AS r FROM dirty WHERE source <> target) WHERE r = 1")
def wi3_gr21_first_edges(spark, d):
    return graph.first_edges(event_graph(spark, d, dirty=True)[1])


_DEGREE = "deg AS (SELECT n.arch_id, n.node_id, n.node_type, (SELECT count(*) FROM edges e WHERE e.arch_id = n.arch_id AND e.source = n.node_id) + (SELECT count(*) FROM edges e WHERE e.arch_id = n.arch_id AND e.target = n.node_id) AS degree FROM nodes n)"


@query(f"WITH {EG}, {_DEGREE} SELECT * FROM deg")
def gr20_degrees(spark, d):
    return graph.degrees(*event_graph(spark, d))


_CANON = "ids AS (SELECT arch_id, node_id, node_type, node_type||'-'||row_number() OVER (PARTITION BY arch_id, node_type ORDER BY node_id) AS new_id FROM nodes)"


@query(f"WITH {EG}, {_CANON} SELECT arch_id, new_id AS node_id, node_type FROM ids")
def gr19_wi1_canonical_nodes(spark, d):
    return graph.canonicalize(*event_graph(spark, d))[0]


@query(f"WITH {EG}, {_CANON} SELECT e.arch_id, a.new_id AS source, b.new_id AS target, label FROM edges e JOIN ids a ON a.arch_id = e.arch_id AND a.node_id = e.source JOIN ids b ON b.arch_id = e.arch_id AND b.node_id = e.target")
def gr19_jo14_canonical_edges(spark, d):
    return graph.canonicalize(*event_graph(spark, d))[1]


@query(f"WITH {EG}, {_CANON} SELECT arch_id, count(*) AS n, count(DISTINCT new_id) = count(*) AS bijective FROM ids GROUP BY 1")
def se8_id_map_bijection(spark, d):
    ids = graph.canonical_ids(event_graph(spark, d)[0])
    return ids.groupBy("arch_id").agg(F.count("*").alias("n"), (F.count_distinct("new_id") == F.count("*")).alias("bijective"))


@query(f"""WITH {EG}, {_CANON}, l AS (SELECT arch_id, list(new_id ORDER BY node_type, node_id) AS enumerated, list(new_id ORDER BY new_id) AS sorted FROM ids GROUP BY 1)
SELECT count(*) AS graphs, sum((enumerated = sorted)::INT)::BIGINT AS sorted_lists FROM l""")
def ag14_sorted_lists(spark, d):
    ids = graph.canonical_ids(event_graph(spark, d)[0])
    lists = ids.groupBy("arch_id").agg(F.array_sort(F.collect_list(F.struct("node_type", "node_id", "new_id"))).alias("l")).select(F.col("l.new_id").alias("l"))
    return lists.agg(F.count("*").alias("graphs"), F.count_if(F.col("l") == F.array_sort("l")).alias("sorted_lists"))


_KEYS = """
typed AS (SELECT e.arch_id, e.source, e.target, e.label, a.node_type AS st, b.node_type AS tt FROM edges e JOIN nodes a ON a.arch_id = e.arch_id AND a.node_id = e.source JOIN nodes b ON b.arch_id = e.arch_id AND b.node_id = e.target),
kn AS (SELECT arch_id, string_agg(node_id, ',' ORDER BY node_id) AS ids, string_agg(node_id||':'||node_type, ',' ORDER BY node_id||':'||node_type) AS named, string_agg(node_type, ',' ORDER BY node_type) AS types FROM nodes GROUP BY 1),
ke AS (SELECT arch_id, string_agg(source||'->'||target||'['||label||']', ',' ORDER BY source||'->'||target||'['||label||']') AS named_edges FROM edges GROUP BY 1),
kt AS (SELECT arch_id, string_agg(st||'>'||tt||'>'||label, ',' ORDER BY st||'>'||tt||'>'||label) AS type_edges FROM typed GROUP BY 1),
keys AS (SELECT arch_id, sha256(ids) AS node_set_key, sha256(named||'|'||coalesce(named_edges, '')) AS full_key, sha256(types||'|'||coalesce(type_edges, '')) AS structure_key FROM kn LEFT JOIN ke USING (arch_id) LEFT JOIN kt USING (arch_id))
"""


@query(f"WITH {EG}, {_KEYS} SELECT * FROM keys")
def pr17_gr22_sp4_fingerprints(spark, d):
    return graph.fingerprints(*event_graph(spark, d))


@query(f"WITH {EG}, {_KEYS}, g AS (SELECT structure_key, count(*) AS size FROM keys GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(size), 0)::BIGINT AS records, coalesce(max(size), 0) AS largest FROM g")
def ag12_structure_duplicates(spark, d):
    return stats.duplicate_groups(graph.fingerprints(*event_graph(spark, d)), F.col("structure_key"))


@query(f"WITH {EG}, {_KEYS}, c AS (SELECT node_set_key, count(*) AS records, count(DISTINCT full_key) AS graphs FROM keys GROUP BY 1) SELECT count(*) AS clusters, sum((graphs > 1)::INT)::BIGINT AS mixed FROM c")
def do8_mixed_clusters(spark, d):
    c = graph.fingerprints(*event_graph(spark, d)).groupBy("node_set_key").agg(F.count_distinct("full_key").alias("graphs"))
    return c.agg(F.count("*").alias("clusters"), F.count_if(F.col("graphs") > 1).alias("mixed"))


@query(f"""WITH {EG}, {_KEYS}, sides AS (SELECT arch_id, source AS node_id, 'out:'||label||':'||tt AS side FROM typed UNION ALL SELECT arch_id, target, 'in:'||label||':'||st FROM typed),
per AS (SELECT arch_id, node_id, string_agg(side, ';' ORDER BY side) AS s FROM sides GROUP BY 1, 2),
mark AS (SELECT arch_id, node_type||'/'||coalesce(s, '') AS m FROM nodes LEFT JOIN per USING (arch_id, node_id))
SELECT arch_id, sha256(string_agg(m, ',' ORDER BY m)) AS wl_key FROM mark GROUP BY 1""")
def do1_neighbourhood_keys(spark, d):
    return graph.neighbourhood_keys(*event_graph(spark, d))


def _like_count(words: list[str]) -> str:
    return " + ".join(f"contains(lower(node_id), '{w}')::INT" for w in words)


_SCORES = f"""
{_DEGREE}, roles AS (SELECT *, ({_like_count(dims.ENTRY_WORDS)}) AS em, ({_like_count(dims.DATA_WORDS)}) AS dm, ({_like_count(dims.SECURITY_WORDS)}) AS sm, (node_type = 'ui')::INT AS entry FROM deg),
scores AS (SELECT arch_id, node_id, (CASE node_type WHEN 'ui' THEN 6 WHEN 'database' THEN 6 WHEN 'cache' THEN 4 WHEN 'queue' THEN 4 WHEN 'container' THEN 2 ELSE 1 END + 6*entry + 4*least(em,3) + 6*least(sm,3) + 6*least(dm,3)
  + CASE WHEN node_type IN ('database','cache','queue') THEN 5 ELSE 0 END + least(degree,5))::BIGINT AS score,
  (100*entry + 25*em + 10*sm + 5*dm + least(degree,5))::BIGINT AS root_score, (100*entry + 25*em)::BIGINT AS entry_score FROM roles)
"""


@query(f"WITH {SG}, {_SCORES} SELECT * FROM scores")
def pr21_pr22_node_scores(spark, d):
    return graph.node_scores(*security_graph(spark, d))


@query(f"""WITH RECURSIVE {SG}, {_CC}, {_SCORES}, c AS (SELECT arch_id, component, max(entry_score) AS entry, count(*) AS size, arg_min(node_id, (-root_score, node_id)) AS root FROM cc JOIN scores USING (arch_id, node_id) GROUP BY 1, 2)
SELECT arch_id, component, size, root FROM (SELECT *, row_number() OVER (PARTITION BY arch_id ORDER BY entry DESC, size DESC, component) AS r FROM c) WHERE r = 1""")
def gr11_gr12_main_components(spark, d):
    return graph.main_components(*security_graph(spark, d))


@query(f"WITH {EG} SELECT e.* FROM edges e JOIN nodes a ON a.arch_id = e.arch_id AND a.node_id = e.source JOIN nodes b ON b.arch_id = e.arch_id AND b.node_id = e.target WHERE a.node_type <> 'cache' AND b.node_type <> 'cache'")
def gr15_induced_edges(spark, d):
    n, e = event_graph(spark, d)
    return graph.induced(e, n.where("node_type <> 'cache'"))


@query(f"WITH {EG} SELECT arch_id, count(*) AS left_edges FROM edges WHERE source NOT LIKE 'view-%' AND target NOT LIKE 'view-%' GROUP BY 1")
def gr23_cascade_delete(spark, d):
    n, e = event_graph(spark, d)
    return graph.without_nodes(n, e, n.where("node_type = 'ui'"))[1].groupBy("arch_id").agg(F.count("*").alias("left_edges"))


@query(f"WITH {EG}, {_KEYS} SELECT st AS source_type, tt AS target_type, label, count(*) AS n FROM typed GROUP BY 1, 2, 3")
def jo13_pr11_type_pairs(spark, d):
    typed = graph.proper_edges(*event_graph(spark, d))
    return typed.groupBy("source_type", "target_type", "label").agg(F.count("*").alias("n"))


@query(f"WITH {EG} SELECT arch_id, node_id, node_type, NULL::VARCHAR AS icon, CASE node_type WHEN 'ui' THEN 'ui' WHEN 'database' THEN 'data' WHEN 'cache' THEN 'data' ELSE 'service' END AS layer FROM nodes")
def pr16_visuals(spark, d):
    return security.with_visuals(event_graph(spark, d)[0])


# ---------------------------------------------------------------- security engine


def _assess_sql() -> str:
    text = """lower('{"id": "'||node_id||'", "type": "'||node_type||'"}')"""
    plain, shown = "lower(node_id||' '||node_type)", """lower('{''id'': '''||node_id||''', ''type'': '''||node_type||'''}')"""
    like = lambda t, words: f"bool_or(regexp_matches({t}, '{words}'))"
    flags = {"f_front": dims.FRONT, "f_back": dims.BACK, "f_store": dims.STORE, "f_open": dims.OPEN} | {f"d_{k}": v for k, v in dims.DOMAIN_WORDS.items()}
    cols = [f"{like(text, w)} AS {k}" for k, w in flags.items()]
    names = sorted(dims.RISK)
    cols += [f"bool_or(contains({text}, '{c.lower()}')) AS s{i}, bool_or(contains({plain}, '{c.lower()}')) AS p{i}" for i, c in enumerate(names)]
    cols += [f"sum(regexp_matches({shown}, '{w}')::INT)::BIGINT AS {k}" for k, w in dims.SURFACE.items()]
    base = {"Monitoring": "TRUE", "Authentication": "(f_front AND f_back)", "RBAC": "(f_front AND f_back)", "Audit Logging": "f_store", "Encryption Service": "f_store", "API Gateway": "f_open", "WAF": "f_open"}
    need = {c: " OR ".join([base.get(c, "FALSE"), *(f"d_{k}" for k, v in dims.DOMAIN_CONTROLS.items() if c in v)]) for c in names}
    lacks = [f"(({need[c]}) AND NOT s{i}) AS l{i}" for i, c in enumerate(names)]
    listed = lambda test: "list_filter([" + ", ".join(f"CASE WHEN {test(i)} THEN '{c}' END" for i, c in enumerate(names)) + "], lambda x: x IS NOT NULL)"
    points = " ".join(f"- CASE WHEN l{i} THEN {dims.PENALTY[dims.RISK[c]]} ELSE 0 END" for i, c in enumerate(names))
    return f"""
agg AS (SELECT arch_id, {", ".join(cols)} FROM nodes GROUP BY 1), lack AS (SELECT *, {", ".join(lacks)} FROM agg),
assessed AS (SELECT arch_id, {listed(lambda i: f"l{i}")} AS missing, {listed(lambda i: f"(l{i} OR p{i})")} AS required, greatest(0, least(100, 100 {points})) AS score,
  list_filter([{", ".join(f"CASE WHEN d_{k} THEN '{k}' END" for k in sorted(dims.DOMAIN_WORDS))}], lambda x: x IS NOT NULL) AS domains,
  public_endpoints, databases, services, least(100, 10*public_endpoints + 5*services + 10*databases) AS surface_score FROM lack)
"""


_ASSESS = _assess_sql()
_RISK = "CASE WHEN score >= 80 THEN 'LOW' WHEN score >= 50 THEN 'MEDIUM' ELSE 'HIGH' END"


@query(f"WITH {SG}, {_ASSESS} SELECT arch_id, array_to_string(missing, ',') AS missing, array_to_string(required, ',') AS required, array_to_string(domains, ',') AS domains, score, {_RISK} AS risk FROM assessed")
def sr1_sr9_assessment(spark, d):
    """SR1, SR3, SR4, SR8, SR9, AG27, SE1, SE2."""
    a = security.assessment(security_graph(spark, d)[0])
    return a.select("arch_id", *(F.array_join(c, ",").alias(c) for c in ("missing", "required", "domains")), "score", "risk")


@query(f"WITH {SG}, {_ASSESS} SELECT {_RISK} AS risk, count(*) AS graphs, min(score) AS least, max(score) AS largest FROM assessed GROUP BY 1")
def ag27_risk_levels(spark, d):
    return security.assessment(security_graph(spark, d)[0]).groupBy("risk").agg(F.count("*").alias("graphs"), F.min("score").alias("least"), F.max("score").alias("largest"))


@query(f"WITH {SG}, {_ASSESS} SELECT arch_id, public_endpoints, databases, services, surface_score FROM assessed")
def sr7_ag26_attack_surface(spark, d):
    return security.assessment(security_graph(spark, d)[0]).select("arch_id", "public_endpoints", "databases", "services", "surface_score")


_ADVICE = dims.values(list(dims.RECOMMENDATIONS.items()))


@query(f"WITH {SG}, {_ASSESS}, advice(control, advice) AS (VALUES {_ADVICE}) SELECT arch_id, string_agg(advice, ' ' ORDER BY control) AS recommendations FROM (SELECT arch_id, unnest(missing) AS control FROM assessed) JOIN advice USING (control) GROUP BY 1")
def sr5_recommendations(spark, d):
    a = security.assessment(security_graph(spark, d)[0]).where(F.size("missing") > 0)
    return a.select("arch_id", F.array_join("recommendations", " ").alias("recommendations"))


_SEVERITY = {t[0]: t[1] for t in dims.THREATS}
_CT = dims.values([(c, t, i, _SEVERITY[t]) for c, ts in dims.CONTROL_THREATS.items() for i, t in enumerate(ts)])
_THREATS = f"""
ct(control, threat, place, severity) AS (VALUES {_CT}),
found AS (SELECT arch_id, threat, severity, control FROM (SELECT arch_id, ct.*, row_number() OVER (PARTITION BY arch_id, threat ORDER BY control, place) AS r FROM (SELECT arch_id, unnest(missing) AS control FROM assessed) JOIN ct USING (control)) WHERE r = 1)
"""


@query(f"WITH {SG}, {_ASSESS}, {_THREATS} SELECT arch_id, threat, severity, control, CASE severity WHEN 'CRITICAL' THEN 'danger' WHEN 'HIGH' THEN 'warning' ELSE 'info' END AS severity_level FROM found")
def sr6_wi4_threats(spark, d):
    return security.threats(security.assessment(security_graph(spark, d)[0])).drop("place")


_WORDS = dims.values([(c, "|".join(w)) for c, w in dims.CONTROL_WORDS.items()])
_NODE_THREATS = f"cw(control, words) AS (VALUES {_WORDS}), nt AS (SELECT arch_id, node_id, threat, severity, control FROM nodes JOIN found USING (arch_id) JOIN cw USING (control) WHERE regexp_matches(lower(node_id||' '||node_type), words))"


@query(f"WITH {SG}, {_ASSESS}, {_THREATS}, {_NODE_THREATS} SELECT * FROM nt")
def jo8_node_threats(spark, d):
    n, _ = security_graph(spark, d)
    return security.node_threats(n, security.threats(security.assessment(n)))


@query(f"WITH {SG}, {_ASSESS}, {_THREATS}, {_NODE_THREATS} SELECT DISTINCT e.arch_id, source||'->'||target AS edge, threat, severity, control FROM edges e JOIN nt ON nt.arch_id = e.arch_id AND (nt.node_id = source OR nt.node_id = target)")
def jo9_jo17_edge_threats(spark, d):
    n, e = security_graph(spark, d)
    return security.edge_threats(n, e, security.threats(security.assessment(n)))


@query(f"WITH {SG}, {_ASSESS}, {_THREATS}, {_NODE_THREATS} SELECT arch_id, node_id, CASE max(CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS worst FROM nt GROUP BY 1, 2")
def ag29_worst_severity(spark, d):
    n, _ = security_graph(spark, d)
    return security.worst_severity(security.node_threats(n, security.threats(security.assessment(n))), "arch_id", "node_id")


@query("SELECT * FROM (VALUES " + dims.values([c[:3] for c in dims.CONTROLS if "api" in c[4]]) + ") t(name, risk_level, category)")
def sr11_controls_for_api(spark, d):
    return security.controls_for(spark, "api")


# ---------------------------------------------------------------- statistics


@query("SELECT coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def ag1_lang_counts(spark, d):
    return stats.frequency(_docs(spark, d), "lang")


@query("SELECT coalesce(source, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def ag1_most_common_sources(spark, d):
    return stats.most_common(_docs(spark, d), "source", 5)


_Q = ", ".join(f"round(quantile_cont(n_chars, {p}), 4) AS {n}" for n, p in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))


@query(f"SELECT count(n_chars) AS n, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 4) AS mean, {_Q} FROM documents")
def ag2_ag4_length_summary(spark, d):
    return stats.summary(_docs(spark, d), "n_chars")


@query("SELECT lang, list_extract(list_sort(list(n_chars)), count(*) // 2 + 1) AS upper_median FROM documents GROUP BY 1")
def ag3_upper_median(spark, d):
    return stats.upper_median(_docs(spark, d), "n_chars", "lang")


@query("WITH e AS (SELECT min(n_chars)::DOUBLE AS a, max(n_chars)::DOUBLE AS b FROM documents) SELECT least(19, floor((n_chars - a) * 20 / greatest(b - a, 1e-9)))::INT AS bin, count(*) AS n FROM documents, e GROUP BY 1")
def ag5_histogram(spark, d):
    return stats.histogram(_docs(spark, d), "n_chars", 20)


@query("SELECT arg_min(doc_id, (-n_chars, doc_id)) AS largest, arg_min(doc_id, (n_chars, doc_id)) AS least FROM documents")
def ag6_extremes(spark, d):
    return stats.extremes(_docs(spark, d), "doc_id", "n_chars")


@query("SELECT x AS at_most, (SELECT count(*) FROM orders WHERE o_totalprice <= x) AS n, round(100.0 * (SELECT count(*) FROM orders WHERE o_totalprice <= x) / greatest(1, (SELECT count(*) FROM orders)), 2) AS pct FROM (VALUES (1000), (10000), (50000), (100000), (200000)) t(x)")
def ag7_cumulative(spark, d):
    return stats.cumulative(table(spark, d, "orders"), "o_totalprice", [1000, 10000, 50000, 100000, 200000])


_BUCKETS = "CASE WHEN n BETWEEN 2 AND 10 THEN 'b1_02_10' WHEN n BETWEEN 11 AND 20 THEN 'b2_11_20' WHEN n BETWEEN 21 AND 30 THEN 'b3_21_30' WHEN n BETWEEN 31 AND 50 THEN 'b4_31_50' WHEN n BETWEEN 51 AND 100 THEN 'b5_51_100' WHEN n >= 101 THEN 'b6_101_plus' END"


@query(f"SELECT {_BUCKETS} AS bucket, count(*) AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def pr19_jo10_buckets(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("c"))
    return per.groupBy(scalar.bucket(F.col("c")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def ag8_crosstab(spark, d):
    o = table(spark, d, "orders").select("o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.crosstab(o.join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey")), "c_mktsegment", "n_name")


@query("SELECT size, count(*) AS n FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) GROUP BY 1")
def ag9_count_of_counts(spark, d):
    return stats.count_of_counts(table(spark, d, "lineitem"), "l_orderkey")


@query(f"WITH {EG} SELECT node_type, count(*) AS n, count(DISTINCT node_id) AS distinct_ids FROM nodes GROUP BY 1")
def ag10_ag11_ag30_vocabulary(spark, d):
    return event_graph(spark, d)[0].groupBy("node_type").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("distinct_ids"))


_DUP = "WITH g AS (SELECT {k}, count(*) AS size FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(size), 0)::BIGINT AS records, coalesce(max(size), 0) AS largest FROM g"


@query(_DUP.format(k="sha256(text)"))
def ag12_dd5_duplicate_texts(spark, d):
    return stats.duplicate_groups(_docs(spark, d), F.sha2("text", 256))


@query(_DUP.format(k="sha256(concat_ws('|', lang, source, text))"))
def dd3_duplicate_records(spark, d):
    return stats.duplicate_groups(_docs(spark, d), F.sha2(F.concat_ws("|", "lang", "source", "text"), 256))


@query("SELECT count(*) AS distinct_values, sum((c = 1)::INT)::BIGINT AS singletons, round(sum((c = 1)::INT) / sum(c), 6) AS rate FROM (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1)")
def ag13_singleton_rate(spark, d):
    return stats.singleton_rate(table(spark, d, "lineitem"), "l_partkey")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS key FROM documents GROUP BY text")
def wi5_dd2_first_copies(spark, d):
    first = stats.first_of(_docs(spark, d).select("doc_id", F.sha2("text", 256).alias("key")), ["key"], ["doc_id"])
    return first.select("doc_id", "key")


@query("SELECT count(*) AS texts, round(avg(c), 6) AS mean, max(c) AS most FROM (SELECT text, count(*) AS c FROM documents GROUP BY 1)")
def ag31_text_reuse(spark, d):
    per = _docs(spark, d).groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("c"))
    return per.agg(F.count("*").alias("texts"), F.round(F.avg("c"), 6).alias("mean"), F.max("c").alias("most"))


@query("""WITH r(name, low, high) AS (VALUES ('r1', 0, 500), ('r2', 500, 2500), ('r3', 2500, 100000), ('r4', 100000, 150000)),
x AS (SELECT name, o_totalprice AS v FROM orders JOIN r ON o_orderkey >= low AND o_orderkey < high)
SELECT r.name, count(v) AS n, coalesce(round(avg(v), 1), 0) AS mean FROM r LEFT JOIN x ON r.name = x.name GROUP BY 1""")
def ag25_jo10_regime_means(spark, d):
    r = spark.createDataFrame([("r1", 0, 500), ("r2", 500, 2500), ("r3", 2500, 100000), ("r4", 100000, 150000)], "name string, low long, high long")
    name = F.when(F.col("o_orderkey") < 500, "r1").when(F.col("o_orderkey") < 2500, "r2").when(F.col("o_orderkey") < 100000, "r3").when(F.col("o_orderkey") < 150000, "r4")
    per = table(spark, d, "orders").where("o_orderkey >= 0").groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 1).alias("mean"))
    return r.join(per, "name", "left").select("name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


_MARKS = dims.values([(w,) for w in ["tion", "license", "token", "example", "xxx"]])


@query(f"""WITH m(marker) AS (VALUES {_MARKS}), h AS (SELECT 'text' AS field, marker, doc_id AS id FROM documents JOIN m ON contains(lower(text), marker) UNION ALL SELECT 'source', marker, doc_id FROM documents JOIN m ON contains(lower(source), marker))
SELECT field, marker, count(*) AS records, array_to_string(list_sort(list(id))[1:3], ',') AS examples FROM h GROUP BY 1, 2""")
def fi8_ag24_markers(spark, d):
    return stats.markers(_docs(spark, d), "doc_id", {"text": "text", "source": "source"}, ["tion", "license", "token", "example", "xxx"])


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def fi8_benchmark_passages(spark, d):
    """Documents that hold a whole benchmark passage."""
    return stats.containing(_docs(spark, d), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


@query("""WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey % 7))) AS items FROM lineitem GROUP BY 1),
k AS (SELECT o_custkey, l_orderkey, items FROM s JOIN orders ON o_orderkey = l_orderkey)
SELECT a.l_orderkey AS a, b.l_orderkey AS b, round(len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items))), 6) AS jaccard FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.l_orderkey < b.l_orderkey
WHERE len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items))) >= 0.9""")
def jo11_dd4_near_pairs(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 7)).alias("items"))
    k = s.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return stats.near_pairs(k, "o_custkey", "l_orderkey", "items", 0.9)


# ---------------------------------------------------------------- sampling, order, splits


@query("""WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), t AS (SELECT *, count(*) OVER () AS k, sum(size) OVER () AS total FROM s),
q AS (SELECT *, greatest(100 - k, 0) AS budget, greatest(100 - k, 0) * (size - 1) / greatest(total - k, 1) AS quota FROM t), w AS (SELECT *, floor(quota) AS whole FROM q),
a AS (SELECT lang, CASE WHEN 100 >= total THEN size ELSE 1 + whole + CASE WHEN row_number() OVER (ORDER BY quota - whole DESC, lang) <= budget - sum(whole) OVER () THEN 1 ELSE 0 END END AS take FROM w)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) JOIN a USING (lang) WHERE r <= take""")
def sp1_wi7_wi8_allocation(spark, d):
    return stats.allocate(_docs(spark, d).select("doc_id", "lang"), "lang", "doc_id", 100).select("doc_id", "lang")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.85 THEN 'train' ELSE 'holdout' END AS split FROM documents")
def sp6_hash_split(spark, d):
    return stats.hash_split(_docs(spark, d), "doc_id")


@query("SELECT doc_id FROM documents ORDER BY sha256('42' || doc_id::VARCHAR), doc_id LIMIT 50")
def sp5_seeded_sample(spark, d):
    return stats.seeded_sample(_docs(spark, d).select("doc_id"), "doc_id", "42", 50)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS n FROM orders")
def wi2_wi11_global_numbers(spark, d):
    return stats.numbered(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "n")


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS shard, doc_id FROM documents")
def wi6_pr28_shards(spark, d):
    n = stats.numbered(_docs(spark, d).select("doc_id"), ["doc_id"])
    return n.select(F.floor((F.col("n") - 1) / 100).cast("long").alias("shard"), "doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def so3_top_outliers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(10)


@query("SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 10")
def so1_so2_sc1_offset_limit(spark, d):
    return _docs(spark, d).where("lang = 'en'").select("doc_id").orderBy("doc_id").offset(10).limit(20)


@query(f"WITH {EG}, {_SCORES} SELECT arch_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY arch_id ORDER BY score DESC, node_id) AS r FROM scores) WHERE r <= 2")
def so4_top_anchors(spark, d):
    s = graph.node_scores(*event_graph(spark, d))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("arch_id").orderBy(F.desc("score"), "node_id"))).where("r <= 2").select("arch_id", "node_id")


@query("SELECT config, f1, rank() OVER (ORDER BY f1 DESC) AS place FROM (SELECT l_returnflag || l_linestatus AS config, round(sum(l_quantity) / count(*), 6) AS f1 FROM lineitem GROUP BY 1)")
def wi9_config_ranking(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("config")).agg(F.round(F.sum("l_quantity") / F.count("*"), 6).alias("f1"))
    return per.select("config", "f1", F.rank().over(Window.orderBy(F.desc("f1"))).cast("long").alias("place"))


@query(f"WITH {EG} SELECT arch_id, node_id, 100 + 190 * (row_number() OVER (PARTITION BY arch_id, node_type ORDER BY node_id) - 1) AS x, count(*) OVER (PARTITION BY arch_id, node_type) AS in_layer FROM nodes")
def wi10_layered_places(spark, d):
    n = event_graph(spark, d)[0]
    w = Window.partitionBy("arch_id", "node_type")
    return n.select("arch_id", "node_id", (100 + 190 * (F.row_number().over(w.orderBy("node_id")) - 1)).cast("long").alias("x"), F.count("*").over(w).alias("in_layer"))


def _fold_sql(tier: str, targets: str, pick: str) -> str:
    """The fold over clusters as a recursion: f has each cluster's place, what was given so far and its split."""
    return f"""c AS (SELECT sha256(coalesce(text, '')) AS cluster, count(*) AS size, min({tier}) AS tier, min(doc_id) AS first FROM documents GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY tier, size DESC, first) AS i FROM c),
t AS (SELECT {targets} FROM c), f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS g0, 0::BIGINT AS g1, 0::BIGINT AS g2, 0 AS best UNION ALL
  SELECT i, g0 + CASE best WHEN 0 THEN size ELSE 0 END, g1 + CASE best WHEN 1 THEN size ELSE 0 END, g2 + CASE best WHEN 2 THEN size ELSE 0 END, best FROM (SELECT o.i, o.size, g0, g1, g2, {pick} AS best FROM f JOIN o ON o.i = f.i + 1, t)),
dealt AS (SELECT doc_id, ['train', 'validation', 'test'][best + 1] AS split FROM documents d JOIN o ON o.cluster = sha256(coalesce(d.text, '')) JOIN f ON f.i = o.i)"""


_RELATIVE = _fold_sql("(n_chars // 100)::INT", "round_even(sum(size) * 0.9, 0) AS t0, round_even(sum(size) * 0.05, 0) AS t1, round_even(sum(size) * 0.05, 0) AS t2", "CASE WHEN (t2 - g2) / t2 >= (t1 - g1) / t1 AND (t2 - g2) / t2 >= (t0 - g0) / t0 THEN 2 WHEN (t1 - g1) / t1 >= (t0 - g0) / t0 THEN 1 ELSE 0 END")
_ABSOLUTE = _fold_sql("0", "sum(size)::DOUBLE * 0.8::DOUBLE AS t0, sum(size)::DOUBLE * 0.1::DOUBLE AS t1, sum(size)::DOUBLE * 0.1::DOUBLE AS t2", "CASE WHEN t0 - g0 >= t1 - g1 AND t0 - g0 >= t2 - g2 THEN 0 WHEN t1 - g1 >= t2 - g2 THEN 1 ELSE 2 END")


@query(f"WITH RECURSIVE {_RELATIVE} SELECT doc_id, split FROM dealt")
def sp2_leakage_safe_split(spark, d):
    """SP2: documents of one text stay together; tiers by hundreds of characters."""
    r = _docs(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("cluster"), F.floor(F.col("n_chars") / 100).cast("int").alias("tier"))
    return splits.assign(r, "cluster", "tier", "doc_id").select("doc_id", "split")


@query(f"WITH RECURSIVE {_ABSOLUTE} SELECT doc_id, split FROM dealt")
def sp3_group_split(spark, d):
    """SP3: one tier, the split with most places open."""
    r = _docs(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("cluster"), F.lit(0).alias("tier"))
    return splits.assign(r, "cluster", "tier", "doc_id", [0.8, 0.1, 0.1], relative=False).select("doc_id", "split")


@query("SELECT user_id, count(DISTINCT CASE WHEN event_id % 10 < 8 THEN 'train' WHEN event_id % 10 = 8 THEN 'validation' ELSE 'test' END) AS splits FROM events GROUP BY 1 HAVING splits > 1")
def jo18_straddling(spark, d):
    """Users whose events a split by row tears apart."""
    at = F.col("event_id") % 10
    rows = table(spark, d, "events").select("user_id", F.when(at < 8, "train").when(at == 8, "validation").otherwise("test").alias("split"))
    return splits.straddling(rows, "user_id")


@query("SELECT (SELECT count(*) FROM documents) AS records, 0::BIGINT AS straddling")
def jo18_safe_split(spark, d):
    """The leakage-safe split of all documents tears nothing apart and loses nothing."""
    r = _docs(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("cluster"), F.floor(F.col("n_chars") / 100).cast("int").alias("tier"))
    per = splits.assign(r, "cluster", "tier", "doc_id").groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    return per.agg(F.sum("n").alias("records"), F.count_if(F.col("splits") > 1).alias("straddling"))


# ---------------------------------------------------------------- evaluation

_EVAL = "gen AS (SELECT DISTINCT arch_id, source, target, label FROM dirty WHERE source <> target), tgt AS (SELECT DISTINCT arch_id, source, target, label FROM dirty WHERE source <> target AND pos % 5 <> 0)"


def _predicted(spark, d):
    _, e = event_graph(spark, d, dirty=True)
    e = e.where("source <> target")
    return e.select("arch_id", "source", "target", "label").distinct(), e.where("pos % 5 <> 0").select("arch_id", "source", "target", "label").distinct()


_MATCH = "m AS (SELECT coalesce(g.arch_id, t.arch_id) AS arch_id, sum((g.arch_id IS NOT NULL AND t.arch_id IS NOT NULL)::INT)::BIGINT AS tp, sum((t.arch_id IS NULL)::INT)::BIGINT AS fp, sum((g.arch_id IS NULL)::INT)::BIGINT AS fn FROM gen g FULL JOIN tgt t ON g.arch_id = t.arch_id AND g.source = t.source AND g.target = t.target AND g.label = t.label GROUP BY 1)"
_MICRO = "SELECT tp, fp, fn, round(tp/(tp+fp), 6) AS precision, round(tp/(tp+fn), 6) AS recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))), 6) AS f1 FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM m)"


@query(f"WITH {EG}, {_EVAL}, {_MATCH} SELECT * FROM m")
def jo12_ag20_edge_match(spark, d):
    return evaluate.set_match(*_predicted(spark, d), "arch_id", ["source", "target", "label"])


@query(f"WITH {EG}, {_EVAL}, {_MATCH} {_MICRO}")
def ag15_edge_f1(spark, d):
    return evaluate.micro(evaluate.set_match(*_predicted(spark, d), "arch_id", ["source", "target", "label"]))


@query(f"WITH {EG}, {_EVAL}, {_MATCH} SELECT count(*) AS records, sum((fp = 0 AND fn = 0)::INT)::BIGINT AS exact, round(sum((fp = 0 AND fn = 0)::INT) / count(*), 6) AS rate FROM m")
def ag19_exact_match(spark, d):
    return evaluate.exact(evaluate.set_match(*_predicted(spark, d), "arch_id", ["source", "target", "label"]))


@query(f"""WITH {EG}, {_EVAL}, p AS (SELECT arch_id, label, count(*) AS p FROM gen GROUP BY 1, 2), t AS (SELECT arch_id, label, count(*) AS t FROM tgt GROUP BY 1, 2),
m AS (SELECT arch_id, sum(least(coalesce(p, 0), coalesce(t, 0)))::BIGINT AS tp, sum(greatest(coalesce(p, 0) - coalesce(t, 0), 0))::BIGINT AS fp, sum(greatest(coalesce(t, 0) - coalesce(p, 0), 0))::BIGINT AS fn FROM p FULL JOIN t USING (arch_id, label) GROUP BY 1) {_MICRO}""")
def ag16_structure_f1(spark, d):
    return evaluate.micro(evaluate.multiset_match(*_predicted(spark, d), "arch_id", ["label"]))


@query(f"""WITH {EG}, {_EVAL}, p AS (SELECT arch_id, count(*) AS p FROM gen GROUP BY 1), t AS (SELECT arch_id, count(*) AS t FROM tgt GROUP BY 1) SELECT count(*) AS records, round(avg(abs(p - t)), 6) AS mean_error FROM p JOIN t USING (arch_id)""")
def ag18_count_error(spark, d):
    p, t = (x.groupBy("arch_id").agg(F.count("*").alias("n")) for x in _predicted(spark, d))
    return evaluate.count_error(p, t, "arch_id", "n")


@query(f"""WITH {EG}, {FIRST_REASON}, r AS (SELECT n_edges > 0 AS parsed, reason = 'accepted' AS accepted, reason <> 'size_guardrail' AS small FROM gate), c AS (SELECT count(*) AS records, sum(parsed::INT)::BIGINT AS parsed, sum(accepted::INT) AS a, sum(small::INT) AS s FROM r)
SELECT records, parsed, round(a/records, 6) AS accepted_of_records, round(a/parsed, 6) AS accepted_of_parsed, round(s/records, 6) AS small_of_records, round(s/parsed, 6) AS small_of_parsed FROM c""")
def ag17_rates(spark, d):
    g = graph.gate(*event_graph(spark, d))
    return evaluate.rates(g.select((F.col("n_edges") > 0).alias("parsed"), (F.col("reason") == "accepted").alias("accepted"), (F.col("reason") != "size_guardrail").alias("small")), ["accepted", "small"], "parsed")


@query(f"WITH {EG}, {_EVAL}, g AS (SELECT 'edges kept' AS gate, (SELECT count(*) FROM tgt) >= 0.5 * (SELECT count(*) FROM gen) AS pass UNION ALL SELECT 'no self loop', (SELECT count(*) FROM gen WHERE source = target) = 0) SELECT gate, pass, (SELECT bool_and(pass) FROM g) AS all_pass FROM g")
def ag28_qg3_gates(spark, d):
    """Gates as a table of checks, and their conjunction."""
    gen, tgt = _predicted(spark, d)
    counts = gen.agg(F.count("*").alias("g"), F.count_if(F.col("source") == F.col("target")).alias("loops")).join(tgt.agg(F.count("*").alias("t")))
    checks = F.array(F.struct(F.lit("edges kept").alias("gate"), (F.col("t") >= 0.5 * F.col("g")).alias("pass")), F.struct(F.lit("no self loop").alias("gate"), (F.col("loops") == 0).alias("pass")))
    return counts.select(checks.alias("c")).select(F.explode("c").alias("x"), F.forall("c", lambda x: x["pass"]).alias("all_pass")).select("x.gate", "x.pass", "all_pass")


# ---------------------------------------------------------------- joins, sets, functions


@query("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jo3_semi_join(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jo5_st1_resume_skip(spark, d):
    """What a resumed stage still has to do: keys that the target lacks."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber, o_orderkey IS NULL AS parent_missing FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) ON l_orderkey = o_orderkey")
def jo1_jo2_left_join(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 10 <> 0").select("o_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", F.col("o_orderkey").isNull().alias("parent_missing"))


@query("SELECT d.doc_id, d.lang AS a, e.lang AS b FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS r FROM documents) d JOIN (SELECT lang, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents) e USING (r) WHERE r <= 10")
def jo15_positional_zip(spark, d):
    docs = _docs(spark, d)
    a = docs.orderBy("doc_id").limit(10).withColumn("r", F.row_number().over(Window.orderBy("doc_id"))).select("doc_id", F.col("lang").alias("a"), "r")
    b = docs.orderBy(F.desc("doc_id")).limit(10).withColumn("r", F.row_number().over(Window.orderBy(F.desc("doc_id")))).select(F.col("lang").alias("b"), "r")
    return a.join(b, "r").select("doc_id", "a", "b")


@query(f"""WITH {EG}, {_EVAL}, p AS (SELECT arch_id, label, count(*) AS c FROM gen GROUP BY 1, 2), t AS (SELECT arch_id, label, count(*) AS c FROM tgt GROUP BY 1, 2)
SELECT arch_id, sum(greatest(p.c - coalesce(t.c, 0), 0))::BIGINT AS surplus FROM p LEFT JOIN t USING (arch_id, label) GROUP BY 1""")
def se4_multiset_difference(spark, d):
    """SE4 by exceptAll: edges that the target lacks, counted with repeats."""
    gen, tgt = (x.select("arch_id", "label") for x in _predicted(spark, d))
    left = gen.exceptAll(tgt).groupBy("arch_id").agg(F.count("*").alias("c"))
    return gen.select("arch_id").distinct().join(left, "arch_id", "left").select("arch_id", F.coalesce("c", F.lit(0).cast("long")).alias("surplus"))


@query("SELECT lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT lang FROM documents WHERE doc_id % 2 = 1")
def se7_intersection(spark, d):
    x = _docs(spark, d)
    return x.where("doc_id % 2 = 0").select("lang").intersect(x.where("doc_id % 2 = 1").select("lang"))


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def so7_sorted_unique(spark, d):
    return _docs(spark, d).select("source").distinct().orderBy("source")


@query("""SELECT doc_id, concat_ws('. ', CASE WHEN length(lang) > 0 THEN 'Design a ' || lang || ' architecture' END, CASE WHEN length(source) > 0 THEN 'using a ' || source || ' style' END, 'satisfying: ' || lang || ', ' || source) || '.' AS instruction FROM documents""")
def pr1_instruction(spark, d):
    return _docs(spark, d).select("doc_id", scalar.instruction(F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.array("lang", "source")).alias("instruction"))


@query("SELECT doc_id, printf('CSA-%06d', doc_id) AS sample, doc_id::INT AS back FROM documents")
def pr2_sample_ids(spark, d):
    x = _docs(spark, d).select("doc_id", scalar.sample_id(F.col("doc_id")).alias("sample"))
    return x.select("doc_id", "sample", scalar.sample_number(F.col("sample")).alias("back"))


@query("SELECT conv_id, turn, replace('Task: {description} End', '{description}', trim(text)) AS prompt FROM conversations")
def pr4_prompts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", scalar.render("Task: {description} End", F.col("text")).alias("prompt"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::INT AS k, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS compact FROM events""")
def pr6_pr25_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct("event_type", "user_id")).alias("compact"))


_TYPE_SQL = "CASE " + " ".join(f"WHEN contains(lower(x), '{w}') THEN '{v}'" for w, v in dims.TYPE_WORDS.items()) + " ELSE 'service' END"
_LABEL_SQL = "CASE " + " ".join(f"WHEN contains(lower(trim(x)), '{w}') THEN '{v}'" for w, v in dims.LABEL_WORDS.items()) + " END"


@query(f"SELECT p_partkey, {_TYPE_SQL} AS node_type FROM (SELECT p_partkey, p_name || ' ' || p_type AS x FROM part)")
def pr8_derived_types(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.derive_type(F.col("p_name"), F.col("p_type")).alias("node_type"))


@query(f"SELECT conv_id, turn, {_LABEL_SQL} AS label FROM (SELECT conv_id, turn, text AS x FROM conversations)")
def pr10_labels(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", scalar.normal_label(F.col("text")).alias("label"))


@query("SELECT page_id, CASE WHEN trim(html) = '' THEN 'EMPTY_OUTPUT' WHEN NOT contains(html, '{') THEN 'NO_JSON' WHEN length(html) - length(replace(html, '{', '')) > length(html) - length(replace(html, '}', '')) THEN 'INCOMPLETE_JSON' ELSE 'OTHER_PARSE' END AS failure FROM pages")
def pr15_parse_failures(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.parse_failure(F.col("html")).alias("failure"))


@query("SELECT doc_id, greatest(1, floor(n / 3.5)::INT) AS tokens FROM (SELECT doc_id, length(text) AS n FROM documents)")
def pr20_token_lengths(spark, d):
    return _docs(spark, d).select("doc_id", scalar.token_length(F.col("text")).alias("tokens"))


@query(f"WITH {EG}, {_DEGREE} SELECT arch_id, node_id, round(degree / greatest(1, (SELECT count(*) FROM edges e WHERE e.arch_id = deg.arch_id)), 4) AS ratio FROM deg")
def pr27_ratios(spark, d):
    n, e = event_graph(spark, d)
    m = e.groupBy("arch_id").agg(F.count("*").alias("m"))
    return graph.degrees(n, e).join(m, "arch_id", "left").select("arch_id", "node_id", scalar.ratio(F.col("degree"), F.coalesce("m", F.lit(0).cast("long"))).alias("ratio"))


@query(f"WITH {SG} SELECT DISTINCT node_id, CASE WHEN regexp_matches(node_id, '^[A-Z0-9_]+$') AND regexp_matches(node_id, '[A-Z]') THEN 'ALL_CAPS' WHEN regexp_matches(node_id, '^[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$') THEN 'camelCase' WHEN regexp_matches(node_id, '^[a-z0-9_]+$') THEN 'lower_underscore' ELSE 'other' END AS style FROM nodes")
def do2_id_styles(spark, d):
    return security_graph(spark, d)[0].select("node_id").distinct().select("node_id", scalar.id_style(F.col("node_id")).alias("style"))


@query(f"WITH {SG}, l AS (SELECT arch_id, list(node_id ORDER BY node_id) AS x FROM nodes GROUP BY 1) SELECT arch_id, CASE len(x) WHEN 1 THEN x[1] ELSE array_to_string(x[1:-2], ', ') || ' and ' || x[-1] END AS listed FROM l")
def pr23_pr24_english_lists(spark, d):
    ids = security_graph(spark, d)[0].groupBy("arch_id").agg(F.array_sort(F.collect_list("node_id")).alias("x"))
    return ids.select("arch_id", scalar.english_list(F.col("x")).alias("listed"))


@query("SELECT doc_id, replace(replace(replace(trim(source || ' #quot;x#quot; #amp; #39;'), '#quot;', '\"'), '#amp;', '&'), '#39;', '''') AS label FROM documents")
def pr7_clean_labels(spark, d):
    return _docs(spark, d).select("doc_id", scalar.clean_label(F.concat("source", F.lit(" #quot;x#quot; #amp; #39;"))).alias("label"))


@query(f"WITH {EG} SELECT arch_id, source||'->'||target||'['||label||']' AS key FROM edges")
def pr18_edge_keys(spark, d):
    return event_graph(spark, d)[1].select("arch_id", scalar.edge_key(F.col("source"), F.col("target"), F.col("label")).alias("key"))


_SUMMED = "sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR"


@query(f"SELECT count(*) AS rows_read, {_SUMMED} AS digest FROM (SELECT sha256(concat_ws('|', doc_id, lang, source, n_chars, text)) AS h FROM documents)")
def sk8_qg4_content_hash(spark, d):
    """SK8, QG4, DO4: a table's content without regard to order; row hashes are added up before the shuffle."""
    return stats.content_hash(_docs(spark, d), ["doc_id", "lang", "source", "n_chars", "text"])


@query("SELECT doc_id, coalesce(lang, '') <> '' AND coalesce(text, '') <> '' AS has_text, n_chars BETWEEN 20 AND 2000 AS length_ok, lang IN ('en', 'fr', 'de', 'es') AS lang_ok FROM documents")
def fi1_fi2_fi11_contract_checks(spark, d):
    """One boolean per clause of a row contract."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return _docs(spark, d).select("doc_id", (some(F.col("lang")) & some(F.col("text"))).alias("has_text"), F.col("n_chars").between(20, 2000).alias("length_ok"), F.col("lang").isin("en", "fr", "de", "es").alias("lang_ok"))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE coalesce(quality, 0) = 1 AND toxic = 0")
def fi4_qg5_reviewed(spark, d):
    ok = table(spark, d, "labels").where("coalesce(quality, 0) = 1 AND toxic = 0").select("doc_id")
    return _docs(spark, d).select("doc_id").join(ok, "doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS decision, count(*) AS entries FROM events GROUP BY 1")
def sk5_last_decisions(spark, d):
    """The last entry of an append-only log wins."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"), F.count("*").alias("entries"))


@query("""SELECT variant, count(*) AS n, sum(length(body))::BIGINT AS chars FROM (SELECT 'A' AS variant, text AS body FROM documents UNION ALL SELECT 'B', upper(lang) || ': ' || text FROM documents UNION ALL SELECT 'C', 'name: ' || source || ' ' || text FROM documents) GROUP BY 1""")
def pr29_sk9_variants(spark, d):
    """The same rows in several representations, from a registry of projections."""
    forms = {"A": F.col("text"), "B": F.concat(F.upper("lang"), F.lit(": "), "text"), "C": F.concat(F.lit("name: "), "source", F.lit(" "), "text")}
    rows = _docs(spark, d).select(F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), c.alias("body")) for v, c in forms.items()))).alias("r")).select("r.*")
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.sum(F.length("body")).cast("long").alias("chars"))


@query("SELECT l_returnflag AS risk, sum((l_linestatus = 'O')::INT)::BIGINT AS kept, sum((l_quantity > 25)::INT)::BIGINT AS had, round(100.0 * sum((l_linestatus = 'O' AND l_quantity > 25)::INT) / greatest(1, sum((l_quantity > 25)::INT)), 2) AS pct FROM lineitem GROUP BY 1")
def ag22_ag23_retention(spark, d):
    """Only records that had the role count in the denominator."""
    had, kept = F.col("l_quantity") > 25, F.col("l_linestatus") == "O"
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("risk")).agg(F.count_if(kept).alias("kept"), F.count_if(had).alias("had"), F.round(100.0 * F.count_if(kept & had) / F.greatest(F.lit(1), F.count_if(had)), 2).alias("pct"))


# ---------------------------------------------------------------- parsing, extraction, sources, sinks


def _nested_events(spark, d):
    return extract.nested(*event_graph(spark, d))


def _diagrams(spark, d):
    """Every event graph with edges as diagram text: shapes, labels, spoken edges, comments and directives."""
    g = _nested_events(spark, d).where(F.size("edges") > 0)
    shape = lambda t: F.when(t == "ui", "[Web UI]").when(t == "database", "[(Orders)]").when(t == "queue", "{Kafka}").when(t == "cache", "((Redis))").otherwise("[Some API]")
    node = lambda n: F.concat(n["id"], shape(n["type"]), F.lit(" %% a node"))
    arrow = lambda x: F.when(x == "DB Query", " -- sends query --> ").when(x == "Async", " -->|publish event| ").when(x == "Cache", " ==>|cached| ").otherwise(" --> ")
    edge = lambda e: F.concat(e["source"], arrow(e["label"]), e["target"])
    head = F.lit("%% made from events\nflowchart LR\nclassDef x fill:#fff\nsubgraph S[Zone one]\n")
    return g.select("arch_id", F.concat(head, F.array_join(F.transform("nodes", node), "\n"), F.lit("\nend\n"), F.array_join(F.transform("edges", edge), "\n")).alias("text"))


@query(f"WITH {EG} SELECT arch_id, source, target, label FROM edges")
def gr1_fi9_diagram_round_trip(spark, d):
    """GR1, FI9: every event graph written as diagram text and parsed again; its edges."""
    return parsing.with_diagram(_diagrams(spark, d), "text").select("arch_id", F.explode("edges").alias("e")).select("arch_id", "e.*")


@query(f"WITH {EG} SELECT arch_id, node_id, node_type FROM nodes WHERE arch_id IN (SELECT arch_id FROM edges)")
def gr1_pr30_diagram_nodes(spark, d):
    """GR1, PR30: the nodes of the same diagrams, typed by shape and label."""
    return parsing.with_diagram(_diagrams(spark, d), "text").select("arch_id", F.explode("nodes").alias("n")).select("arch_id", F.col("n.id").alias("node_id"), F.col("n.type").alias("node_type"))


_LISTED = """s AS (SELECT n.arch_id, n.n, n.nodes, coalesce(m.m, 0) AS m, m.edges FROM
  (SELECT arch_id, count(*) AS n, string_agg(node_id||':'||node_type, ' ' ORDER BY node_id, node_type) AS nodes FROM nodes GROUP BY 1) n LEFT JOIN
  (SELECT arch_id, count(*) AS m, string_agg(source||'>'||target||':'||label, ' ' ORDER BY source, target, label) AS edges FROM edges GROUP BY 1) m USING (arch_id))"""


def _listed(p):
    """arch_id, error, nodes and edges of parsed graphs, each list as one string."""
    nodes = F.array_join(F.transform("nodes", lambda n: F.concat(n["id"], F.lit(":"), n["type"])), " ")
    edges = F.array_join(F.transform("edges", lambda e: F.concat(e["source"], F.lit(">"), e["target"], F.lit(":"), e["label"])), " ")
    return p.select("arch_id", "error", nodes.alias("nodes"), edges.alias("edges"))


_TOO_LARGE = "CASE WHEN m = 0 THEN 'nothing_listed' WHEN n > 10 THEN 'too_many_nodes' WHEN m > 15 THEN 'too_many_edges' END"


@query(f"WITH {EG}, {_LISTED} SELECT arch_id, {_TOO_LARGE} AS error, CASE WHEN {_TOO_LARGE} IS NULL THEN nodes ELSE '' END AS nodes, CASE WHEN {_TOO_LARGE} IS NULL THEN edges ELSE '' END AS edges FROM s")
def gr2_pr13_pr14_payloads(spark, d):
    """GR2, PR13, PR14: every event graph as model output, with prose around it, comments and repeats, parsed under the contract."""
    g = _nested_events(spark, d)
    again = F.struct(F.concat(F.col("nodes"), F.slice("nodes", 1, 1)).alias("nodes"), F.concat("edges", F.transform(F.slice("edges", 1, 1), lambda e: F.struct(e["source"], e["target"], F.lit("HTTP").alias("label")))).alias("edges"))
    text = F.concat(F.lit("Here it is: {1} "), F.replace(F.to_json(again), F.lit('],"edges"'), F.lit('],// http://x\n"edges"')), F.lit(" // done"))
    return _listed(parsing.with_payload(g.select("arch_id", text.alias("text")), "text"))


@query(f"WITH {EG}, {_LISTED} SELECT arch_id, CASE WHEN m = 0 THEN 'nothing_listed' END AS error, CASE WHEN m > 0 THEN nodes ELSE '' END AS nodes, coalesce(edges, '') AS edges FROM s")
def gr3_pr12_unlimited_payloads(spark, d):
    """GR3, PR12: without limits, in a code fence; edges by other names and, of every other graph, as lists; self-loops, loose ends, padding."""
    g = _nested_events(spark, d)
    as_list = F.transform("edges", lambda e: F.array(e["source"], F.concat(F.lit(" "), e["target"]), e["label"]))
    as_object = F.transform("edges", lambda e: F.struct(e["source"].alias("from"), e["target"].alias("to"), F.upper(e["label"]).alias("protocol")))
    more = lambda e: F.concat(F.substring(e, F.lit(1), F.length(e) - 1), F.when(F.length(e) > 2, ',{"source":"x","target":"view-1"},{"from":"click-1","target":"click-1"}]').otherwise("]"))
    edges = more(F.when(F.col("arch_id") % 2 == 0, F.to_json(as_list)).otherwise(F.to_json(as_object)))
    text = F.concat(F.lit("```json\n{\"nodes\":"), F.to_json("nodes"), F.lit(',"edges":'), edges, F.lit("}\n```"))
    return _listed(parsing.with_payload(g.select("arch_id", text.alias("text")), "text", limits=False, comments=False))


@query()
def gr16_subgraphs(spark, d):
    """GR13, GR14, GR16.  Tested against the rules on hand-made graphs and by gr17 and gr18."""
    out = extract.extract(_nested_events(spark, d))
    return out.select("arch_id", F.array_join(F.transform("nodes", lambda n: n["id"]), ",").alias("chosen"), F.size("edges").alias("n_edges"), "reason")


@query("SELECT 0::BIGINT AS problems")
def gr17_verified_subgraphs(spark, d):
    """GR17: all extracted records, checked against their parents; there must be no problem.  gr18 shows that each check bites."""
    g = staged(_nested_events(spark, d), "parents")
    return extract.verify(extract.records(g), g).agg(F.sum(F.size("problems")).cast("long").alias("problems"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase'")
def sk2_sc3_json_round_trip(spark, d):
    """SK1, SK2, SC3: reviewed rows written as JSON lines and read strictly."""
    path = shared_path(spark, "lines")
    e = table(spark, d, "events")
    writers.export_lines(e.select("event_id", "event_type", "value", (F.col("event_type") == "purchase").alias("reviewed")), path)
    return readers.strict_lines(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")


@query("SELECT 'r' || printf('%04d', (n - 1) // 2000) AS range_id, count(*) - sum((event_type = 'error')::INT)::BIGINT AS records, sum((event_type = 'error')::INT)::BIGINT AS skipped FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) AS n FROM events) GROUP BY 1")
def sk3_sk4_shards(spark, d):
    """SK3, SK4, AG22: shards, dead letters and their manifest."""
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", "rejected event").alias("reason"))
    return writers.write_shards(e, "event_id", 2000, shared_path(spark, "shards"), "reason").select("range_id", "records", "skipped")


@query("""WITH w AS (SELECT DISTINCT o_orderkey // 100 AS k FROM orders) SELECT 'r' || k AS range_id, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'orphan_shard_skipped'
WHEN k % 3 <> 0 AND k % 2 = 0 AND k % 5 <> 0 AND k % 7 <> 0 THEN 'skip' WHEN k % 3 <> 0 AND k % 2 = 0 AND k % 7 <> 0 THEN 'checksum_conflict_skipped' ELSE 'write' END AS action FROM w""")
def st2_resume_plan(spark, d):
    """ST2 over ranges of orders: recorded unless k % 3 = 0 (failed where k % 7 = 0), present where k % 2 = 0, damaged where k % 5 = 0."""
    w = table(spark, d, "orders").select((F.col("o_orderkey") / 100).cast("long").alias("k")).distinct().select("k", F.concat(F.lit("r"), "k").alias("range_id"), F.md5(F.col("k").cast("string")).alias("sha"))
    recorded = w.where("k % 3 <> 0").select("range_id", F.when(F.col("k") % 7 == 0, "failed").otherwise("complete").alias("status"), F.col("sha").alias("shard_sha256"))
    present = w.where("k % 2 = 0").select("range_id", F.when(F.col("k") % 5 == 0, "damaged").otherwise(F.col("sha")).alias("observed_sha256"))
    return writers.resume_plan(w.select("range_id"), recorded, present)


@query("SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1")
def sc12_first_seen_codes(spark, d):
    return readers.first_seen_codes(table(spark, d, "events"), "event_type", "event_id")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 25")
def sc9_sp7_split_rows(spark, d):
    x = _docs(spark, d).select("doc_id", "lang", F.col("lang").alias("split"))
    return readers.split_rows(x, "de", id_col="doc_id", limit=25).select("doc_id", "lang")


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages")
def sc11_templates(spark, d):
    return table(spark, d, "pages").select("page_id", readers.template(F.col("html"), "<title>(.*?)</title>").alias("title"))


@query(f"""WITH {EG}, {_KEYS}, r AS (SELECT arch_id, full_key, row_number() OVER (PARTITION BY full_key ORDER BY arch_id) AS nth FROM keys), {FIRST_REASON}
SELECT arch_id, CASE WHEN reason <> 'accepted' THEN reason WHEN nth > 1 THEN 'duplicate architecture' ELSE 'accepted' END AS reason FROM gate JOIN (SELECT g.arch_id, row_number() OVER (PARTITION BY full_key, reason = 'accepted' ORDER BY g.arch_id) AS nth FROM gate g JOIN keys USING (arch_id)) USING (arch_id)""")
def qg1_dd2_full_gate(spark, d):
    """QG1 with the duplicate check last: only graphs that pass the other checks can be first."""
    g = staged(_nested_events(spark, d), "gate")
    n = g.select("arch_id", F.explode("nodes").alias("n")).select("arch_id", F.col("n.id").alias("node_id"), F.col("n.type").alias("node_type"))
    e = g.select("arch_id", F.explode("edges").alias("e")).select("arch_id", "e.*")
    gated = graph.gate(n, e).join(graph.fingerprints(n, e).select("arch_id", "full_key"), "arch_id")
    nth = F.row_number().over(Window.partitionBy("full_key", F.col("reason") == "accepted").orderBy("arch_id"))
    again = gated.withColumn("nth", nth)
    return again.select("arch_id", F.when((F.col("reason") == "accepted") & (F.col("nth") > 1), "duplicate architecture").otherwise(F.col("reason")).alias("reason"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, d):
    """Beside the surveyed operators: counts per day, as the watermarked stream makes them."""
    from lattica.streaming.incremental import windowed_counts

    w = windowed_counts(table(spark, d, "events"))
    return w.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


# ---------------------------------------------------------------- gates, audits, responses


@query(f"WITH {EG}, {_BAD} SELECT arch_id, count(*) <> count(DISTINCT node_id) AS duplicate_ids FROM bad_nodes GROUP BY 1")
def fi5_duplicate_node_ids(spark, d):
    return _bad_graph(spark, d)[0].groupBy("arch_id").agg((F.count("*") != F.count_distinct("node_id")).alias("duplicate_ids"))


@query(f"WITH {SG}, {_ASSESS}, {_THREATS} SELECT arch_id, len(missing) > 0 AND EXISTS (SELECT 1 FROM found f WHERE f.arch_id = a.arch_id) AS complete FROM assessed a")
def fi6_security_complete(spark, d):
    """FI6: threats and recommendations are both there."""
    a = security.assessment(security_graph(spark, d)[0])
    t = security.threats(a).select("arch_id").distinct().withColumn("has", F.lit(True))
    return a.join(t, "arch_id", "left").select("arch_id", ((F.size("recommendations") > 0) & F.coalesce("has", F.lit(False))).alias("complete"))


@query(f"WITH {SG} SELECT arch_id, node_id FROM nodes WHERE regexp_matches(lower(node_id||' '||node_type), 'pay|shop|patient')")
def fi7_keyword_any(spark, d):
    n = security_graph(spark, d)[0]
    return n.where(F.lower(F.concat_ws(" ", "node_id", "node_type")).rlike("pay|shop|patient")).select("arch_id", "node_id")


@query(f"WITH {EG}, s AS (SELECT arch_id, count(*) AS n FROM nodes GROUP BY 1) SELECT x AS at_most, (SELECT count(*) FROM s WHERE n <= x) AS graphs FROM (VALUES (8), (10), (12), (30)) t(x)")
def fi12_subset_predicates(spark, d):
    """Predicates are parameters; all are counted in one pass."""
    sizes = event_graph(spark, d)[0].groupBy("arch_id").agg(F.count("*").alias("n"))
    return stats.cumulative(sizes, "n", [8, 10, 12, 30]).select("at_most", F.col("n").alias("graphs"))


_CATALOG = dims.values([(c[0], c[1]) for c in dims.CONTROLS])


@query(f"WITH {SG}, {_ASSESS}, cat(control, risk_level) AS (VALUES {_CATALOG}) SELECT arch_id, risk_level, string_agg(control, ',' ORDER BY control) AS controls FROM (SELECT arch_id, unnest(missing) AS control FROM assessed) JOIN cat USING (control) GROUP BY 1, 2")
def sr2_jo7_missing_by_risk(spark, d):
    a = security.assessment(security_graph(spark, d)[0]).select("arch_id", F.explode("missing").alias("name"))
    by = a.join(F.broadcast(dims.controls(spark).select("name", "risk_level")), "name")
    return by.groupBy("arch_id", "risk_level").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("controls"))


@query("""SELECT (SELECT count(*) FROM labels) AS accepted, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS missing_rows,
(SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE NOT contains(lower(text), 'the')) AS not_in_text, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS never_accepted""")
def jo4_qg6_provenance(spark, d):
    """QG6, JO4: accepted rows without a source, sources without the word, sources never accepted."""
    docs, acc = _docs(spark, d).select("doc_id", "text"), table(spark, d, "labels").select("doc_id")
    both = docs.join(acc.withColumn("a", F.lit(True)), "doc_id", "full")
    known = F.col("a").isNotNull()
    return both.agg(F.count_if(known).alias("accepted"), F.count_if(known & F.col("text").isNull()).alias("missing_rows"), F.count_if(known & ~F.lower("text").contains("the")).alias("not_in_text"), F.count_if(~known).alias("never_accepted"))


@query("SELECT min(arch) AS first_id, max(arch) AS last_id, count(*) AS ids FROM (SELECT DISTINCT user_id::VARCHAR AS arch FROM events)")
def sc6_existing_ids(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").cast("string").alias("arch")).distinct()
    return ids.agg(F.min("arch").alias("first_id"), F.max("arch").alias("last_id"), F.count("*").alias("ids"))


@query(f"""WITH {EG}, {_BAD}, e AS (SELECT count(*) AS n, count(*) - count(DISTINCT (arch_id, source, target, label)) AS dup, sum((source = target)::INT) AS loops, sum((label = 'smoke signals')::INT) AS labels, sum((target = 'nowhere')::INT) AS dangling FROM bad_edges)
SELECT 'duplicate_edges' AS gate, dup::BIGINT AS n, dup = 0 AS pass FROM e UNION ALL SELECT 'self_loops', loops::BIGINT, loops = 0 FROM e UNION ALL SELECT 'bad_labels', labels::BIGINT, labels = 0 FROM e UNION ALL SELECT 'dangling', dangling::BIGINT, dangling = 0 FROM e""")
def qg2_artifact_gate(spark, d):
    """QG2: here a duplicate has the same label too."""
    n, e = _bad_graph(spark, d)
    dup = e.groupBy("arch_id", "source", "target", "label").agg((F.count("*") - 1).alias("c")).agg(F.sum("c").alias("n"))
    counts = e.agg(F.count_if(F.col("source") == F.col("target")).alias("loops"), F.count_if(~F.col("label").isin(dims.EDGE_LABELS)).alias("labels")).join(dup).join(graph.dangling(n, e).agg(F.count("*").alias("dangling")))
    rows = F.array(*(F.struct(F.lit(g).alias("gate"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n"), (F.coalesce(F.col(c), F.lit(0)) == 0).alias("pass")) for g, c in (("duplicate_edges", "n"), ("self_loops", "loops"), ("bad_labels", "labels"), ("dangling", "dangling"))))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


_PART = _ASSESS.replace("FROM nodes GROUP BY 1", "FROM (SELECT * FROM nodes WHERE node_id NOT LIKE '%-db' AND node_id <> 'waf') GROUP BY 1").replace("agg AS", "agg2 AS").replace("FROM agg)", "FROM agg2)").replace("lack AS", "lack2 AS").replace("FROM lack)", "FROM lack2)").replace("assessed AS", "assessed2 AS")


@query(f"WITH {SG}, {_ASSESS}, {_PART} SELECT a.arch_id, abs(a.score - b.score) AS delta, round(len(list_intersect(a.missing, b.missing)) / greatest(1, len(a.missing)), 6) AS recall FROM assessed a JOIN assessed2 b USING (arch_id)")
def do6_score_delta(spark, d):
    """DO6: assessments of a graph and of a poorer one: difference of scores, recall of missing controls."""
    n, _ = security_graph(spark, d)
    a = security.assessment(n).select("arch_id", "score", "missing")
    b = security.assessment(n.where("node_id NOT LIKE '%-db' AND node_id <> 'waf'")).select("arch_id", F.col("score").alias("s"), F.col("missing").alias("m"))
    return a.join(b, "arch_id").select("arch_id", F.abs(F.col("score") - F.col("s")).alias("delta"), F.round(F.size(F.array_intersect("missing", "m")) / F.greatest(F.lit(1), F.size("missing")), 6).alias("recall"))


_KINDS = "CASE WHEN regexp_matches(node_id, 'monitor|log|metric|trace') THEN 'observability' WHEN regexp_matches(node_id, 'audit|compliance|policy|gdpr') THEN 'compliance' WHEN regexp_matches(node_id, 'waf|mfa|rbac|siem|auth|vault') THEN 'control' ELSE 'architectural' END"


@query(f"WITH {SG}, lone AS (SELECT n.* FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.arch_id = n.arch_id AND e.source < 'p' AND (e.source = n.node_id OR e.target = n.node_id))) SELECT {_KINDS} AS kind, count(*) AS n FROM lone GROUP BY 1")
def do7_orphan_kinds(spark, d):
    """DO7: what kind of node is left alone."""
    n, e = security_graph(spark, d)
    lone = n.join(graph.endpoints(e.where("source < 'p'")).distinct(), ["arch_id", "node_id"], "left_anti")
    kind = F.when(F.col("node_id").rlike("monitor|log|metric|trace"), "observability").when(F.col("node_id").rlike("audit|compliance|policy|gdpr"), "compliance").when(F.col("node_id").rlike("waf|mfa|rbac|siem|auth|vault"), "control").otherwise("architectural")
    return lone.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT event_id, event_id % 1000 AS x, event_id % 700 AS y FROM events), c(container, x0, y0, x1, y1) AS (VALUES ('a', 0, 0, 300, 300), ('b', 200, 200, 600, 500), ('c', 500, 0, 900, 250))
SELECT event_id, min(container) AS container FROM p JOIN c ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1""")
def jo16_point_in_container(spark, d):
    """JO16: a range join with a small table of rectangles; the first that holds the point."""
    p = table(spark, d, "events").select("event_id", (F.col("event_id") % 1000).alias("x"), (F.col("event_id") % 700).alias("y"))
    c = spark.createDataFrame([("a", 0, 0, 300, 300), ("b", 200, 200, 600, 500), ("c", 500, 0, 900, 250)], "container string, x0 long, y0 long, x1 long, y1 long")
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return p.join(F.broadcast(c), inside).groupBy("event_id").agg(F.min("container").alias("container"))


@query(f"WITH {EG} SELECT arch_id, string_agg(source||'>'||target||':'||label, ' ' ORDER BY label, source, target) AS edges FROM edges GROUP BY 1")
def so5_so6_sorted_lists(spark, d):
    """SO5, SO6: lists sorted by several keys."""
    e = event_graph(spark, d)[1].groupBy("arch_id").agg(F.array_sort(F.collect_list(F.struct("label", "source", "target"))).alias("l"))
    return e.select("arch_id", F.array_join(F.transform("l", lambda x: F.concat(x["source"], F.lit(">"), x["target"], F.lit(":"), x["label"])), " ").alias("edges"))


@query("SELECT doc_id, CASE WHEN lang IN ('HTTP', 'DB Query', 'Async', 'Cache') THEN lang ELSE 'HTTP' END AS label, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS canon FROM documents")
def pr26_pr31_exact_labels(spark, d):
    """PR26, PR31: labels by equality; JSON with fields in a fixed order."""
    from lattica.plans.response import exact_label

    return _docs(spark, d).select("doc_id", exact_label(F.col("lang")).alias("label"), F.to_json(F.struct("lang", "source")).alias("canon"))


@query("""SELECT doc_id, coalesce(quality, 0) AS score, CASE WHEN quality IS NULL THEN 'HIGH' WHEN quality = 1 THEN 'LOW' ELSE 'MEDIUM' END AS risk_level, lang AS domain FROM documents LEFT JOIN labels USING (doc_id)""")
def pr3_reshaped_records(spark, d):
    """PR3: nested records with defaults, read back by field."""
    j = _docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    risk = F.when(F.col("quality").isNull(), "HIGH").when(F.col("quality") == 1, "LOW").otherwise("MEDIUM")
    r = j.select("doc_id", F.struct(F.coalesce("quality", F.lit(0)).alias("score"), risk.alias("risk_level")).alias("security"), F.struct(F.col("lang").alias("domain")).alias("metadata"))
    return r.select("doc_id", "security.score", "security.risk_level", "metadata.domain")


@query("SELECT 'documents' AS name, count(*) AS n, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, max(n_chars) AS longest FROM documents")
def sk6_sk7_report(spark, d):
    """SK6, SK7: a one-row report."""
    return _docs(spark, d).agg(F.lit("documents").alias("name"), F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.max("n_chars").alias("longest"))


@query(f"""WITH {EG}, {_LISTED}, shown AS (SELECT arch_id, string_agg(node_id||':'||coalesce({_sql_first("lower(node_id)", {w: w for w in dims.ICONS}, "NULL")}, '-')||':'||CASE node_type WHEN 'ui' THEN 'ui' WHEN 'database' THEN 'data' WHEN 'cache' THEN 'data' ELSE 'service' END, ' ' ORDER BY node_id, node_type) AS nodes FROM nodes GROUP BY 1),
lines AS (SELECT arch_id, string_agg(source||'>'||target||':'||label||':'||(label = 'Async')::VARCHAR, ' ' ORDER BY source, target, label) AS edges FROM edges GROUP BY 1)
SELECT arch_id, {_TOO_LARGE} AS error, CASE {_TOO_LARGE} WHEN 'nothing_listed' THEN 422 WHEN 'too_many_nodes' THEN 422 WHEN 'too_many_edges' THEN 422 ELSE 200 END AS status, CASE WHEN {_TOO_LARGE} IS NULL THEN shown.nodes ELSE '' END AS nodes, CASE WHEN {_TOO_LARGE} IS NULL THEN lines.edges ELSE '' END AS edges, CASE WHEN {_TOO_LARGE} IS NULL THEN TRUE END AS valid
FROM s JOIN shown USING (arch_id) LEFT JOIN lines USING (arch_id)""")
def sr12_sc13_responses(spark, d):
    """SR12, SC13, SR13: every event graph as raw model output through the whole request path."""
    from lattica.plans.response import respond

    raw = _nested_events(spark, d).select("arch_id", F.to_json(F.struct("nodes", "edges")).alias("text"))
    r = respond(raw, "arch_id", "text")
    nodes = F.array_join(F.transform("nodes", lambda n: F.concat_ws(":", n["id"], F.coalesce(n["icon"], F.lit("-")), n["layer"])), " ")
    edges = F.array_join(F.transform("edges", lambda e: F.concat(e["source"], F.lit(">"), e["target"], F.lit(":"), e["label"], F.lit(":"), e["dashed"].cast("string"))), " ")
    return r.select("arch_id", "error", "status", nodes.alias("nodes"), edges.alias("edges"), "valid")


@query("SELECT count(*) AS n, 0::BIGINT AS in_both, TRUE AS share_fits FROM documents")
def sp8_random_split(spark, d):
    """SP8: seeded random parts: complete, disjoint and of the share asked for (within four standard deviations)."""
    docs = staged(_docs(spark, d).select("doc_id"), "split-input")
    a, b = docs.randomSplit([0.8, 0.2], seed=7)
    per = a.withColumn("in_a", F.lit(1)).unionByName(b.withColumn("in_a", F.lit(0))).groupBy("doc_id").agg(F.count("*").alias("times"), F.max("in_a").alias("in_a"))
    n = F.count("*")
    return per.agg(n.alias("n"), F.count_if(F.col("times") > 1).alias("in_both"), (F.abs(F.sum("in_a") - 0.8 * n) <= 4 * F.sqrt(0.16 * n)).alias("share_fits"))
