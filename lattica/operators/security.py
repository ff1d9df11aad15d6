"""Rule-based security assessment of graphs, in one aggregation per graph and one join per threat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import dims, scalar
from lattica.sources.staging import by_shuffle, staged


def _json_text(mode: str = "dataset") -> Column:
    """The node as the rules read it; runtime mode also shows icon and layer."""
    parts = [F.lit('{"id": "'), F.col("node_id"), F.lit('", "type": "'), F.col("node_type"), F.lit('"')]
    if mode == "runtime":
        shown = scalar.icon(F.col("node_id"))
        parts += [F.lit(', "icon": '), F.coalesce(F.concat(F.lit('"'), shown, F.lit('"')), F.lit("null")), F.lit(', "layer": "'), scalar.layer(F.col("node_type")), F.lit('"')]
    return F.lower(F.concat(*parts, F.lit("}")))


def _values_text() -> Column:
    return F.lower(F.concat_ws(" ", "node_id", "node_type"))


def _required(control: str) -> Column:
    rule = {
        "Monitoring": F.lit(True),
        "Authentication": F.col("front") & F.col("back"),
        "RBAC": F.col("front") & F.col("back"),
        "Audit Logging": F.col("store"),
        "Encryption Service": F.col("store"),
        "API Gateway": F.col("open"),
        "WAF": F.col("open"),
    }.get(control, F.lit(False))
    for domain, names in dims.DOMAIN_CONTROLS.items():
        if control in names:
            rule = rule | F.col(domain)
    return rule


def assessment(nodes: DataFrame, mode: str = "dataset") -> DataFrame:
    """SR1 to SR5, SR8, SR9, AG26, AG27 per graph.

    arch_id, domains, missing and required controls (sorted), score, risk, recommendations and the
    attack surface.  All flags come from one hash aggregate over the nodes.
    """
    text, plain = _json_text(mode), _values_text()
    surface = F.lower(F.concat(F.lit("{'id': '"), "node_id", F.lit("', 'type': '"), "node_type", F.lit("'}")))
    flags = [F.bool_or(text.rlike(w)).alias(n) for n, w in (("front", dims.FRONT), ("back", dims.BACK), ("store", dims.STORE), ("open", dims.OPEN), *dims.DOMAIN_WORDS.items())]
    names = sorted(dims.RISK)
    seen = [F.bool_or(text.contains(c.lower())).alias(f"seen {c}") for c in names]
    present = [F.bool_or(plain.contains(c.lower())).alias(f"present {c}") for c in names]
    counts = [F.count_if(surface.rlike(w)).alias(k) for k, w in dims.SURFACE.items()]
    parts = [F.bool_or(surface.rlike(w)).alias(f"part {k}") for k, w in dims.SUMMARY_PARTS.items()]
    per = nodes.groupBy("arch_id").agg(*flags, *seen, *present, *counts, *parts)

    lacks = lambda c: _required(c) & ~F.col(f"seen {c}")
    chosen = lambda test: F.array_compact(F.array(*(F.when(test(c), F.lit(c)) for c in names)))
    points = F.lit(100)
    for c in names:
        points = points - F.when(lacks(c), dims.PENALTY[dims.RISK[c]]).otherwise(0)
    advice = F.array_compact(F.array(*(F.when(F.array_contains("missing", c), F.lit(dims.RECOMMENDATIONS[c])) for c in names)))
    surface_score = F.least(F.lit(100), 10 * F.col("public_endpoints") + 5 * F.col("services") + 10 * F.col("databases"))
    out = per.select(
        "arch_id",
        F.array_compact(F.array(*(F.when(F.col(d), F.lit(d)) for d in sorted(dims.DOMAIN_WORDS)))).alias("domains"),
        chosen(lacks).alias("missing"),
        chosen(lambda c: F.col(f"present {c}") | lacks(c)).alias("required"),
        F.greatest(F.lit(0), F.least(F.lit(100), points)).alias("score"),
        *dims.SURFACE,
        surface_score.alias("surface_score"),
        F.array_compact(F.array(*(F.when(F.col(f"part {k}"), F.lit(k)) for k in dims.SUMMARY_PARTS))).alias("parts"),
    )
    risk = F.when(F.col("score") >= 80, "LOW").when(F.col("score") >= 50, "MEDIUM").otherwise("HIGH")
    out = out.select("*", risk.alias("risk"), advice.alias("recommendations"))
    return out.withColumn("summary", summary(F.col("parts"), F.col("missing"), F.col("risk"))).drop("parts")


def summary(parts: Column, missing: Column, risk: Column) -> Column:
    """PR23: a graph's security in a sentence or two."""
    has = F.concat(F.lit("Architecture contains "), F.when(F.size(parts) == 0, "various components").otherwise(scalar.english_list(parts)))
    action = F.when(risk.isin("HIGH", "MEDIUM"), "requires immediate remediation.").otherwise("is acceptable.")
    lacking = F.concat(has, F.lit(" but lacks "), scalar.english_list(missing), F.lit(". Overall security posture is "), risk, F.lit(" RISK and "), action)
    fine = F.concat(has, F.lit(" and meets all baseline security requirements. Overall security posture is "), risk, F.lit(" RISK."))
    return F.when(F.size(missing) > 0, lacking).otherwise(fine)


def threats(assessed: DataFrame) -> DataFrame:
    """SR6, SR10, WI4: arch_id, threat, severity, severity_level, control: the first missing control of a threat."""
    missing = assessed.select("arch_id", F.explode("missing").alias("control"))
    hits = missing.join(F.broadcast(dims.control_threats(assessed.sparkSession)), "control")
    nth = F.row_number().over(Window.partitionBy("arch_id", "threat").orderBy("control", "place"))
    return hits.withColumn("nth", nth).where("nth = 1").select("arch_id", "threat", "severity", "severity_level", "control", "place")


def _protected_by() -> Column:
    """The controls whose words a node's id or type contains."""
    return F.array_compact(F.array(*(F.when(_values_text().rlike("|".join(words)), F.lit(c)) for c, words in dims.CONTROL_WORDS.items())))


def node_threats(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """JO8: a row for every node that a threat's control protects.

    One pass over the nodes lists the controls of each, which then meet the threats by graph and control.
    """
    protected = nodes.select("arch_id", "node_id", F.explode(_protected_by()).alias("control"))
    return protected.join(by_shuffle(found), ["arch_id", "control"]).select("arch_id", "node_id", "threat", "severity", "control")


def edge_threats(nodes: DataFrame, edges: DataFrame, found: DataFrame, keep_all: bool = False) -> DataFrame:
    """JO9: a row for every edge with an affected end.  keep_all (JO17): edges without threats stay, with nulls."""
    hit = node_threats(nodes, found).withColumnRenamed("node_id", "end")
    named = edges.select("arch_id", F.concat("source", F.lit("->"), "target").alias("edge"), F.explode(F.array("source", "target")).alias("end"))
    rows = named.join(by_shuffle(hit), ["arch_id", "end"]).select("arch_id", "edge", "threat", "severity", "control").distinct()
    return named.select("arch_id", "edge").distinct().join(rows, ["arch_id", "edge"], "left") if keep_all else rows


def records(nodes: DataFrame, edges: DataFrame, mode: str = "dataset") -> DataFrame:
    """SR9: arch_id and the assembled security record of every graph: assessment, threats by graph, node and edge."""
    assessed = staged(assessment(nodes, mode), "assessed")
    found = staged(threats(assessed), "threats")
    about = {t[0]: t[2] for t in dims.THREATS}
    told = reduce(lambda c, t: c.when(F.col("threat") == t, F.lit(about[t])), about, F.when(F.lit(False), F.lit("")))
    entry = F.struct(F.col("threat"), F.col("severity"), F.col("control").alias("missing_control"), "severity_level")
    listed = found.groupBy("arch_id").agg(F.array_sort(F.collect_list(F.struct("control", "place", "threat", "severity", "severity_level", told.alias("description")))).alias("l"))
    listed = listed.select("arch_id", F.transform("l", lambda t: F.struct(t["threat"].alias("name"), t["severity"].alias("severity"), t["description"].alias("description"), t["control"].alias("missing_control"), t["severity_level"].alias("severity_level"))).alias("threats"))
    level = found.select("arch_id", "threat", "severity_level")
    by = []
    for name, rows in (("node", node_threats(nodes, found).withColumnRenamed("node_id", "node")), ("edge", edge_threats(nodes, edges, found))):
        of_one = rows.join(by_shuffle(level), ["arch_id", "threat"]).groupBy("arch_id", name).agg(F.array_sort(F.collect_list(entry)).alias("threats"))
        by.append(of_one.groupBy("arch_id").agg(F.array_sort(F.collect_list(F.struct(name, "threats"))).alias(f"{name}_threats")))
    out = reduce(lambda a, b: a.join(by_shuffle(b), "arch_id", "left"), [listed, *by], assessed)
    none = lambda c: F.coalesce(c, F.array().cast(dict(out.dtypes)[c]))
    surface = F.struct(F.col("surface_score").alias("attack_surface_score"), *dims.SURFACE)
    record = F.struct(
        F.col("required").alias("required_controls"), F.col("missing").alias("missing_controls"), none("threats").alias("threats"), "recommendations", F.col("risk").alias("risk_level"), F.col("score").alias("security_score"),
        surface.alias("attack_surface"), F.col("summary").alias("security_summary"), none("node_threats").alias("node_threats"), none("edge_threats").alias("edge_threats"),
    )
    return out.select("arch_id", record.alias("security"))


def worst_severity(rows: DataFrame, *key: str) -> DataFrame:
    """AG29."""
    order = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "HIGH", 2).when(F.col("severity") == "MEDIUM", 1).otherwise(0)
    return rows.groupBy(*key).agg(F.max_by("severity", order).alias("worst"))


def controls_for(spark, architecture_type: str) -> DataFrame:
    """SR11."""
    return dims.controls(spark).where(F.array_contains("required_for", architecture_type)).select("name", "risk_level", "category")


def with_visuals(nodes: DataFrame) -> DataFrame:
    """PR16: icon and layer of every node."""
    return nodes.select("arch_id", "node_id", "node_type", scalar.icon(F.col("node_id")).alias("icon"), scalar.layer(F.col("node_type")).alias("layer"))
