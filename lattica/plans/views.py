"""Graphs derived from the driver's tables, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import scalar

SECURITY_IDS = ["web-ui", "payment-api", "orders-db", "session-cache", "event-queue", "order-service", "patient-portal", "shop-cart", "waf", "mfa", "monitoring", "siem", "rbac", "api gateway", "audit logging", "worker"]
_EVENT_TYPES = {"view": "ui", "click": "service", "purchase": "database", "signup": "queue"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.lit("cache")
    for event, node in _EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == event, node).otherwise(kind)
    return e.select(
        (F.col("user_id") * 10 + F.dayofmonth("ts") % 5).alias("arch_id"),
        "event_id",
        "ts",
        F.concat("event_type", F.lit("-"), (F.col("event_id") % 4).cast("string")).alias("node_id"),
        kind.alias("node_type"),
    )


def event_graph(spark: SparkSession, sf_dir: str, dirty: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): steps of a user's events within 36 hours.  dirty keeps self-loops and repeats."""
    events = _event_nodes(spark, sf_dir)
    nodes = events.select("arch_id", "node_id", "node_type").distinct()
    step = Window.partitionBy("arch_id").orderBy("ts", "event_id")
    moves = events.select(
        "arch_id", F.col("event_id").alias("pos"), "ts", F.col("node_id").alias("source"), F.col("node_type").alias("source_type"),
        F.lead("node_id").over(step).alias("target"), F.lead("node_type").over(step).alias("target_type"), F.lead("ts").over(step).alias("next_ts"),
    )
    moves = moves.where("target IS NOT NULL AND next_ts <= ts + INTERVAL '36' HOUR")
    label = scalar.infer_label(F.col("source_type"), F.col("target_type")).alias("label")
    if dirty:
        return nodes, moves.select("arch_id", "pos", "source", "target", label)
    return nodes, moves.where("source <> target").select("arch_id", "source", "target", label).distinct()


EG = """
ev AS (SELECT user_id*10 + CAST(extract(day FROM ts) AS INT)%5 AS arch_id, event_id, ts,
  event_type||'-'||CAST(event_id%4 AS VARCHAR) AS node_id,
  CASE event_type WHEN 'view' THEN 'ui' WHEN 'click' THEN 'service' WHEN 'purchase' THEN 'database' WHEN 'signup' THEN 'queue' ELSE 'cache' END AS node_type FROM events),
moves AS (SELECT arch_id, event_id AS pos, ts, node_id AS source, node_type AS st,
  lead(node_id) OVER w AS target, lead(node_type) OVER w AS tt, lead(ts) OVER w AS nts
  FROM ev WINDOW w AS (PARTITION BY arch_id ORDER BY ts, event_id)),
dirty AS (SELECT arch_id, pos, source, target,
  CASE WHEN st='service' AND tt='database' THEN 'DB Query' WHEN st='service' AND tt='queue' THEN 'Async' WHEN st='service' AND tt='cache' THEN 'Cache' ELSE 'HTTP' END AS label
  FROM moves WHERE target IS NOT NULL AND nts <= ts + INTERVAL '36' HOUR),
nodes AS (SELECT DISTINCT arch_id, node_id, node_type FROM ev),
edges AS (SELECT DISTINCT arch_id, source, target, label FROM dirty WHERE source <> target)
"""


def security_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): node ids are security-related words; edges join a graph's nodes in order of id."""
    e = table(spark, sf_dir, "events").where("event_id % 3 <> 0")
    word = F.element_at(F.array(*map(F.lit, SECURITY_IDS)), (F.col("event_id") % 16 + 1).cast("int"))
    nodes = e.select((F.col("user_id") * 10 + F.dayofmonth("ts") % 10).alias("arch_id"), word.alias("node_id")).distinct()
    nodes = nodes.select("arch_id", "node_id", scalar.derive_type(F.col("node_id")).alias("node_type"))
    step = Window.partitionBy("arch_id").orderBy("node_id")
    edges = nodes.select("arch_id", F.col("node_id").alias("source"), F.lead("node_id").over(step).alias("target"), F.lit("HTTP").alias("label")).where("target IS NOT NULL")
    return nodes, edges


def _sql_first(text: str, words: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN contains({text}, '{w}') THEN '{v}'" for w, v in words.items())
    return f"CASE {whens} ELSE {default} END"


def _sg() -> str:
    from lattica.functions.dims import TYPE_WORDS

    words = ", ".join(f"'{w}'" for w in SECURITY_IDS)
    return f"""
sn AS (SELECT DISTINCT user_id*10 + CAST(extract(day FROM ts) AS INT)%10 AS arch_id, list_extract([{words}], CAST(event_id%16+1 AS INT)) AS node_id FROM events WHERE event_id%3 <> 0),
nodes AS (SELECT arch_id, node_id, {_sql_first("lower(node_id)", TYPE_WORDS, "'service'")} AS node_type FROM sn),
edges AS (SELECT * FROM (SELECT arch_id, node_id AS source, lead(node_id) OVER (PARTITION BY arch_id ORDER BY node_id) AS target, 'HTTP' AS label FROM nodes) WHERE target IS NOT NULL)
"""


SG = _sg()
