"""The request path over a table of raw model outputs: parse, validate, assess, assemble."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import parsing, scalar
from lattica.operators import graph, security
from lattica.sources.staging import staged

IMPORT = "nodes array<struct<id:string,kind:string>>, edges array<struct<source:string,target:string,label:string>>"


def respond(raw: DataFrame, id_col: str, text_col: str, run_security: bool = True) -> DataFrame:
    """SR12, SC13, SR13: per raw output its graph with visuals, validation and security, or error and detail.

    status: 200, 400 for blank text, 422 where no graph can be read.  Without security its columns are absent.
    """
    rows = raw.select(F.col(id_col).cast("long").alias("arch_id"), F.trim(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    parsed = staged(parsing.with_payload(rows, "text"), "parsed")
    nodes, edges = parsing.exploded(parsed.where("error IS NULL"), "arch_id")
    out = parsed.select("arch_id", F.when(F.col("text") == "", "no_text").otherwise(F.col("error")).alias("error"), "nodes", "edges")
    out = out.withColumn("status", F.when(F.col("error").isNull(), 200).when(F.col("error") == "no_text", 400).otherwise(422))
    out = out.withColumn("detail", F.when(F.col("error").isNotNull(), F.struct(F.lit("INVALID_INPUT").alias("code"), F.col("error").alias("message"))))
    shown = F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), n["type"].alias("type"), scalar.icon(n["id"]).alias("icon"), scalar.layer(n["type"]).alias("layer")))
    lines = F.transform("edges", lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), e["label"].alias("label"), scalar.dashed(e["label"]).alias("dashed")))
    out = out.withColumn("nodes", shown).withColumn("edges", lines)
    weak = graph.connectivity(nodes, edges).select("arch_id", "structurally_weak")
    out = out.join(graph.validation(nodes, edges).select("arch_id", "valid", "errors", "warnings"), "arch_id", "left").join(weak, "arch_id", "left")
    if not run_security:
        return out
    assessed = security.assessment(nodes, "runtime").select("arch_id", "score", "risk", "missing", "required", "recommendations", "surface_score")
    found = security.threats(assessed).groupBy("arch_id").agg(F.array_sort(F.collect_list("threat")).alias("threats"))
    return out.join(assessed, "arch_id", "left").join(found, "arch_id", "left")


def imported(df: DataFrame, text_col: str) -> DataFrame:
    """SC14: a saved graph as JSON; nodes without id and dangling edges go, kind and label have defaults."""
    g = F.from_json(text_col, IMPORT)
    kept = F.filter(F.coalesce(g["nodes"], F.array().cast("array<struct<id:string,kind:string>>")), lambda n: F.coalesce(n["id"], F.lit("")) != "")
    nodes = F.transform(kept, lambda n: F.struct(n["id"].alias("id"), F.coalesce(n["kind"], F.lit("service")).alias("kind")))
    named = df.withColumn("nodes", nodes).withColumn("_edges", g["edges"])
    ids = F.transform("nodes", lambda n: n["id"])
    fits = F.filter(F.coalesce("_edges", F.array().cast("array<struct<source:string,target:string,label:string>>")), lambda e: F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"]))
    return named.withColumn("edges", F.transform(fits, lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), exact_label(e["label"]).alias("label")))).drop("_edges")


def exact_label(label):
    """PR26: only the labels themselves count."""
    from lattica.functions import dims

    return F.when(F.trim(label).isin(dims.EDGE_LABELS), F.trim(label)).otherwise(dims.DEFAULT_LABEL)


#: UD1: named steps from DataFrame to DataFrame, open to additions.
VARIANTS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def variant(name: str):
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        VARIANTS[name] = f
        return f

    return add


def all_variants(df: DataFrame) -> DataFrame:
    """Every registered variant of df, told apart by a column."""
    out = None
    for name, f in sorted(VARIANTS.items()):
        one = f(df).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
