"""Gates, reviews, key audits, graph edits and model hooks as functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import dims, parsing, scalar
from lattica.operators import extract

# ---------------------------------------------------------------- gates


def checks(counts: DataFrame, failed: dict[str, str]) -> DataFrame:
    """AG28: one row per check of a one-row table of counts: check, failed, pass, all_pass.  failed: check to column."""
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("failed"), (F.coalesce(F.col(c), F.lit(0)) == 0).alias("pass")) for k, c in failed.items()))
    return counts.select(rows.alias("c")).select(F.explode("c").alias("x"), F.forall("c", lambda x: x["pass"]).alias("all_pass")).select("x.*", "all_pass")


def artifact_gate(records: DataFrame, parents: DataFrame, template: str, n_records: int, splits: dict[str, int], max_length: int) -> DataFrame:
    """QG2: the twelve checks of a finished training file.

    records: id, place (from 1), instruction, response (JSON), nodes, edges, parent_source_id,
    parent_architecture_id, method, max_nodes, max_edges, split, n_tokens.  parents: parent_source_id,
    instruction, nodes, edges.  A duplicate edge has the same label too.
    """
    p = parents.select(F.col("parent_source_id"), F.col("instruction").alias("p_instruction"), F.col("nodes").alias("p_nodes"), F.col("edges").alias("p_edges"), F.lit(True).alias("known"))
    r = records.join(p, "parent_source_id", "left")
    known = F.coalesce("known", F.lit(False))
    ids, keys = F.transform("nodes", lambda n: n["id"]), extract.edge_keys(F.col("edges"))
    outside = lambda e: ~F.array_contains(ids, e["source"]) | ~F.array_contains(ids, e["target"])
    broken = (
        (F.size(F.array_distinct(ids)) < F.size(ids)) | F.exists("nodes", lambda n: ~n["type"].isin(dims.NODE_TYPES)) | F.exists("edges", lambda e: ~e["label"].isin(dims.EDGE_LABELS) | outside(e) | (e["source"] == e["target"]))
        | (F.size(F.array_distinct(keys)) < F.size(keys)) | (F.size("nodes") > dims.MAX_NODES) | (F.size("edges") > dims.MAX_EDGES)
    )
    kinds = dict(records.dtypes)
    said = F.from_json("response", f"nodes {kinds['nodes']}, edges {kinds['edges']}")
    faults = {
        "sequential unique ids": F.col("id") != F.format_string("SFT-%06d", F.col("place").cast("long")),
        "contract issues": broken,
        "response fidelity": ~(said["nodes"].eqNullSafe(F.col("nodes")) & said["edges"].eqNullSafe(F.col("edges"))),
        "parent architecture fidelity": known & ~(F.col("p_nodes").eqNullSafe(F.col("nodes")) & F.col("p_edges").eqNullSafe(F.col("edges"))),
        "prompt drift": known & ~F.col("instruction").eqNullSafe(scalar.render(template, F.col("p_instruction"))),
        "provenance present": (F.coalesce("parent_source_id", F.lit("")) == "") | (F.coalesce("parent_architecture_id", F.lit("")) == ""),
        "parents in manifest": ~known,
        "subgraph contract": known & ~(F.col("method").eqNullSafe(F.lit(extract.METHOD)) & F.col("max_nodes").eqNullSafe(F.lit(dims.MAX_NODES)) & F.col("max_edges").eqNullSafe(F.lit(dims.MAX_EDGES))),
        "sequence length": F.col("n_tokens") > max_length,
    }
    of_split = {f"split {k}": F.count_if(known & (F.col("split") == k)) for k in splits}
    one = r.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in faults.items()), *(c.alias(k) for k, c in of_split.items()))
    torn = r.where(known).groupBy(F.array_sort(ids).alias("cluster")).agg(F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("torn"))
    wrong = sum(((F.col(f"split {k}") != n).cast("int") for k, n in splits.items()), F.lit(0))
    one = one.join(F.broadcast(torn)).withColumn("count", (F.col("n") != n_records).cast("int")).withColumn("splits", wrong)
    return checks(one, {"record count": "count", **{k: k for k in faults}, "split counts exact": "splits", "cluster integrity": "torn"})


def phase_gates(hashes: DataFrame, files: list[str], evaluation: DataFrame, n_expected: int, needed: tuple[str, ...] = ("adapter_config.json", "adapter_model.safetensors")) -> DataFrame:
    """QG3: gate, pass, all_pass.  hashes: gate, expected, actual; evaluation: one row of n and the rates."""
    rates = {
        "G5 parse_rate >= 0.80": F.col("parse_rate") >= 0.80, "G5 schema_valid_rate >= 0.80": F.col("schema_valid_rate") >= 0.80, "G5 connected_rate == 1.0": F.col("connected_rate") == 1.0,
        "G5 structurally_weak_rate == 0.0": F.coalesce("structurally_weak_rate", 1 - F.col("connected_rate") + F.col("orphan_rate")) == 0.0, "G5 guardrail on parsed == 1.0": F.col("within_guardrail") == F.col("parse_ok"),
    }
    found = {"G3 adapter exists": F.lit(set(needed) <= set(files)), "G4 generation evaluation": (F.col("n") == n_expected) & F.col("parse_rate").isNotNull(), **rates}
    rows = F.array(*(F.struct(F.lit(k).alias("gate"), F.coalesce(c, F.lit(False)).alias("pass")) for k, c in found.items()))
    gates = evaluation.select(F.explode(rows).alias("r")).select("r.*")
    gates = hashes.select("gate", F.col("actual").eqNullSafe(F.col("expected")).alias("pass")).unionByName(gates)
    return gates.join(F.broadcast(gates.agg(F.bool_and("pass").alias("all_pass"))))


def contract_clauses(records: DataFrame) -> DataFrame:
    """FI11: id and one boolean per clause of the record's declared schema."""
    unique = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    clauses = {
        "id_form": F.col("id").rlike("^CSA-[0-9]{6}$"), "instruction_length": F.length("instruction").between(20, 2000), "node_count": F.size("nodes").between(2, 100), "edge_count": F.size("edges").between(1, 200),
        "node_ids": F.forall("nodes", lambda n: F.length(n["id"]) > 0), "node_types": F.forall("nodes", lambda n: n["type"].isin(dims.NODE_TYPES)), "edge_labels": F.forall("edges", lambda e: e["label"].isin(dims.EDGE_LABELS)),
        "nodes_unique": unique(F.col("nodes")), "edges_unique": unique(F.col("edges")), "risk_level": F.col("risk_level").isin("LOW", "MEDIUM", "HIGH"), "score": F.col("score").between(0, 100),
    }
    return records.select("id", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in clauses.items()))


def review(samples: DataFrame, decisions: DataFrame, id_col: str, text_col: str, limit: int | None = None) -> DataFrame:
    """QG5: id, logged decision (a, r, s), edited, reviewed text (approved rows only) of the samples that a review reached.

    decisions: id, decision (a, r, e, s or q), new_text.  Samples go by id; an edit counts as approval; q
    ends the review; samples without a decision are not reached.  limit: decisions other than skips.
    """
    d = decisions.select(F.col(id_col), F.lower(F.trim("decision")).alias("decision"), F.trim("new_text").alias("new_text"))
    rows = samples.select(id_col, text_col).join(d.where(F.col("decision").isin("a", "r", "e", "s", "q")), id_col)
    stop = rows.agg(F.min(F.when(F.col("decision") == "q", F.col(id_col))).alias("_stop"))
    rows = rows.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col(id_col) < F.col("_stop"))).drop("_stop")
    if limit is not None:
        last = rows.where("decision <> 's'").orderBy(id_col).limit(limit).agg(F.max(id_col).alias("_last"), F.count("*").alias("_n"))
        rows = rows.join(F.broadcast(last)).where((F.col("_n") < limit) | (F.col(id_col) <= F.col("_last"))).drop("_last", "_n")
    edited = F.col("decision") == "e"
    text = F.when(edited & (F.coalesce("new_text", F.lit("")) != ""), F.col("new_text")).otherwise(F.col(text_col))
    return rows.select(id_col, F.when(edited, "a").otherwise(F.col("decision")).alias("decision"), edited.alias("edited"), F.when(F.col("decision").isin("a", "e"), text).alias("reviewed_text"))


def extra_keys(json_text: Column, allowed: list[str]) -> Column:
    """PR25, SE6: the keys of a JSON object that are not allowed, sorted."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>")), F.array(*map(F.lit, allowed))))


# ---------------------------------------------------------------- graph edits


def connect(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """GR23: edges with those of wanted (arch_id, source, target) that the editor allows.

    Allowed are ui to service and service to database or cache, once per pair; the label goes by the target.
    """
    end = lambda c: nodes.select("arch_id", F.col("node_id").alias(c), F.col("node_type").alias(f"{c}_type")).distinct()
    typed = wanted.select("arch_id", "source", "target").distinct().join(end("source"), ["arch_id", "source"]).join(end("target"), ["arch_id", "target"])
    fits = ((F.col("source_type") == "ui") & (F.col("target_type") == "service")) | ((F.col("source_type") == "service") & F.col("target_type").isin("database", "cache"))
    label = F.when(F.col("target_type") == "database", "DB Query").when(F.col("target_type") == "cache", "Cache").otherwise(dims.DEFAULT_LABEL)
    fresh = typed.where(fits).join(edges.select("arch_id", "source", "target"), ["arch_id", "source", "target"], "left_anti")
    return edges.select("arch_id", "source", "target", "label").unionByName(fresh.select("arch_id", "source", "target", label.alias("label")))


def clone(nodes: DataFrame, chosen: DataFrame, suffix: str = "-copy") -> DataFrame:
    """GR23: nodes with a copy of each chosen one (arch_id, node_id), without its edges."""
    copies = nodes.join(chosen.select("arch_id", "node_id").distinct(), ["arch_id", "node_id"], "left_semi")
    return nodes.unionByName(copies.withColumn("node_id", F.concat("node_id", F.lit(suffix))).select(*nodes.columns))


def drop_into(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """GR23, JO16: points (arch_id, node_id, x, y) with the container (arch_id, container, x0, y0, x1, y1) of their graph that holds them, the least of several; null outside all."""
    b = boxes.select("arch_id", "container", "x0", "y0", "x1", "y1")
    inside = points.join(b, "arch_id").where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return points.select("arch_id", "node_id").join(inside.groupBy("arch_id", "node_id").agg(F.min("container").alias("container")), ["arch_id", "node_id"], "left")


# ---------------------------------------------------------------- model hooks


def predicted(df: DataFrame, text_col: str, load: Callable[[], Callable[[str, int, bool], str]], attempts: int = 3) -> DataFrame:
    """ML1, ML6, ST3: df with raw, attempts and failure: what a model answers to a text.

    load() runs once in every worker and returns answer(text, attempt, strict).  An answer without a
    readable object is asked for again, at last once with strict; then failure says why it can't be read.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = None
        for frame in it:
            answer = answer or load()
            rows = []
            for text in frame[text_col]:
                for attempt in range(1, attempts + 2):
                    raw = answer(text, attempt, attempt > attempts)
                    found = parsing.find_object(raw or "", comments=True)
                    if found is not None:
                        break
                rows.append((raw, attempt, found is None))
            out = pd.DataFrame(rows, columns=["raw", "attempts", "_lost"], index=frame.index)
            yield pd.concat([frame, out], axis=1)

    kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    out = df.mapInPandas(run, f"{kinds}, raw string, attempts int, _lost boolean")
    return out.withColumn("failure", F.when(F.col("_lost"), scalar.parse_failure(F.col("raw")))).drop("_lost")


def masked(df: DataFrame, prompt: str, response: str, tokens: Callable[[Column], Column], max_length: int, ignore: int = -100) -> DataFrame:
    """ML2: df with tokens and labels of prompt and response, cut to max_length; the prompt's labels are `ignore`.

    tokens: a text column to an array of ids.
    """
    p, r = tokens(F.col(prompt)), tokens(F.col(response))
    cut = lambda c: F.slice(c, 1, max_length)
    return df.withColumn("tokens", cut(F.concat(p, r))).withColumn("labels", cut(F.concat(F.transform(p, lambda _: F.lit(ignore).cast("long")), r)))


def hashed_words(text: Column) -> Column:
    """A tokenizer stand-in: words between spaces, as numbers below 50,000."""
    words = F.filter(F.split(text, " ", -1), lambda w: w != "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % 50_000).cast("long"))
