"""Structural operators over exploded graphs.

nodes: arch_id, node_id, node_type; edges: arch_id, source, target, label.  Where list order counts,
both carry pos.  One graph is small (its nodes are collected per graph); there may be any number.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import dims, scalar


def proper_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JO6: edges whose ends are nodes of the graph, without self-loops; with the ends' types (JO13)."""
    end = lambda c: nodes.select("arch_id", F.col("node_id").alias(c), F.col("node_type").alias(f"{c}_type"))
    return edges.where("source <> target").join(end("source"), ["arch_id", "source"]).join(end("target"), ["arch_id", "target"])


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JO6: edges with an end that is no node."""
    end = lambda c: nodes.select("arch_id", F.col("node_id").alias(c), F.lit(True).alias(f"has_{c}")).distinct()
    joined = edges.join(end("source"), ["arch_id", "source"], "left").join(end("target"), ["arch_id", "target"], "left")
    return joined.where("has_source IS NULL OR has_target IS NULL").select(*edges.columns)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("arch_id", F.explode(F.array("source", "target")).alias("node_id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR20: edges at each node, without self-loops and dangling ones."""
    n = endpoints(proper_edges(nodes, edges)).groupBy("arch_id", "node_id").agg(F.count("*").alias("degree"))
    return nodes.join(n, ["arch_id", "node_id"], "left").select("arch_id", "node_id", "node_type", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def graph_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes and n_edges of every graph that has either."""
    n = nodes.groupBy("arch_id").agg(F.count("*").alias("n_nodes"))
    m = edges.groupBy("arch_id").agg(F.count("*").alias("n_edges"))
    zero = F.lit(0).cast("long")
    return n.join(m, "arch_id", "full").select("arch_id", F.coalesce("n_nodes", zero).alias("n_nodes"), F.coalesce("n_edges", zero).alias("n_edges"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR5: per graph, the nodes that no edge names (a self-loop counts as an edge), and the flag."""
    isolated = nodes.join(endpoints(edges).distinct(), ["arch_id", "node_id"], "left_anti").groupBy("arch_id").agg(F.count("*").alias("isolated"))
    sizes = graph_sizes(nodes, edges).join(isolated, "arch_id", "left")
    n = F.coalesce("isolated", F.lit(0).cast("long"))
    return sizes.select("arch_id", "n_nodes", "n_edges", n.alias("isolated"), ((F.col("n_nodes") == 0) | (F.col("n_edges") == 0) | (n > 0)).alias("has_orphan"))


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR9: arch_id, node_id, component (the least id of the node's weakly connected component).

    Edges are collected per graph; union-find runs over Arrow batches of whole graphs.
    """
    by_node = nodes.select("arch_id", F.col("node_id").alias("a"), F.col("node_id").alias("b"))
    linked = proper_edges(nodes, edges).select("arch_id", F.col("source").alias("a"), F.col("target").alias("b"))
    graphs = by_node.unionByName(linked).groupBy("arch_id").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))

    def label(it):
        for batch in it:
            arch, node, root = [], [], []
            for graph, pairs in zip(batch["arch_id"].to_pylist(), batch["pairs"].to_pylist()):
                parent = {p["a"]: p["a"] for p in pairs}

                def find(x, parent=parent):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for p in pairs:
                    low, high = sorted((find(p["a"]), find(p["b"])))
                    parent[high] = low
                arch += [graph] * len(parent)
                node += parent
                root += map(find, parent)
            yield pa.record_batch({"arch_id": pa.array(arch, pa.int64()), "node_id": pa.array(node, pa.string()), "component": pa.array(root, pa.string())})

    return graphs.select(F.col("arch_id").cast("long").alias("arch_id"), "pairs").mapInArrow(label, "arch_id long, node_id string, component string")


def component_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR10, DO5: components per graph and the largest one's share of the nodes."""
    sizes = component_labels(nodes, edges).groupBy("arch_id", "component").agg(F.count("*").alias("size"))
    return sizes.groupBy("arch_id").agg(F.count("*").alias("components"), F.round(F.max("size") / F.sum("size"), 4).alias("largest_share"))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR4, GR5, GR6: connected, has_orphan and structurally_weak of every graph."""
    parts = component_counts(nodes, edges).select("arch_id", "components")
    joined = orphans(nodes, edges).join(parts, "arch_id", "left")
    connected = F.coalesce(F.col("components") == 1, F.lit(False))
    return joined.select("arch_id", connected.alias("connected"), "has_orphan", (F.col("has_orphan") | ~connected).alias("structurally_weak"))


def issues(nodes: DataFrame, edges: DataFrame, max_nodes: int = dims.MAX_NODES, max_edges: int = dims.MAX_EDGES) -> DataFrame:
    """GR7: arch_id, rule, severity, subject; one row per finding.  nodes and edges carry pos."""

    def found(df: DataFrame, rule: str, severity: str, subject: Column) -> DataFrame:
        return df.select("arch_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"))

    pair = F.concat("source", F.lit("->"), "target")
    nth_node = F.row_number().over(Window.partitionBy("arch_id", "node_id").orderBy("pos"))
    nth_edge = F.row_number().over(Window.partitionBy("arch_id", "source", "target").orderBy("pos"))
    sizes = graph_sizes(nodes, edges)
    parts = [
        found(nodes.where(~F.coalesce(F.col("node_type").isin(dims.NODE_TYPES), F.lit(False))), "unsupported_node_type", "error", F.col("node_id")),
        found(nodes.withColumn("nth", nth_node).where("nth > 1"), "node_id_collision", "error", F.col("node_id")),
        found(dangling(nodes, edges), "dangling_edge", "error", pair),
        found(edges.where("source = target"), "self_loop", "warning", pair),
        found(edges.withColumn("nth", nth_edge).where("nth > 1"), "duplicate_edge", "warning", pair),
        found(edges.where(~F.coalesce(F.col("label").isin(dims.EDGE_LABELS), F.lit(False))), "unsupported_edge_label", "warning", pair),
        found(sizes.where((F.col("n_nodes") > max_nodes) | (F.col("n_edges") > max_edges)), "size_guardrail", "error", F.lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR8: valid (no error), errors and warnings of every graph."""
    by_graph = issues(nodes, edges).groupBy("arch_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = F.lit(0).cast("long")
    joined = graph_sizes(nodes, edges).join(by_graph, "arch_id", "left")
    return joined.select("arch_id", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"), (F.coalesce("errors", zero) == 0).alias("valid"))


def first_edges(edges: DataFrame, *key: str) -> DataFrame:
    """WI3, GR21: the first edge by pos of every (source, target) or other key, without self-loops."""
    nth = F.row_number().over(Window.partitionBy("arch_id", *(key or ("source", "target"))).orderBy("pos"))
    return edges.where("source <> target").withColumn("nth", nth).where("nth = 1").drop("nth")


def gate(nodes: DataFrame, edges: DataFrame, max_nodes: int = dims.MAX_NODES, max_edges: int = dims.MAX_EDGES) -> DataFrame:
    """QG1 over structure: the first reason to reject a graph, or accepted."""
    reason = (
        F.when((F.col("n_nodes") == 0) | (F.col("n_edges") == 0), "empty graph")
        .when(F.col("isolated") > 0, "isolated node(s) present")
        .when((F.col("n_nodes") > max_nodes) | (F.col("n_edges") > max_edges), "size_guardrail")
        .otherwise("accepted")
    )
    return orphans(nodes, edges).select("arch_id", "n_nodes", "n_edges", reason.alias("reason"))


def roles(nodes: DataFrame) -> DataFrame:
    """PR21: matches of each role's words in the id; a type also makes a data node."""
    n = lambda words: scalar.matches(F.col("node_id"), words)
    entry, data, security = n(dims.ENTRY_WORDS), n(dims.DATA_WORDS), n(dims.SECURITY_WORDS)
    return nodes.select("arch_id", "node_id", "node_type", entry.alias("entry_matches"), data.alias("data_matches"), security.alias("security_matches"))


def node_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """PR22: score and root score of every node."""
    d = roles(nodes).join(degrees(nodes, edges).select("arch_id", "node_id", "degree"), ["arch_id", "node_id"])
    weight = F.lit(1)
    for t, w in dims.TYPE_ROLE.items():
        weight = F.when(F.col("node_type") == t, w).otherwise(weight)
    is_entry = F.col("node_type") == "ui"
    capped = lambda c, w: F.lit(w) * F.least(F.col(c), F.lit(3))
    near = F.least(F.col("degree"), F.lit(5))
    score = weight + F.when(is_entry, 6).otherwise(0) + capped("entry_matches", 4) + capped("security_matches", 6) + capped("data_matches", 6)
    score = score + F.when(F.col("node_type").isin("database", "cache", "queue"), 5).otherwise(0) + near
    root = F.when(is_entry, 100).otherwise(0) + 25 * F.col("entry_matches") + 10 * F.col("security_matches") + 5 * F.col("data_matches") + near
    return d.select("arch_id", "node_id", score.cast("long").alias("score"), root.cast("long").alias("root_score"), (F.when(is_entry, 100).otherwise(0) + 25 * F.col("entry_matches")).cast("long").alias("entry_score"))


def main_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR11, GR12: per graph the component that extraction starts in, and its root."""
    scored = component_labels(nodes, edges).join(node_scores(nodes, edges), ["arch_id", "node_id"])
    comps = scored.groupBy("arch_id", "component").agg(
        F.max("entry_score").alias("entry"), F.count("*").alias("size"),
        F.min_by("node_id", F.struct(-F.col("root_score"), F.col("node_id"))).alias("root"),
    )
    best = F.row_number().over(Window.partitionBy("arch_id").orderBy(F.desc("entry"), F.desc("size"), "component"))
    return comps.withColumn("nth", best).where("nth = 1").select("arch_id", "component", "size", "root")


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """GR15: edges with both ends among chosen (arch_id, node_id)."""
    out = edges
    for c in ("source", "target"):
        out = out.join(chosen.select("arch_id", F.col("node_id").alias(c)), ["arch_id", c], "left_semi")
    return out.select(*edges.columns)


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR23: delete nodes and the edges at them."""
    left = nodes.join(gone.select("arch_id", "node_id"), ["arch_id", "node_id"], "left_anti")
    for c in ("source", "target"):
        edges = edges.join(gone.select("arch_id", F.col("node_id").alias(c)), ["arch_id", c], "left_anti")
    return left, edges


def canonical_ids(nodes: DataFrame) -> DataFrame:
    """WI1: arch_id, node_id, node_type, new_id: type and place of the id among those of its type."""
    nth = F.row_number().over(Window.partitionBy("arch_id", "node_type").orderBy("node_id"))
    return nodes.select("arch_id", "node_id", "node_type", F.concat("node_type", F.lit("-"), nth.cast("string")).alias("new_id"))


def canonicalize(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR19, JO14: nodes and edges under canonical ids; every end must be a node."""
    ids = canonical_ids(nodes)
    end = lambda c: ids.select("arch_id", F.col("node_id").alias(c), F.col("new_id").alias(f"new_{c}"))
    mapped = edges.join(end("source"), ["arch_id", "source"]).join(end("target"), ["arch_id", "target"])
    return ids.select("arch_id", F.col("new_id").alias("node_id"), "node_type"), mapped.select("arch_id", F.col("new_source").alias("source"), F.col("new_target").alias("target"), "label")


def fingerprints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """PR17, SP4, GR22: node-set key, full key with names, and structure key without names, per graph."""
    typed = proper_edges(nodes, edges)
    n = nodes.groupBy("arch_id").agg(
        F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("ids"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "node_id", "node_type"))), ",").alias("named"),
        F.array_join(F.array_sort(F.collect_list("node_type")), ",").alias("types"),
    )
    e = edges.groupBy("arch_id").agg(F.array_join(F.array_sort(F.collect_list(scalar.edge_key(F.col("source"), F.col("target"), F.col("label")))), ",").alias("named_edges"))
    s = typed.groupBy("arch_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(">", "source_type", "target_type", "label"))), ",").alias("type_edges"))
    joined = n.join(e, "arch_id", "left").join(s, "arch_id", "left")
    key = lambda *cs: F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in cs)), 256)
    return joined.select("arch_id", key("ids").alias("node_set_key"), key("named", "named_edges").alias("full_key"), key("types", "type_edges").alias("structure_key"))


def neighbourhood_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """DO1: a hash of every graph's multiset of node types with their labelled neighbours (one round)."""
    typed = proper_edges(nodes, edges)
    out = typed.select("arch_id", F.col("source").alias("node_id"), F.concat_ws(":", F.lit("out"), "label", "target_type").alias("side"))
    into = typed.select("arch_id", F.col("target").alias("node_id"), F.concat_ws(":", F.lit("in"), "label", "source_type").alias("side"))
    sides = out.unionByName(into).groupBy("arch_id", "node_id").agg(F.array_join(F.array_sort(F.collect_list("side")), ";").alias("sides"))
    per_node = nodes.join(sides, ["arch_id", "node_id"], "left").select("arch_id", F.concat_ws("/", "node_type", F.coalesce("sides", F.lit(""))).alias("mark"))
    return per_node.groupBy("arch_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("mark")), ","), 256).alias("wl_key"))
