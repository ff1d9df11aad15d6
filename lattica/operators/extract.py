"""Bounded connected subgraphs with provenance, and their independent verification.

Growing a subgraph is sequential within one graph, so whole graphs travel in Arrow batches; graphs
are independent of each other.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import dims, scalar
from lattica.operators import security
from lattica.sources.staging import by_shuffle, staged

SUBGRAPH = "arch_id long, nodes array<struct<id:string,type:string>>, edges array<struct<source:string,target:string,label:string>>, reason string"
#: How a record says it was made, and the keys of its parts.
METHOD, VERSION = "sacce_connected_subgraph_v1", "1.0.0"
PROVENANCE = ["parent_source_id", "parent_architecture_id", "transformation_method", "transformation_version", "selected_node_ids", "selected_edge_ids", "node_retention_ratio", "edge_retention_ratio"]
SECURITY = ["required_controls", "missing_controls", "threats", "recommendations", "risk_level", "security_score", "attack_surface", "security_summary"]


def nested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per graph: nodes and edges as arrays in order of pos, else of their values."""
    n_key = ["pos", "node_id", "node_type"] if "pos" in nodes.columns else ["node_id", "node_type"]
    e_key = ["pos", "source", "target", "label"] if "pos" in edges.columns else ["source", "target", "label"]
    n = nodes.groupBy("arch_id").agg(F.array_sort(F.collect_list(F.struct(*n_key))).alias("n"))
    e = edges.groupBy("arch_id").agg(F.array_sort(F.collect_list(F.struct(*e_key))).alias("e"))
    joined = n.join(e, "arch_id", "full")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    nodes_kind, edges_kind = "array<struct<id:string,type:string>>", "array<struct<source:string,target:string,label:string>>"
    return joined.select(
        F.col("arch_id").cast("long").alias("arch_id"),
        empty(F.transform("n", lambda x: F.struct(x["node_id"].alias("id"), x["node_type"].alias("type"))), nodes_kind).alias("nodes"),
        empty(F.transform("e", lambda x: F.struct(x["source"], x["target"], x["label"])), edges_kind).alias("edges"),
    )


class _Graph:
    """One graph's adjacency, roles and scores."""

    def __init__(self, nodes: list[dict], edges: list[dict]) -> None:
        self.type = {n["id"]: n["type"] for n in nodes}
        self.edges = [e for e in edges if e["source"] in self.type and e["target"] in self.type]
        self.near: dict[str, set[str]] = {i: set() for i in self.type}
        self.degree = dict.fromkeys(self.type, 0)
        for e in self.edges:
            s, t = e["source"], e["target"]
            if s != t:
                self.near[s].add(t)
                self.near[t].add(s)
                self.degree[s] += 1
                self.degree[t] += 1
        hits = lambda i, words: sum(w in i.lower() for w in words)
        self.entry, self.data, self.guard = ({i: hits(i, w) for i in self.type} for w in (dims.ENTRY_WORDS, dims.DATA_WORDS, dims.SECURITY_WORDS))

    def is_data(self, i: str) -> bool:
        return self.type[i] in ("database", "cache", "queue") or self.data[i] > 0

    def entry_score(self, i: str) -> int:
        return 100 * (self.type[i] == "ui") + 25 * self.entry[i]

    def root_score(self, i: str) -> int:
        return self.entry_score(i) + 10 * self.guard[i] + 5 * self.data[i] + min(self.degree[i], 5)

    def order(self, i: str) -> tuple[int, str]:
        """Best first: falling score, then id."""
        kind = self.type[i]
        score = dims.TYPE_ROLE.get(kind, 1) + 6 * (kind == "ui") + 5 * (kind in ("database", "cache", "queue")) + min(self.degree[i], 5)
        return -(score + 4 * min(self.entry[i], 3) + 6 * min(self.guard[i], 3) + 6 * min(self.data[i], 3)), i

    def components(self) -> list[set[str]]:
        left, out = set(self.type), []
        while left:
            part, todo = set(), [min(left)]
            while todo:
                i = todo.pop()
                if i not in part:
                    part.add(i)
                    todo += self.near[i]
            left -= part
            out.append(part)
        return out

    def path(self, begin: set[str], goal: str) -> list[str]:
        """Shortest path from begin to goal without begin's own node; ties by id.  Empty if there is none."""
        came: dict[str, str | None] = dict.fromkeys(begin)
        todo = deque(sorted(begin))
        while todo and goal not in came:
            i = todo.popleft()
            for j in sorted(self.near[i] - came.keys()):
                came[j] = i
                todo.append(j)
        if goal not in came:
            return []
        out = [goal]
        while came[out[-1]] not in begin:
            out.append(came[out[-1]])
        return out[::-1]

    def weight(self, e: dict) -> int:
        ends = (e["source"], e["target"])
        return dims.LABEL_WEIGHT.get(e["label"], 1) + sum(3 * self.is_data(i) + 4 * (self.guard[i] > 0) for i in ends)


def grow(nodes: list[dict], edges: list[dict], max_nodes: int = dims.MAX_NODES, max_edges: int = dims.MAX_EDGES) -> tuple[list[str], list[dict], str | None]:
    """GR16: (chosen ids in order, edges, reason for rejection)."""
    if len(nodes) < 2:
        return [], [], "insufficient_nodes"
    if not edges:
        return [], [], "no_edges"
    if len({n["id"] for n in nodes}) != len(nodes):
        return [], [], "duplicate_node_ids"
    g = _Graph(nodes, edges)
    part = min(g.components(), key=lambda c: (-max(map(g.entry_score, c)), -len(c), min(c)))
    if len(part) < 2:
        return [], [], "component_too_small"
    chosen = [min(part, key=lambda i: (-g.root_score(i), i))]
    data = sorted(filter(g.is_data, part), key=g.order)[:2]
    guards = sorted((i for i in part if g.guard[i] and i not in data and i != chosen[0]), key=g.order)[:2]
    for anchor in data + guards:  # anchors by their shortest way to what is chosen, if it fits
        if anchor not in chosen:
            way = g.path(set(chosen), anchor)
            if way and len(chosen) + len(way) <= max_nodes:
                chosen += way
    while len(chosen) < max_nodes:
        rim = set().union(*(g.near[i] for i in chosen)).difference(chosen)
        if not rim:
            break
        chosen.append(min(rim, key=g.order))
    inside = set(chosen)
    kept = [e for e in g.edges if e["source"] in inside and e["target"] in inside]
    if len(kept) > max_edges:
        tree: list[int] = []
        for k, i in enumerate(chosen[1:], 1):
            ends = [{i, j} for j in chosen[:k]]
            options = [x for x, e in enumerate(kept) if {e["source"], e["target"]} in ends]
            if not options:
                return [], [], "spanning_tree_disconnected"
            tree.append(min(options, key=lambda x: (kept[x]["label"] or "", kept[x]["source"], kept[x]["target"])))
        others = sorted(set(range(len(kept))) - set(tree), key=lambda x: (-g.weight(kept[x]), kept[x]["source"], kept[x]["target"], kept[x]["label"] or ""))
        kept = [kept[x] for x in tree + others[: max_edges - len(tree)]]
    return chosen, kept, None


def extract(graphs: DataFrame) -> DataFrame:
    """GR13, GR14, GR16: graphs (arch_id, nodes, edges) to bounded subgraphs, or the reason there is none."""
    edge = pa.struct([(c, pa.string()) for c in ("source", "target", "label")])
    schema = pa.schema([("arch_id", pa.int64()), ("nodes", pa.list_(pa.struct([("id", pa.string()), ("type", pa.string())]))), ("edges", pa.list_(edge)), ("reason", pa.string())])

    def run(it):
        for b in it:
            rows = []
            for arch, nodes, edges in zip(*(b[c].to_pylist() for c in ("arch_id", "nodes", "edges"))):
                broken = nodes is None or edges is None or any(n is None or n["id"] is None for n in nodes)
                chosen, kept, reason = ([], [], "malformed_record") if broken else grow(nodes, edges)
                kinds = {n["id"]: n["type"] for n in nodes} if chosen else {}
                rows.append({"arch_id": arch, "nodes": [{"id": i, "type": kinds[i]} for i in chosen], "edges": kept, "reason": reason})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _checked(graphs.select("arch_id", "nodes", "edges").mapInArrow(run, SUBGRAPH))


def _linked_up(nodes: Column, edges: Column) -> Column:
    """Whether the edges join all nodes: what the first one reaches after as many steps as there are nodes."""
    first = F.transform(F.slice(nodes, 1, 1), lambda n: n["id"])
    touches = lambda seen, e: F.array_contains(seen, e["source"]) | F.array_contains(seen, e["target"])
    step = lambda seen: F.array_distinct(F.concat(seen, F.flatten(F.transform(F.filter(edges, lambda e: touches(seen, e)), lambda e: F.array(e["source"], e["target"])))))
    reached = F.aggregate(nodes, first, lambda seen, _: step(seen))
    return F.size(F.array_except(F.transform(nodes, lambda n: n["id"]), reached)) == 0


def _violated(nodes: Column, edges: Column) -> Column:
    """The first rule of the graph contract that is broken; null if none is."""
    ids = F.transform(nodes, lambda n: n["id"])
    return (
        F.when((F.size(nodes) == 0) | (F.size(edges) == 0), "empty graph")
        .when((F.size(nodes) > dims.MAX_NODES) | (F.size(edges) > dims.MAX_EDGES), "size_guardrail")
        .when(F.exists(nodes, lambda n: ~F.coalesce(n["type"].isin(dims.NODE_TYPES), F.lit(False))), "unsupported_node_type")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "node_id_collision")
        .when(F.exists(edges, lambda e: ~F.array_contains(ids, e["source"]) | ~F.array_contains(ids, e["target"])), "dangling_edge")
    )


def _checked(out: DataFrame) -> DataFrame:
    """Subgraphs that fell apart or break the contract get a reason."""
    n, e = F.col("nodes"), F.col("edges")
    late = F.when(~_linked_up(n, e), "disconnected_subgraph").otherwise(F.concat(F.lit("contract_violation:"), _violated(n, e)))
    return out.withColumn("reason", F.coalesce("reason", late))


def edge_keys(edges: Column) -> Column:
    return F.transform(edges, lambda e: scalar.edge_key(e["source"], e["target"], e["label"]))


def ratio(part: Column, whole: Column) -> Column:
    return F.round(F.size(part) / F.greatest(F.lit(1), F.size(whole)), 4)


def records(graphs: DataFrame) -> DataFrame:
    """GR16, GR17: a record of every extracted subgraph: id, parent_id, nodes, edges, provenance and security."""
    found = staged(extract(graphs).where("reason IS NULL"), "subgraphs")
    n = found.select("arch_id", F.posexplode("nodes").alias("pos", "n")).select("arch_id", "pos", F.col("n.id").alias("node_id"), F.col("n.type").alias("node_type"))
    e = found.select("arch_id", F.posexplode("edges").alias("pos", "e")).select("arch_id", "pos", "e.*")
    parents = graphs.select("arch_id", F.col("nodes").alias("all_nodes"), F.col("edges").alias("all_edges"))
    source = F.col("arch_id").cast("string")
    made = (source, source, F.lit(METHOD), F.lit(VERSION), F.transform("nodes", lambda x: x["id"]), edge_keys(F.col("edges")), ratio(F.col("nodes"), F.col("all_nodes")), ratio(F.col("edges"), F.col("all_edges")))
    limits = F.struct(F.lit(dims.MAX_NODES).alias("max_nodes"), F.lit(dims.MAX_EDGES).alias("max_edges"))
    provenance = F.struct(*(c.alias(k) for k, c in zip(PROVENANCE, made)), limits.alias("contract"))
    with_parent = found.join(by_shuffle(parents), "arch_id").select(F.concat(source, F.lit("#S1")).alias("id"), "arch_id", source.alias("parent_id"), "nodes", "edges", provenance.alias("provenance"))
    return with_parent.join(by_shuffle(security.records(n, e)), "arch_id")


def verify(subgraphs: DataFrame, parents: DataFrame) -> DataFrame:
    """GR18, JO1, SE3: id and problems (sorted codes) of every record, by values of the parent alone.

    subgraphs: as records() makes them; a record without parent_id or with an unknown one has no parent.
    """
    p = parents.select(F.col("arch_id").cast("string").alias("_parent"), F.col("nodes").alias("p_nodes"), F.col("edges").alias("p_edges"))
    s = subgraphs.join(by_shuffle(p), F.col("parent_id") == F.col("_parent"), "left")
    n, e, made = F.col("nodes"), F.col("edges"), F.col("provenance")
    ids, parent_ids = F.transform(n, lambda x: x["id"]), F.transform("p_nodes", lambda x: x["id"])
    own, whole = edge_keys(e), edge_keys(F.col("p_edges"))
    times = lambda keys, k: F.size(F.filter(keys, lambda x: x == k))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    known = F.col("_parent").isNotNull()
    checks = {
        "parent_not_found": ~known,
        "fabricated_node": known & (F.size(F.array_except(ids, parent_ids)) > 0),
        "node_value_mismatch": known & F.exists(n, lambda x: F.array_contains(parent_ids, x["id"]) & ~F.exists("p_nodes", lambda y: (y["id"] == x["id"]) & y["type"].eqNullSafe(x["type"]))),
        "edge_not_in_parent": known & F.exists(own, lambda k: times(own, k) > times(whole, k)),
        "edge_outside_subgraph": F.exists(e, lambda x: ~F.array_contains(ids, x["source"]) | ~F.array_contains(ids, x["target"])),
        "disconnected": ~_linked_up(n, e),
        "contract_violation": _violated(n, e).isNotNull(),
        "provenance_missing": made.isNull() | F.exists(F.array(*(made[k].cast("string") for k in PROVENANCE)), lambda v: F.coalesce(v, F.lit("")) == ""),
        "provenance_node_ids": ~same(made["selected_node_ids"], ids),
        "provenance_edge_ids": ~same(made["selected_edge_ids"], own),
        "provenance_parent": ~same(made["parent_source_id"], F.col("parent_id")),
        "provenance_node_ratio": known & ~same(made["node_retention_ratio"], ratio(n, F.col("p_nodes"))),
        "provenance_edge_ratio": known & ~same(made["edge_retention_ratio"], ratio(e, F.col("p_edges"))),
        "duplicate_node_ids": F.size(F.array_distinct(ids)) < F.size(ids),
        "duplicate_edges": F.size(F.array_distinct(own)) < F.size(own),
        "security_missing": F.col("security").isNull() | F.exists(F.array(*(F.col(f"security.{k}").isNull() for k in SECURITY)), lambda x: x),
    }
    return s.select("id", F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))).alias("problems"))
