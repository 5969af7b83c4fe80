"""Property graph as two DataFrames, nodes(id, type, ...) and edges(source, target, type, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.plans.common import checkpointed

EDGE_KEY = ["source", "target", "type"]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    kept = checkpointed(df)
    return kept, kept.count()


# Selections

def of_type(df: DataFrame, kind: str) -> DataFrame:
    """Type scan of nodes or edges; no cap on rows."""
    return df.where(F.col("type") == kind)


def query_nodes(nodes: DataFrame, kind: str | None = None, filters: dict | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Storage contract: equality, or {'$gt': ...} and alike, on typed columns; a mismatch is false; ordered by id."""
    compare = {"$gt": "__gt__", "$lt": "__lt__", "$gte": "__ge__", "$lte": "__le__", "$ne": "__ne__", "$eq": "__eq__"}
    found = of_type(nodes, kind) if kind else nodes
    for name, wanted in (filters or {}).items():
        for op, value in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
            column = F.col(name).try_cast("double") if isinstance(value, (int, float)) and not isinstance(value, bool) else F.col(name).cast("string")
            found = found.where(getattr(column, compare[op])(F.lit(value)))
    if limit is None and not offset:
        return found
    found = found.orderBy("id").offset(offset)
    return found if limit is None else found.limit(limit)


def point(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.where(F.col("id") == node)


def edges_from(edges: DataFrame, source: str, target: str | None = None, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("source") == source)
    found = found.where(F.col("target") == target) if target else found
    return of_type(found, kind) if kind else found


def edges_into(edges: DataFrame, target: str, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("target") == target)
    return of_type(found, kind) if kind else found


def neighbours(edges: DataFrame, node: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    """Distinct ids at the other end."""
    edges = of_type(edges, kind) if kind else edges
    out = edges.where(F.col("source") == node).select(F.col("target").alias("id"))
    into = edges.where(F.col("target") == node).select(F.col("source").alias("id"))
    return {"out": out, "in": into, "both": out.union(into)}[direction].distinct()


def exists(df: DataFrame, condition: Column) -> bool:
    return not df.where(condition).isEmpty()


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges by type, and in total (type null)."""
    tally = lambda df, what: df.rollup("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return tally(nodes, "node").unionByName(tally(edges, "edge"))


# Joins

def functions_calling(nodes: DataFrame, edges: DataFrame, target: str, limit: int | None = 100) -> DataFrame:
    calls = of_type(edges, "calls").where(F.contains("target", F.lit(target))).select(F.col("source").alias("id"))
    found = of_type(nodes, "function").join(calls, "id", "left_semi")
    return found.orderBy("id").limit(limit) if limit else found


def files_depending_on(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    imports = of_type(edges, "imports").where(F.contains("target", F.lit(target))).select(F.col("source").alias("id"))
    return of_type(nodes, "file").join(imports, "id", "left_semi")


def complex_functions(nodes: DataFrame, threshold: int = 10, limit: int | None = None) -> DataFrame:
    found = of_type(nodes, "function").where(F.col("complexity") > threshold)
    return found.orderBy("id").limit(limit) if limit else found


def unused_functions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that nothing calls, but for entry points and double-underscore names."""
    called = of_type(edges, "calls").select(F.col("target").alias("id"))
    return of_type(nodes, "function").where(~F.startswith("name", F.lit("main")) & ~F.startswith("name", F.lit("__"))).join(called, "id", "left_anti")


def fan(deps: DataFrame) -> DataFrame:
    """deps(src, dst) to path, fan_out, fan_in over distinct pairs."""
    pairs = deps.select("src", "dst").distinct()
    ends = pairs.select(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(pairs.select(F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("path").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


# Traversal

def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """starts(id) to (id, depth): breadth first along source to target, least depth; unbounded without max_depth."""
    pairs = edges.select("source", "target").distinct()
    if max_depth is None or max_depth > 1:
        pairs = checkpointed(pairs)  # or each round would make and shuffle all of them anew
    frontier = checkpointed(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = pairs.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        frontier, n = _counted(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not n:
            break
        seen = seen.unionByName(frontier)
        seen = checkpointed(seen) if depth % 8 == 0 else seen
    return seen


def subgraph(graph: Graph, root: str, max_depth: int) -> Graph:
    """Nodes within max_depth of root, and the edges among them."""
    ids = reach(graph.edges, point(graph.nodes, root), max_depth).select("id")
    return induced(Graph(graph.nodes.join(ids, "id", "left_semi"), graph.edges))


def induced(graph: Graph) -> Graph:
    """The edges whose both ends are nodes."""
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(graph.nodes.select(F.col("id").alias(end)), end, "left_semi")
    return Graph(graph.nodes, edges.select(*graph.edges.columns))


def hierarchy(nodes: DataFrame, edges: DataFrame, name: str, max_depth: int = 5) -> DataFrame:
    """Classes that inherit from one whose id contains name, level by level, max_depth + 1 levels; each with its least depth."""
    inherits = of_type(edges, "inherits")
    first = inherits.where(F.contains("target", F.lit(name))).select(F.col("source").alias("id"))
    down = inherits.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return reach(down, first, max_depth).join(nodes, "id").select("id", "depth")


# Changes

def add_nodes(graph: Graph, new: DataFrame) -> Graph:
    """Upsert by id: the new row wins; of repeated new ids one stays."""
    new = new.dropDuplicates(["id"])
    return Graph(graph.nodes.join(new, "id", "left_anti").unionByName(new, allowMissingColumns=True), graph.edges)


def add_edges(graph: Graph, new: DataFrame) -> Graph:
    """Edges are a set by source, target and type, the first stays; those that dangle are left out."""
    fresh = new.dropDuplicates(EDGE_KEY).join(graph.edges, EDGE_KEY, "left_anti")
    fresh = induced(Graph(graph.nodes, fresh)).edges
    return Graph(graph.nodes, graph.edges.unionByName(fresh, allowMissingColumns=True))


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """ids(id) go, with the edges at either end."""
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return Graph(graph.nodes.join(ids, "id", "left_anti"), edges.select(*graph.edges.columns))


def delete_edges(graph: Graph, keys: DataFrame) -> Graph:
    """keys(source, target, type); type * stands for any."""
    exact = keys.where("type <> '*'").select(*EDGE_KEY)
    every = keys.where("type = '*'").select("source", "target")
    edges = graph.edges.join(exact, EDGE_KEY, "left_anti").join(every, ["source", "target"], "left_anti")
    return Graph(graph.nodes, edges.select(*graph.edges.columns))


def clear(graph: Graph) -> Graph:
    return Graph(graph.nodes.limit(0), graph.edges.limit(0))


def diff(old: Graph, new: Graph) -> DataFrame:
    """A delta: (op, id) for nodes, (op, source, target, type) for edges. Nodes of one id that differ in any property are
    updated; an edge's properties don't count."""
    names = [c for c in old.nodes.columns if c in new.nodes.columns and c != "id"]
    sides = [g.nodes.select("id", F.struct(*names).alias(side)) for g, side in ((old, "was"), (new, "now"))]
    both = sides[0].join(sides[1], "id", "full_outer")
    op = F.when(F.col("was").isNull(), "add_node").when(F.col("now").isNull(), "delete_node").when(~F.col("was").eqNullSafe(F.col("now")), "update_node")
    nodes = both.select(op.alias("op"), "id").where("op IS NOT NULL")
    key = lambda g: g.edges.select(*EDGE_KEY).distinct()
    edges = key(new).join(key(old), EDGE_KEY, "left_anti").withColumn("op", F.lit("add_edge")).unionByName(key(old).join(key(new), EDGE_KEY, "left_anti").withColumn("op", F.lit("delete_edge")))
    return nodes.unionByName(edges, allowMissingColumns=True)


def apply_delta(graph: Graph, delta: DataFrame, new: Graph) -> Graph:
    """Edges go first, then nodes with their edges, then nodes come, then edges that don't dangle. new holds the rows to add."""
    keys = delta.where("op = 'delete_edge'").select(*EDGE_KEY)
    graph = delete_nodes(delete_edges(graph, keys), delta.where("op = 'delete_node'").select("id"))
    ids = delta.where("op IN ('add_node', 'update_node')").select("id")
    graph = add_nodes(graph, new.nodes.join(ids, "id", "left_semi"))
    return add_edges(graph, new.edges.join(delta.where("op = 'add_edge'").select(*EDGE_KEY), EDGE_KEY, "left_semi"))


def delta_summary(delta: DataFrame) -> DataFrame:
    return delta.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def has_changes(delta: DataFrame) -> bool:
    return not delta.isEmpty()
