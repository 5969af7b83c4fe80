"""Dependency analysis: graph building from parser records, import resolution, cycles, depth, layers."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.operators.graph import Graph, induced, reach
from ashlar.plans.common import checkpointed, counted
from ashlar.schema import node_id, split_lines

#: Names that calls resolve to as builtin. Fixed values.
BUILTINS = [
    "print", "len", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "range", "enumerate", "zip", "map", "filter",
    "sorted", "reversed", "open", "input", "type", "isinstance", "hasattr", "getattr", "setattr",
    "min", "max", "sum", "abs", "round", "pow",
    "make", "new", "append", "copy", "delete", "cap", "panic", "recover", "close",
    "toString", "equals", "hashCode", "println",
]
CALL = "struct<name:string,line:int,type:string,arguments:string>"
RECORD = (
    "file_path string, language string, metrics struct<loc:int>, source_code string, "
    "functions array<struct<name:string,qualified_name:string,line_start:int,line_end:int,complexity:int,parameters:array<string>,return_type:string,"
    f"decorators:array<string>,docstring:string,is_async:boolean,is_generator:boolean,calls:array<{CALL}>>>, "
    "classes array<struct<name:string,qualified_name:string,line_start:int,line_end:int,base_classes:array<string>,methods:array<struct<name:string>>>>, "
    "imports array<struct<module:string,name:string,alias:string,type:string,line_number:int>>"
)


def build_graph(records: DataFrame) -> Graph:
    """Parser records to a graph: file, module, function and class nodes; contains, calls, inherits and imports edges.

    A call goes to the file's function of that name (the last one defined), else to builtin.x or external.x; a base class
    alike. Edges whose ends aren't nodes are left out, so calls and bases out of the file are.
    """
    files = records.select(
        node_id(F.lit("file"), F.col("file_path")).alias("id"), F.lit("file").alias("type"), F.col("file_path").alias("name"), F.col("file_path").alias("qualified_name"),
        F.col("file_path").alias("path"), "language", F.coalesce("metrics.loc", F.size(split_lines(F.coalesce("source_code", F.lit(""))))).alias("loc"),
    )
    fn = records.select("file_path", "language", F.posexplode("functions").alias("ord", "f"))
    name = F.coalesce("f.qualified_name", "f.name")
    own_id = node_id(F.lit("function"), name, F.col("file_path"))
    functions = fn.select(
        own_id.alias("id"), F.lit("function").alias("type"), F.col("f.name").alias("name"), name.alias("qualified_name"), F.col("file_path").alias("path"), "language",
        "f.line_start", "f.line_end", F.coalesce("f.complexity", F.lit(1)).alias("complexity"), F.coalesce("f.is_async", F.lit(False)).alias("is_async"), "f.return_type",
    )
    cl = records.select("file_path", "language", F.posexplode("classes").alias("ord", "c"))
    class_name = F.coalesce("c.qualified_name", "c.name")
    class_id = node_id(F.lit("class"), class_name, F.col("file_path"))
    classes = cl.select(class_id.alias("id"), F.lit("class").alias("type"), F.col("c.name").alias("name"), class_name.alias("qualified_name"), F.col("file_path").alias("path"), "language", "c.line_start", "c.line_end", F.transform("c.methods", lambda m: m["name"]).alias("methods"))
    imp = records.select("file_path", F.explode("imports").alias("i")).where("i.module IS NOT NULL")
    module_id = node_id(F.lit("module"), F.col("i.module"))
    modules = imp.select(module_id.alias("id"), F.lit("module").alias("type"), F.col("i.module").alias("name"), F.col("i.module").alias("qualified_name")).distinct()
    nodes = files
    for more in (modules, functions, classes):
        nodes = nodes.unionByName(more, allowMissingColumns=True)
    nodes = nodes.dropDuplicates(["id"])

    edge = lambda source, target, kind, line: (source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), line.cast("int").alias("line_number"))
    file_id, none = node_id(F.lit("file"), F.col("file_path")), F.lit(None)
    contains = fn.select(*edge(file_id, own_id, "contains", none)).unionByName(cl.select(*edge(file_id, class_id, "contains", none)))
    by_name = fn.groupBy("file_path", F.col("f.name").alias("called")).agg(F.max_by(own_id, "ord").alias("target"))
    calls = fn.select("file_path", own_id.alias("source"), F.explode("f.calls").alias("call")).withColumn("called", F.col("call.name")).join(by_name, ["file_path", "called"], "left")
    calls = calls.select(*edge(F.col("source"), resolved_call(F.col("target"), F.col("called")), "calls", F.col("call.line")))
    class_of = cl.groupBy("file_path", F.col("c.name").alias("base")).agg(F.max_by(class_id, "ord").alias("target"))
    bases = cl.select("file_path", class_id.alias("source"), F.explode("c.base_classes").alias("base")).join(class_of, ["file_path", "base"], "left")
    bases = bases.select(*edge(F.col("source"), F.coalesce("target", F.concat(F.lit("class:external."), "base")), "inherits", none))
    imports = imp.select(*edge(file_id, module_id, "imports", F.col("i.line_number")))
    edges = contains.unionByName(calls).unionByName(bases).unionByName(imports).dropDuplicates(["source", "target", "type"])
    return induced(Graph(nodes, edges))


def resolved_call(target: Column, name: Column) -> Column:
    return F.coalesce(target, F.concat(F.when(name.isin(*BUILTINS), "function:builtin.").otherwise("function:external."), name))


def symbol_index(symbols: DataFrame) -> DataFrame:
    """symbols(file, name, type, scope, is_exported) that others may refer to: exported ones, and those of module scope."""
    return symbols.where(F.coalesce("is_exported", F.lit(False)) | (F.col("scope") == "module")).select("name", "file", "type")


def resolve_imports(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """imports(file, path) to (file, path, defined_in, symbol).

    a.b.c is first the file that ends in a/b/c.py (the first of several, by path); else c is a symbol of the file that ends
    in a/b.py. Each file is keyed by all its paths from some folder on, and joined by equality of the whole: a name that many
    files share (__init__.py) makes no pairs.
    """
    names = F.split("path", "/")
    from_name = F.transform(names, lambda _, i: F.array_join(F.slice(names, i + 1, F.size(names)), "/"))
    keyed = files.select(F.col("path").alias("found"), F.explode(from_name).alias("wanted"))

    def match(rows: DataFrame, module: Column) -> DataFrame:
        return rows.withColumn("wanted", F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))).join(keyed, "wanted")

    asked = imports.select("file", "path").distinct()
    whole = match(asked, F.col("path")).groupBy("file", "path").agg(F.min("found").alias("defined_in")).withColumn("symbol", F.lit(None).cast("string"))
    rest = asked.join(whole, ["file", "path"], "left_anti").where(F.contains("path", F.lit(".")))
    rest = rest.withColumn("symbol", F.substring_index("path", ".", -1)).withColumn("module", F.expr("left(path, length(path) - length(symbol) - 1)"))
    known = symbol_index(symbols).select(F.col("name").alias("symbol"), F.col("file").alias("found")).distinct()
    part = match(rest, F.col("module")).join(known, ["symbol", "found"]).groupBy("file", "path", "symbol").agg(F.min("found").alias("defined_in"))
    return whole.unionByName(part.select("file", "path", "defined_in", "symbol"))


def file_dependencies(resolved: DataFrame) -> DataFrame:
    return resolved.where("file <> defined_in").select(F.col("file").alias("src"), F.col("defined_in").alias("dst")).distinct()


def raw_imports(files: DataFrame) -> DataFrame:
    """files(path, imports array) to (src, import), unresolved."""
    return files.select(F.col("path").alias("src"), F.explode("imports").alias("import"))


def classify(imports: DataFrame) -> DataFrame:
    """imports(path) with kind: stdlib, external (hosted on github.com) or local."""
    standard = imports.sparkSession.createDataFrame([(m,) for m in sorted(sys.stdlib_module_names)], "path string")
    named = imports.join(F.broadcast(standard.withColumn("std", F.lit(True))), "path", "left")  # a fixed list
    return named.select("path", F.when(F.col("std"), "stdlib").when(F.contains("path", F.lit("github.com")), "external").otherwise("local").alias("kind"))


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """Simple cycles as arrays that begin with their least node, each once; of at most longest nodes, of any length if None.

    Paths stay inside a strongly connected component, start at the cycle's least node and only visit greater ones, so that
    no rotation comes twice and the rounds end with the largest component. The number of cycles can grow exponentially with
    their length: where all of them are too many, strong_components says what lies on cycles, of any length.
    """
    pairs = edges.select("source", "target").distinct()
    found = pairs.where("source = target").select(F.array("source").alias("cycle"))
    pairs = checkpointed(_inside(pairs.where("source <> target")))
    paths = pairs.where("source < target").select(F.array("source", "target").alias("path"), F.col("target").alias("source"))
    while longest is None or longest > 1:
        step = paths.join(pairs, "source").select("path", "target")
        found = found.union(step.where(F.col("target") == F.col("path")[0]).select(F.col("path").alias("cycle")))
        grown = step.where((F.col("target") > F.col("path")[0]) & ~F.array_contains("path", F.col("target")))
        paths = grown.select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("source"))
        if longest is None:
            paths = checkpointed(paths)
            if paths.isEmpty():
                break
        else:
            longest -= 1
    return found


def _inside(pairs: DataFrame) -> DataFrame:
    """The pairs whose both ends are in one strongly connected component."""
    of_node = strong_components(pairs)
    ends = pairs.join(of_node.select(F.col("node").alias("source"), F.col("component").alias("own")), "source")
    return ends.join(of_node.select(F.col("node").alias("target"), F.col("component").alias("other")), "target").where("own = other").select("source", "target")


def cyclic_core(pairs: DataFrame) -> DataFrame:
    """Edges left after taking away, again and again, those of nodes without a way in or out."""
    n = None
    while True:
        pairs = pairs.join(pairs.select(F.col("target").alias("source")), "source", "left_semi").join(pairs.select(F.col("source").alias("target")), "target", "left_semi").select("source", "target")
        pairs = checkpointed(pairs)
        left = pairs.count()
        if left in (0, n):
            return pairs
        n = left


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(source, target): component is the least node of its strongly connected
    component; a node on no cycle is one of its own. Null ends are no nodes; repeated edges and loops change nothing.

    Rounds of forward and backward colouring over what may still lie on a cycle. Forward, a node's colour is the least node
    that reaches it; those that keep their own are roots. Backward, a root's component is what reaches it within its colour.
    Found components and edges between colours go; every round settles a component of each colour, and only nodes whose
    colour has changed send it on.
    """
    pairs = checkpointed(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct())
    nodes = pairs.select(F.col("source").alias("node")).union(pairs.select(F.col("target").alias("node"))).distinct()
    done = None
    live = cyclic_core(pairs.where("source <> target"))
    while not live.isEmpty():
        colours = _colours(live)
        coloured = live.join(colours.select(F.col("node").alias("source"), F.col("colour").alias("own")), "source").join(colours.select(F.col("node").alias("target"), F.col("colour").alias("other")), "target")
        within = checkpointed(coloured.where("own = other").select("source", "target", F.col("own").alias("colour")))
        roots = colours.where("node = colour").select(F.col("node").alias("id"))
        # Backward within a colour, an edge leads from its target to its source.
        settled = reach(within.select(F.col("target").alias("source"), F.col("source").alias("target")), roots).select(F.col("id").alias("node"))
        settled = checkpointed(settled.join(colours, "node").select("node", F.col("colour").alias("component")))
        done = settled if done is None else done.unionByName(settled)
        rest = within.join(settled.select(F.col("node").alias("source")), "source", "left_anti").join(settled.select(F.col("node").alias("target")), "target", "left_anti")
        live = cyclic_core(rest.select("source", "target"))
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _colours(pairs: DataFrame) -> DataFrame:
    """(node, colour): the least node from which a node is reached, itself included."""
    ends = pairs.select(F.col("source").alias("node")).union(pairs.select(F.col("target").alias("node"))).distinct()
    colours = checkpointed(ends.select("node", F.col("node").alias("colour"), F.lit(True).alias("changed")))
    while True:
        sent = pairs.join(colours.where("changed").select(F.col("node").alias("source"), "colour"), "source").groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("least"))
        better = F.coalesce(F.col("least") < F.col("colour"), F.lit(False))
        colours, changed = counted(colours.join(sent, "node", "left").select("node", F.when(better, F.col("least")).otherwise(F.col("colour")).alias("colour"), better.alias("changed")), F.col("changed"))
        if not changed:
            return colours.select("node", "colour")


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) by longest path from a node without predecessors, level 1 there; nodes in or behind cycles are missing.

    Nodes are peeled: a table has how many edges into each node are left, and a round takes away those that start at the
    nodes that became free in the last one. Edges are written once and read by the round's nodes alone.
    """
    pairs = checkpointed(edges.select("source", "target").distinct())
    ways = pairs.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("left"))
    nodes = pairs.select(F.col("source").alias("node")).union(pairs.select(F.col("target").alias("node"))).distinct()
    level = 1
    free = lambda left: F.when(left == 0, F.lit(level))
    state = nodes.join(ways, "node", "left").select("node", F.coalesce("left", F.lit(0)).alias("left"))
    state, n = counted(state.select("node", "left", free(F.col("left")).alias("level")), F.col("level").isNotNull())
    while n:
        gone = pairs.join(state.where(F.col("level") == level).select(F.col("node").alias("source")), "source").groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        level += 1
        left = F.col("left") - F.coalesce("n", F.lit(0))
        state = state.join(gone, "node", "left").select("node", left.alias("left"), F.coalesce("level", free(left)).alias("level"))
        state, n = counted(state, F.col("level") == level)
    return state.where("level IS NOT NULL").select("node", "level")


def longest_path(edges: DataFrame) -> DataFrame:
    """One row: the nodes on the longest path, 0 where there is a cycle."""
    edges = edges.select("source", "target").distinct()
    n = edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).distinct().count()
    found = levels(edges).agg(F.count(F.lit(1)).alias("seen"), F.coalesce(F.max("level"), F.lit(0)).alias("depth"))
    return found.select(F.when(F.col("seen") == n, F.col("depth")).otherwise(0).cast("long").alias("depth"))


def call_depth(edges: DataFrame, entry) -> DataFrame:
    """Longest chain of calls from entry, in nodes; 0 where what it reaches has a cycle."""
    spark = edges.sparkSession
    kind = edges.schema["source"].dataType
    start = spark.range(1).select(F.lit(entry).cast(kind).alias("id"))
    ids = checkpointed(reach(edges, start).select("id"))
    inside = edges.select("source", "target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select("source", "target").distinct()
    if inside.isEmpty():
        return spark.range(1).select(F.lit(1).cast("long").alias("depth"))
    return longest_path(inside)


def tests_of(deps: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Tests that may cover a file: importers that look like tests, and files named after it by convention."""
    stem = path.rpartition("/")[2].rpartition(".")[0]
    looks = lambda c: F.rlike(F.lower(c), F.lit(r"(^|/)(tests?/|test_[^/]*$|[^/]*_test\.[^/]*$)"))
    importers = deps.where(F.col("dst") == path).select(F.col("src").alias("path")).where(looks("path"))
    named = files.select("path").where(F.rlike("path", F.lit(rf"(^|/)(test_{stem}|{stem}_test)\.[^/.]+$")))
    return importers.union(named).distinct()


def task_layers(tasks: DataFrame, depends: DataFrame) -> DataFrame:
    """tasks(id, priority), depends(id, on) to (layer, id, priority, place): a layer only needs earlier ones; in it the
    higher priority comes first. Raises on a cycle."""
    edges = depends.select(F.col("on").alias("source"), F.col("id").alias("target"))
    found = levels(edges)
    layered = tasks.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "priority", "level")
    ends = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id")))
    if not tasks.join(ends, "id", "left_semi").join(found.select(F.col("node").alias("id")), "id", "left_anti").isEmpty():
        raise ValueError("tasks depend on one another in a cycle")
    layered = layered.select("id", "priority", F.coalesce(F.col("level") - 1, F.lit(0)).alias("layer"))
    return layered.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy(F.col("priority").desc(), "id")))


def skipped(depends: DataFrame, failed: DataFrame) -> DataFrame:
    """Tasks that depend, directly or not, on failed(id)."""
    edges = depends.select(F.col("on").alias("source"), F.col("id").alias("target"))
    return reach(edges, failed).where("depth > 0").select("id")
