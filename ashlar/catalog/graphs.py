"""Queries of the FIND language, the graph operators and dependency analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.operators import dependencies as deps
from ashlar.operators import graph as g
from ashlar.plans import find as fd
from ashlar.views import oracle, view

QUERIES: dict = {}
ORACLES: dict = {}
NODE = "id, type, name, qualified_name, language, complexity"
COLUMNS = NODE.split(", ")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def graph(spark, d, edges="v_edges") -> g.Graph:
    return g.Graph(view(spark, d, "v_nodes"), view(spark, d, edges))


def find_query(name: str, text: str, where: str, tail: str = "") -> None:
    """A FIND text and the same as SQL."""
    @query(name, f"SELECT {NODE} FROM v_nodes n WHERE {where} {tail}")
    def run(spark, d, text=text):
        own = graph(spark, d)
        return fd.find(text, own.nodes, own.edges).select(*COLUMNS)


def has(edge: str, target: str) -> str:
    return f"EXISTS (SELECT 1 FROM v_edges e WHERE e.source = n.id AND e.type = '{edge}' AND contains(e.target, '{target}'))"


FN = "type = 'function' AND "
find_query("phase0_find", "FIND function WHERE complexity > 10 AND CALLING 'function:17' LIMIT 50", FN + "complexity > 10 AND " + has("calls", "function:17"), "ORDER BY id LIMIT 50")
find_query("f01_all", "FIND functions", "type = 'function'")
find_query("f02_alias", "FIND file AS f WHERE language = 'BUILDING'", "type = 'file' AND language = 'BUILDING'")
find_query("f03_string_number", "FIND function WHERE name = 5", "FALSE")
find_query("f04_imports", "FIND file WHERE IMPORTS 'class:7'", "type = 'file' AND " + has("imports", "class:7"))
find_query("f04_contains", "FIND file WHERE CONTAINS 'function:12'", "type = 'file' AND " + has("contains", "function:12"))
find_query("f04_inherits", "FIND class WHERE INHERITS 'module:2'", "type = 'class' AND " + has("inherits", "module:2"))
find_query("f06_not_equal", "FIND function WHERE complexity <> 10", FN + "complexity <> 10")
find_query("f06_null_is_false", "FIND file WHERE complexity != 10", "FALSE")
find_query("f06_range", "FIND function WHERE complexity > 5 AND complexity < 15", FN + "complexity > 5 AND complexity < 15")
find_query("f06_at_most", "FIND function WHERE complexity <= 3 OR complexity >= 49", FN + "(complexity <= 3 OR complexity >= 49)")
find_query("f07_like", "FIND function WHERE qualified_name LIKE 'brand#1'", FN + "contains(lower(qualified_name), 'brand#1')")
find_query("f07_in", "FIND function WHERE complexity IN (1, 2, 3)", FN + "complexity IN (1, 2, 3)")
find_query("f08_fold", "FIND function WHERE complexity > 40 OR complexity < 10 AND loc > 950", FN + "(complexity > 40 OR complexity < 10) AND loc > 950")
find_query("f10_two_relations", "FIND function WHERE CALLING 'function:1' AND CALLING 'function:2' AND complexity < 20", FN + "complexity < 20 AND " + has("calls", "function:1") + " AND " + has("calls", "function:2"))
find_query("f10_not", "FIND function WHERE NOT CALLING '7'", FN + "NOT " + has("calls", "7"))
find_query("f11_any_target", "FIND file WHERE IMPORTS '*'", "type = 'file' AND EXISTS (SELECT 1 FROM v_imports e WHERE e.source = n.id)")
find_query("f12_page", "FIND function WHERE complexity > 10 LIMIT 20 OFFSET 30", FN + "complexity > 10", "ORDER BY id LIMIT 20 OFFSET 30")
find_query("f12_offset_first", "FIND function OFFSET 5 LIMIT 7", "type = 'function'", "ORDER BY id LIMIT 7 OFFSET 5")
find_query("f12_limit_zero", "FIND class LIMIT 0", "type = 'class'")


@query("f12_total_count", f"SELECT count(*) AS total_count FROM v_nodes WHERE {FN} complexity > 10")
def f12_total(spark, d):
    own = graph(spark, d)
    return fd.total_count("FIND function WHERE complexity > 10 LIMIT 50", own.nodes, own.edges)


@query("f05_validation", "SELECT 'function has no attribute shoe_size' AS warning")
def f05(spark, d):
    return spark.createDataFrame([(w,) for w in fd.validate(fd.parse("FIND function WHERE shoe_size > 3"))], "warning string")


@query("f13_patterns", f"SELECT {NODE} FROM v_nodes WHERE {FN} complexity > 15")
def f13(spark, d):
    return g.complex_functions(view(spark, d, "v_nodes"), 15).select(*COLUMNS)


@query("s11_type_scan", f"SELECT {NODE} FROM v_nodes WHERE type = 'class'")
def s11(spark, d):
    return g.of_type(view(spark, d, "v_nodes"), "class").select(*COLUMNS)


@query("s12_filtered_scan", f"SELECT {NODE} FROM v_nodes WHERE type = 'function' AND complexity >= 30 AND complexity <> 31")
def s12(spark, d):
    return g.query_nodes(view(spark, d, "v_nodes"), "function", {"complexity": {"$gte": 30, "$ne": 31}}).select(*COLUMNS)


@query("s13_query_nodes", f"SELECT {NODE} FROM v_nodes WHERE type = 'file' AND language = 'MACHINERY' ORDER BY id LIMIT 10 OFFSET 5")
def s13(spark, d):
    return g.query_nodes(view(spark, d, "v_nodes"), "file", {"language": "MACHINERY"}, 10, 5).select(*COLUMNS)


@query("s14_range_on_text", f"SELECT {NODE} FROM v_nodes WHERE FALSE")
def s14(spark, d):
    return g.query_nodes(view(spark, d, "v_nodes"), "file", {"language": {"$gt": 3}}).select(*COLUMNS)


@query("s15_all_types", f"SELECT {NODE} FROM v_nodes WHERE name = 'GERMANY' OR name = 'ASIA'")
def s15(spark, d):
    nodes = view(spark, d, "v_nodes")
    return g.query_nodes(nodes, None, {"name": "GERMANY"}).unionByName(g.query_nodes(nodes, None, {"name": "ASIA"})).select(*COLUMNS)


@query("s16_point_lookup", f"SELECT {NODE} FROM v_nodes WHERE id = 'function:42'")
def s16(spark, d):
    return g.point(view(spark, d, "v_nodes"), "function:42").select(*COLUMNS)


@query("s17_edge_lookup", "SELECT source, target, type FROM v_edges WHERE source = 'function:17' AND type = 'calls'")
def s17(spark, d):
    return g.edges_from(view(spark, d, "v_edges"), "function:17", kind="calls").select("source", "target", "type")


@query("g01_functions_calling", f"SELECT {NODE} FROM v_nodes n WHERE {FN} {has('calls', 'function:17')} ORDER BY id LIMIT 100")
def g01(spark, d):
    own = graph(spark, d)
    return g.functions_calling(own.nodes, own.edges, "function:17").select(*COLUMNS)


@query("g02_hierarchy", "SELECT source AS id, 0 AS depth FROM v_inherits WHERE contains(target, 'module:1')")
def g02(spark, d):
    own = graph(spark, d)
    return g.hierarchy(own.nodes, own.edges, "module:1")


@query("g03_file_dependencies", f"SELECT {NODE} FROM v_nodes n WHERE type = 'file' AND {has('imports', 'class:3')}")
def g03(spark, d):
    own = graph(spark, d)
    return g.files_depending_on(own.nodes, own.edges, "class:3").select(*COLUMNS)


@query("g04_high_complexity", f"SELECT {NODE} FROM v_nodes WHERE {FN} complexity > 45 ORDER BY id LIMIT 1000")
def g04(spark, d):
    return g.complex_functions(view(spark, d, "v_nodes"), 45, 1000).select(*COLUMNS)


@query("g05_unused", f"SELECT {NODE} FROM v_function WHERE NOT name LIKE 'main%' AND NOT starts_with(name, '__') AND id NOT IN (SELECT target FROM v_calls_sparse)")
def g05(spark, d):
    own = graph(spark, d, "v_calls_sparse")
    return g.unused_functions(own.nodes, own.edges).select(*COLUMNS)


REACH = """WITH RECURSIVE r(id, depth) AS (SELECT {0} AS id, 0 AS depth UNION SELECT e.target, depth + 1 FROM r JOIN {1} e ON e.source = r.id WHERE depth < {2})
SELECT id, min(depth) AS depth FROM r GROUP BY id"""


@query("g06_bfs", REACH.format("'function:1'", "v_calls", 6))
def g06(spark, d):
    return g.reach(view(spark, d, "v_calls"), spark.range(1).select(F.lit("function:1").alias("id")), 6)


@query("g07_reachable", "WITH RECURSIVE r(id) AS (SELECT 'function:1' UNION SELECT e.target FROM r JOIN v_calls e ON e.source = r.id) SELECT id FROM r")
def g07(spark, d):
    return g.reach(view(spark, d, "v_calls"), spark.range(1).select(F.lit("function:1").alias("id"))).select("id")


@query("g08_neighbours", "SELECT target AS id FROM v_edges WHERE source = 'function:17' UNION SELECT source FROM v_edges WHERE target = 'function:17'")
def g08(spark, d):
    return g.neighbours(view(spark, d, "v_edges"), "function:17")


@query("g09_edges_by_type", "SELECT source, target, type FROM v_edges WHERE target = 'function:5' AND type = 'contains'")
def g09(spark, d):
    return g.edges_into(view(spark, d, "v_edges"), "function:5", "contains").select("source", "target", "type")


@query("g10_existence", "SELECT EXISTS (SELECT 1 FROM v_nodes WHERE id = 'function:3') AS has_node, EXISTS (SELECT 1 FROM v_edges WHERE source = 'function:3' AND target = 'x') AS has_edge")
def g10(spark, d):
    own = graph(spark, d)
    found = (g.exists(own.nodes, F.col("id") == "function:3"), g.exists(own.edges, (F.col("source") == "function:3") & (F.col("target") == "x")))
    return spark.createDataFrame([found], "has_node boolean, has_edge boolean")


@query("g11_cascade", "SELECT type, count(*) AS n FROM v_edges WHERE NOT source IN (SELECT id FROM v_file WHERE loc % 2 = 0) AND NOT target IN (SELECT id FROM v_file WHERE loc % 2 = 0) GROUP BY type")
def g11(spark, d):
    own = graph(spark, d)
    return g.counts(*_parts(g.delete_nodes(own, view(spark, d, "v_file").where("loc % 2 = 0").select("id")))).where("what = 'edge' AND type IS NOT NULL").select("type", "n")


def _parts(own: g.Graph):
    return own.nodes, own.edges


SUBGRAPH = f"WITH RECURSIVE r(id, depth) AS (SELECT 'function:1', 0 UNION SELECT e.target, depth + 1 FROM r JOIN v_calls e ON e.source = r.id WHERE depth < 4) "


@query("g12_subgraph_nodes", SUBGRAPH + f"SELECT {NODE} FROM v_nodes WHERE id IN (SELECT id FROM r)")
def g12(spark, d):
    return g.subgraph(graph(spark, d, "v_calls"), "function:1", 4).nodes.select(*COLUMNS)


@query("g13_subgraph_edges", SUBGRAPH + "SELECT source, target, type FROM v_calls WHERE source IN (SELECT id FROM r) AND target IN (SELECT id FROM r)")
def g13(spark, d):
    return g.subgraph(graph(spark, d, "v_calls"), "function:1", 4).edges.select("source", "target", "type")


@query("g23_raw_imports", "SELECT concat('page', page_id) AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS import FROM {pages}")
def g23(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return deps.raw_imports(pages.select(F.concat(F.lit("page"), "page_id").alias("path"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("imports")))


@query("g24_cycles", """WITH p AS (SELECT DISTINCT s, t FROM v_pairs),
two AS (SELECT [a.s, a.t] AS cycle FROM p a JOIN p b ON a.t = b.s AND b.t = a.s WHERE a.s < a.t),
three AS (SELECT [a.s, a.t, b.t] AS cycle FROM p a JOIN p b ON a.t = b.s JOIN p c ON b.t = c.s AND c.t = a.s WHERE a.s < a.t AND a.s < b.t AND a.t <> b.t)
SELECT [s] AS cycle FROM p WHERE s = t UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three""")
def g24(spark, d):
    return deps.cycles(view(spark, d, "v_pairs").select(F.col("s").alias("source"), F.col("t").alias("target")), 3)


@query("g24_components", """WITH RECURSIVE p AS (SELECT DISTINCT s, t FROM v_pairs), r(a, b) AS (SELECT s, t FROM p UNION SELECT r.a, p.t FROM r JOIN p ON p.s = r.b),
nodes AS (SELECT s AS node FROM p UNION SELECT t FROM p)
SELECT node, least(node, min(y.b)) AS component FROM nodes LEFT JOIN (SELECT x.a, x.b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a) y ON y.a = node GROUP BY node""")
def g24_components(spark, d):
    return deps.strong_components(view(spark, d, "v_pairs").select(F.col("s").alias("source"), F.col("t").alias("target")))


@query("g24_file_components", """WITH RECURSIVE p AS (SELECT DISTINCT s, t FROM v_pairs WHERE s % 100 = t % 100), r(a, b) AS (SELECT s, t FROM p UNION SELECT r.a, p.t FROM r JOIN p ON p.s = r.b),
nodes AS (SELECT s AS node FROM p UNION SELECT t FROM p)
SELECT node, least(node, min(y.b)) AS component FROM nodes LEFT JOIN (SELECT x.a, x.b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a) y ON y.a = node GROUP BY node""")
def g24_file(spark, d):
    """Recursion inside a file: calls whose ends are functions of one file."""
    inside = view(spark, d, "v_pairs").where("s % 100 = t % 100")
    return deps.strong_components(inside.select(F.col("s").alias("source"), F.col("t").alias("target")))


@query("g24_file_cycles", """WITH RECURSIVE p AS (SELECT DISTINCT s, t FROM v_pairs WHERE s % 100 = t % 100),
w(path, e) AS (SELECT [s], s FROM p UNION SELECT w.path || [p.t], p.t FROM w JOIN p ON p.s = w.e WHERE p.t > w.path[1] AND NOT list_contains(w.path, p.t))
SELECT DISTINCT path AS cycle FROM w JOIN p ON p.s = w.e AND p.t = w.path[1]""")
def g24_file_cycles(spark, d):
    """Every simple cycle of them, of any length."""
    inside = view(spark, d, "v_pairs").where("s % 100 = t % 100")
    return deps.cycles(inside.select(F.col("s").alias("source"), F.col("t").alias("target")))


PATHS = "WITH RECURSIVE r(node, n) AS (SELECT DISTINCT {0}, 1 FROM v_calls_dag {1} UNION SELECT e.target, n + 1 FROM r JOIN v_calls_dag e ON e.source = r.node) "


@query("g25_longest_path", PATHS.format("source", "") + "SELECT max(n)::BIGINT AS depth FROM r")
def g25(spark, d):
    return deps.longest_path(view(spark, d, "v_calls_dag"))


@query("g26_call_depth", PATHS.format("source", "WHERE source = (SELECT min(source) FROM v_calls_dag)") + "SELECT max(n)::BIGINT AS depth FROM r")
def g26(spark, d):
    edges = view(spark, d, "v_calls_dag")
    return deps.call_depth(edges, edges.agg(F.min("source")).first()[0])


@query("g27_classify", "SELECT path, CASE path WHEN 'os' THEN 'stdlib' WHEN 'json' THEN 'stdlib' WHEN 'github.com/a/b' THEN 'external' ELSE 'local' END AS kind FROM (VALUES ('os'), ('json'), ('github.com/a/b'), ('app.core')) t(path)")
def g27(spark, d):
    return deps.classify(spark.createDataFrame([("os",), ("json",), ("github.com/a/b",), ("app.core",)], "path string"))


@query("g28_tests_of", "SELECT p AS path FROM (VALUES ('tests/test_core.py'), ('pkg/core_test.py')) t(p)")
def g28(spark, d):
    files = spark.createDataFrame([("tests/test_core.py",), ("pkg/core_test.py",), ("pkg/core.py",), ("pkg/other.py",)], "path string")
    return deps.tests_of(spark.createDataFrame([("tests/test_core.py", "pkg/core.py"), ("pkg/other.py", "pkg/core.py")], "src string, dst string"), files, "pkg/core.py")


@query("g29_fan", "WITH p AS (SELECT DISTINCT src, dst FROM v_deps) SELECT path, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (SELECT src AS path, 1 AS o, 0 AS i FROM p UNION ALL SELECT dst, 0, 1 FROM p) GROUP BY path")
def g29(spark, d):
    return g.fan(view(spark, d, "v_deps"))


@query("g30_layers", PATHS.format("source", "") + """, depth AS (SELECT node AS id, max(n) - 1 AS layer FROM r GROUP BY node), t AS (SELECT p_partkey AS id, p_size AS priority, coalesce(layer, 0) AS layer FROM {part} LEFT JOIN depth ON id = p_partkey)
SELECT id, priority, layer, row_number() OVER (PARTITION BY layer ORDER BY priority DESC, id) AS place FROM t""")
def g30(spark, d):
    tasks = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("priority"))
    return deps.task_layers(tasks, view(spark, d, "v_calls_dag").select(F.col("target").alias("id"), F.col("source").alias("on")))


@query("g31_skipped", "WITH RECURSIVE r(id) AS (SELECT p_partkey FROM {part} WHERE p_partkey % 50 = 1 UNION SELECT e.target FROM r JOIN v_calls_dag e ON e.source = r.id) SELECT id FROM r WHERE id NOT IN (SELECT p_partkey FROM {part} WHERE p_partkey % 50 = 1)")
def g31(spark, d):
    failed = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 50 = 1").select(F.col("p_partkey").alias("id"))
    return deps.skipped(view(spark, d, "v_calls_dag").select(F.col("target").alias("id"), F.col("source").alias("on")), failed)


@query("a16_counts", "SELECT 'node' AS what, type, count(*) AS n FROM v_nodes GROUP BY ROLLUP(type) UNION ALL SELECT 'edge', type, count(*) FROM v_edges GROUP BY ROLLUP(type)")
def a16(spark, d):
    return g.counts(*_parts(graph(spark, d)))


def _two_graphs(spark, d) -> tuple[g.Graph, g.Graph]:
    nodes, edges = view(spark, d, "v_function"), view(spark, d, "v_calls_sparse")
    old = g.Graph(nodes.where("complexity < 40"), edges.where("length(source) % 2 = 0"))
    new = g.Graph(nodes.where("complexity > 10").withColumn("complexity", F.when(F.col("complexity") == 25, 99).otherwise(F.col("complexity"))), edges.where("length(target) % 2 = 0"))
    return old, new


DELTA = """WITH o AS (SELECT id, complexity FROM v_function WHERE complexity < 40), n AS (SELECT id, CASE WHEN complexity = 25 THEN 99 ELSE complexity END AS complexity FROM v_function WHERE complexity > 10),
oe AS (SELECT source, target, type FROM v_calls_sparse WHERE length(source) % 2 = 0), ne AS (SELECT source, target, type FROM v_calls_sparse WHERE length(target) % 2 = 0),
delta AS (SELECT CASE WHEN o.id IS NULL THEN 'add_node' WHEN n.id IS NULL THEN 'delete_node' ELSE 'update_node' END AS op, coalesce(o.id, n.id) AS id, NULL AS source, NULL AS target, NULL AS type
 FROM o FULL JOIN n ON o.id = n.id WHERE o.complexity IS DISTINCT FROM n.complexity
 UNION ALL SELECT 'add_edge', NULL, * FROM (SELECT * FROM ne EXCEPT SELECT * FROM oe) UNION ALL SELECT 'delete_edge', NULL, * FROM (SELECT * FROM oe EXCEPT SELECT * FROM ne)) """


@query("d05_graph_diff", DELTA + "SELECT * FROM delta")
def d05(spark, d):
    return g.diff(*_two_graphs(spark, d))


@query("d06_apply_delta", DELTA + "SELECT source, target, type FROM ne WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) UNION SELECT source, target, type FROM oe WHERE FALSE")
def d06(spark, d):
    old, new = (g.induced(x) for x in _two_graphs(spark, d))
    whole = _two_graphs(spark, d)[1]
    return g.apply_delta(old, g.diff(old, whole), whole).edges.select("source", "target", "type")


@query("d07_delta_summary", DELTA + "SELECT op, count(*) AS n FROM delta GROUP BY op")
def d07(spark, d):
    return g.delta_summary(g.diff(*_two_graphs(spark, d)))


@query("k01_upsert", "SELECT id, CASE WHEN complexity > 45 THEN 0 ELSE complexity END AS complexity FROM v_function")
def k01(spark, d):
    nodes = view(spark, d, "v_function")
    own = g.Graph(nodes, view(spark, d, "v_calls_sparse"))
    return g.add_nodes(own, nodes.where("complexity > 45").withColumn("complexity", F.lit(0))).nodes.select("id", "complexity")


@query("k02_add_edges", "SELECT source, target, type FROM v_calls_sparse UNION SELECT 'function:1', 'function:2', 'calls'")
def k02(spark, d):
    own = graph(spark, d, "v_calls_sparse")
    more = spark.createDataFrame([("function:1", "function:2", "calls"), ("function:1", "function:2", "calls"), ("function:1", "nowhere", "calls")], "source string, target string, type string")
    return g.add_edges(own, more).edges.select("source", "target", "type")


@query("k04_delete_edges", "SELECT source, target, type FROM v_edges WHERE NOT (source = 'file:1' AND target = 'function:100') AND type <> 'inherits'")
def k04(spark, d):
    own = graph(spark, d)
    keys = own.edges.where("type = 'inherits'").unionByName(spark.createDataFrame([("file:1", "function:100", "*")], "source string, target string, type string"))
    return g.delete_edges(own, keys).edges.select("source", "target", "type")


@query("k05_clear", "SELECT 0 AS nodes, 0 AS edges")
def k05(spark, d):
    own = g.clear(graph(spark, d))
    return own.nodes.agg(F.count(F.lit(1)).alias("nodes")).join(own.edges.agg(F.count(F.lit(1)).alias("edges")), F.lit(True))
