"""Queries of sources, sinks and stores: what they need is first written to the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ashlar import plugins
from ashlar.catalog.contents import SOURCE, files, values
from ashlar.operators import content as c
from ashlar.operators import graph as g
from ashlar.operators import history as h
from ashlar.operators import policy as y
from ashlar.operators import report as r
from ashlar.operators import risk as k
from ashlar.operators import rules as u
from ashlar.plans.common import scratch
from ashlar.sources import readers, writers
from ashlar.sources.store import GraphStore
from ashlar.streaming import updates as up
from ashlar.views import oracle, view

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def written(spark, label: str, *lines: str) -> str:
    """A text file's folder."""
    path = scratch(spark, label)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return path


@query("s01_tree", values("language, n", "'python', 2", "'unknown', 1"))
def s01(spark, d):
    root = scratch(spark, "tree")
    for name in ("a/one.py", "b/two.py", "b/skip/three.py", "notes"):
        spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(f"{root}/{name}")
    tree = readers.read_tree(spark, root, ["*/_SUCCESS", "*.crc", "*/skip/*"]).where(~F.endswith("path", F.lit("_SUCCESS")))
    return tree.select(F.regexp_replace("path", "/part-.*", "").alias("path")).select(c.language_of(F.col("path")).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("s04_python_files", values("path", "'app/core.py'", "'bad.py'"))
def s04(spark, d):
    return readers.sources(files(spark), "python").select("path")


@query("s05_go_java_files", values("path", "'store/item.go'", "'a/Main.java'"))
def s05(spark, d):
    return readers.sources(files(spark), "go").unionByName(readers.sources(files(spark), "java")).select("path")


@query("s07_walk", values("path", "'src/a.py'"))
def s07(spark, d):
    rows = spark.createDataFrame([("src/a.py",), ("src/a_test.py",), ("node_modules/b.py",), (".git/c.py",)], "path string")
    return rows.where(readers.visible(F.col("path")) & ~F.rlike("path", F.lit(readers.glob_pattern("*_test.py"))))


SNAPSHOT = json.dumps({"metadata": {"version": "v1", "project_name": "p"}, "files": [{"path": "a.py", "risk": {"risk_score": 0.9, "level": "high"}, "issues": [{"rule_id": "r", "severity": "error", "location": {"line": 50}}]}, {"path": "b.py", "risk": {"risk_score": 0.2, "level": "low"}, "issues": [{"id": "own", "rule_id": "r", "severity": "warning", "location": {"line": 5}}]}], "dependencies": {"edges": [{"src": "a.py", "dst": "b.py"}]}})


@query("s08_snapshot", values("path, id, severity", "'a.py', 'r:a.py:50', 'error'", "'b.py', 'own', 'warning'"))
def s08(spark, d):
    return readers.snapshot_tables(readers.read_snapshot(spark, written(spark, "snapshot", SNAPSHOT)))["issues"].select("path", "id", "severity")


@query("s09_version", "SELECT path, score FROM v_files WHERE level = 'medium'")
def s09(spark, d):
    root, own = scratch(spark, "versions"), view(spark, d, "v_files").select("path", "score", "level")
    for level in ("low", "medium"):
        writers.write_version(own.where(F.col("level") == level), root, "p")
    return readers.read_version(spark, root, "v2").select("path", "score")


@query("s10_history", "SELECT 's2' AS snapshot, CAST(avg(score) * 100 AS INT) AS risk_score, (SELECT count(*) FROM v_issues) AS issues FROM v_files")
def s10(spark, d):
    root = scratch(spark, "history")
    own, issues = view(spark, d, "v_files"), view(spark, d, "v_issues")
    for name, time in (("s1", "2024-01-01"), ("s2", "2024-01-02")):
        writers.write_history(root, "p", name, time, own, issues)
    last = h.latest(spark.read.parquet(f"{root}/snapshots"), 1, "created_at").select("snapshot", F.floor("risk_score").cast("int").alias("risk_score"))
    counted = spark.read.parquet(f"{root}/issues").groupBy("snapshot").agg(F.count(F.lit(1)).alias("issues"))
    return last.join(counted, "snapshot")


ORACLES["s10_history"] = ORACLES["s10_history"].replace("CAST(avg(score) * 100 AS INT)", "CAST(trunc(avg(score) * 100) AS INT)")


@query("s18_git_log", values("path, commits, authors", "'a.py', 2, 2", "'b.py', 1, 1"))
def s18(spark, d):
    log = written(spark, "log", "c1\t1700000000\ta@x", "a.py", "b.py", "", "c2\t1700000100\tb@x", "a.py")
    return k.file_history(readers.read_git_log(spark, log)).select("path", "commits", "authors")


@query("s19_recent_commits", "SELECT path, count(*) AS commits FROM v_commits WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY path")
def s19(spark, d):
    return k.file_history(readers.recent(view(spark, d, "v_commits"), "2024-01-30", 10)).select("path", "commits")


COBERTURA = '<?xml version="1.0"?><coverage><classes><class filename="src/main.py" line-rate="1.0"/><class filename="src/utils.py" line-rate="0.0"/></classes></coverage>'
JACOCO = '<report name="x"><package name="com/a"><sourcefile name="B.java"><counter type="LINE" missed="5" covered="5"/></sourcefile></package></report>'
PROFILE = ("mode: set", "x/a.go:1.1,2.2 2 1", "x/b.go:1.1,2.2 10 0")


@query("s20_cobertura", values("path, rate", "'src/main.py', 1.0::DOUBLE", "'src/utils.py', 0.0::DOUBLE"))
def s20(spark, d):
    return readers.cobertura(spark, written(spark, "cobertura", COBERTURA)).select("path", "rate")


@query("s21_jacoco", values("path, rate", "'com/a/B.java', 0.5::DOUBLE"))
def s21(spark, d):
    return readers.jacoco(spark, written(spark, "jacoco", JACOCO)).select("path", "rate")


@query("s22_go_profile", values("path, rate", "'x/a.go', 1.0::DOUBLE", "'x/b.go', 0.0::DOUBLE"))
def s22(spark, d):
    return readers.go_profile(spark, written(spark, "profile", *PROFILE)).select("path", "rate")


@query("s23_any_coverage", values("path", "'src/main.py'", "'src/utils.py'", "'com/a/B.java'", "'x/a.go'", "'x/b.go'"))
def s23(spark, d):
    found = [readers.coverage(spark, written(spark, "coverage", *text)).select("path") for text in ((COBERTURA,), (JACOCO,), PROFILE)]
    return found[0].union(found[1]).union(found[2])


@query("s24_policy_source", values("rule, severity", "'r', 'error'"))
def s24(spark, d):
    import tomllib

    rules = y.policy_set(tomllib.loads('[[rules]]\nid = "r"\nactions = ["suggest_block_ci"]\n[[rules.conditions]]\nfield = "total_files"\nop = ">"\nvalue = 0\n'))
    return y.decisions(r.project_report(view(spark, d, "v_files"), view(spark, d, "v_issues")), rules).select("rule", "severity")


@query("s25_config", values("a, b", "'project', '[3]'"))
def s25(spark, d):
    found = readers.merged({"x": {"a": "default", "b": [1, 2]}}, {"x": {"a": "global"}}, {"x": {"a": "project", "b": [3]}})
    return spark.createDataFrame([(found["x"]["a"], str(found["x"]["b"]))], "a string, b string")


@query("s26_event_source", values("path, change_type", "'a.py', 'modify'"))
def s26(spark, d):
    folder, out = written(spark, "events", '{"path": "a.py", "change_type": "modify", "ts": "2024-01-01T00:00:00"}', '{"path": ".git/b.py", "change_type": "modify", "ts": "2024-01-01T00:00:00"}'), scratch(spark, "seen")
    seen = up.read_events(spark, folder).where(up.watched(F.col("path")))
    seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("path", "change_type")


@query("s27_cached", "SELECT level, count(*) AS n FROM v_files GROUP BY level")
def s27(spark, d):
    return r.tally(view(spark, d, "v_files").cache(), "level")


# Sinks

def store_of(spark, d) -> GraphStore:
    store = GraphStore(spark, scratch(spark, "graph"), 8)
    store.save(g.Graph(view(spark, d, "v_function").select("id", "type", "name", "complexity"), view(spark, d, "v_calls")))
    return store


@query("k03_store", "SELECT source, target, type FROM v_calls UNION SELECT 'function:1', 'function:new', 'calls'")
def k03(spark, d):
    store = store_of(spark, d)
    more = g.Graph(spark.createDataFrame([("function:new", "function", "new", 1)], "id string, type string, name string, complexity int"), spark.createDataFrame([("function:1", "function:new", "calls"), ("function:1", "gone", "calls")], "source string, target string, type string"))
    store.save(more, 7)
    store.save(more, 7)  # a batch that comes again changes nothing
    return store.graph.edges.select("source", "target", "type")


@query("k03_store_nodes", "SELECT id, type, name, complexity + 1 AS complexity FROM v_function WHERE complexity % 5 = 0 UNION ALL SELECT id, type, name, complexity FROM v_function WHERE complexity % 5 <> 0 UNION ALL SELECT 'function:new', 'function', 'new', 1")
def k03_nodes(spark, d):
    store = store_of(spark, d)
    changed = view(spark, d, "v_function").where("complexity % 5 = 0").select("id", "type", "name", (F.col("complexity") + 1).alias("complexity"))
    store.save_nodes(changed.union(spark.createDataFrame([("function:new", "function", "new", 1)], "id string, type string, name string, complexity int")))
    return store.graph.nodes.select("id", "type", "name", "complexity")


@query("k04_store_delete", "SELECT source, target FROM v_calls WHERE source NOT IN (SELECT id FROM v_function WHERE complexity > 25) AND target NOT IN (SELECT id FROM v_function WHERE complexity > 25)")
def k04(spark, d):
    store = store_of(spark, d)
    store.delete_nodes(store.query_nodes("function", {"complexity": {"$gt": 25}}).select("id"))
    return store.graph.edges.select("source", "target")


@query("x05_batches", "SELECT id FROM v_function WHERE NOT (complexity % 7 = 3 AND id LIKE '%1') UNION SELECT concat('file:', p_partkey % 100 + 1) FROM {part} WHERE p_size % 7 <> 3 OR NOT p_partkey % 10 = 1")
def x05(spark, d):
    """Changes by file, applied in two batches of which one comes twice: files are replaced or go with what they contain."""
    own, store = view(spark, d, "v_function"), GraphStore(spark, scratch(spark, "graph"), 8)
    contains = view(spark, d, "v_contains")
    files = contains.select(F.col("source").alias("id")).distinct().select("id", F.lit("file").alias("type"))
    store.save(g.Graph(files.unionByName(own.select("id", "type"), allowMissingColumns=True), contains))
    lost = own.where("complexity % 7 = 3 AND id LIKE '%1'").select("id")
    # Each file comes again without some of its functions, in two halves.
    kept = contains.join(lost.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target", "type")
    for half, names in (("a", ("a", "a")), ("b", ("b",))):
        mine = kept.where(F.col("source").endswith("1") if half == "a" else ~F.col("source").endswith("1"))
        paths = contains.where(F.col("source").endswith("1") if half == "a" else ~F.col("source").endswith("1")).select(F.expr("substring(source, 6)").alias("path"), F.lit("modify").alias("change")).distinct()
        built = g.Graph(mine.select(F.col("source").alias("id"), F.lit("file").alias("type")).union(mine.select("target", F.lit("function"))).distinct(), mine)
        for name in names:
            store.change(paths, built, batch=name)
    found, there = store.graph, contains.join(lost.withColumnRenamed("id", "target"), "target", "left_anti")
    return found.nodes.where("type = 'function'").select("id").union(found.nodes.where("type = 'file'").join(there.select(F.col("source").alias("id")), "id", "left_semi").select("id"))


@query("k07_history_rows", "SELECT path, rule_id, severity FROM v_issues")
def k07(spark, d):
    root = scratch(spark, "history")
    writers.write_history(root, "p", "s", "2024-01-01", view(spark, d, "v_files"), view(spark, d, "v_issues"))
    return spark.read.parquet(f"{root}/issues").select("path", "rule_id", "severity")


@query("k08_index", "SELECT project, day FROM (SELECT project, day, row_number() OVER (PARTITION BY project ORDER BY day DESC) AS rank FROM v_points) WHERE rank <= 5")
def k08(spark, d):
    return h.latest(view(spark, d, "v_points"), 5).select("project", "day")


@query("k09_json", "SELECT path, score FROM v_files")
def k09(spark, d):
    path = scratch(spark, "json")
    writers.write_json(view(spark, d, "v_files").select("path", "score"), path, "path string, score double")
    return spark.read.schema("path string, score double").json(path)


@query("k10_yaml", values("text", "'- name: a' || chr(10)"))
def k10(spark, d):
    return spark.createDataFrame([(writers.yaml_document(spark.createDataFrame([("a", None)], "name string, gone string")),)], "text string")


@query("k11_markdown", "SELECT '# Project report' AS head, count(*) + 0 AS files FROM v_files")
def k11(spark, d):
    own, issues = view(spark, d, "v_files"), view(spark, d, "v_issues")
    text = writers.report_markdown(r.project_report(own, issues), r.file_rows(own, issues))
    return spark.createDataFrame([(text.split("\n")[0], int(text.split("total_files: ")[1].split("\n")[0]))], "head string, files long")


@query("k12_report_json", "SELECT count(*) AS total_files FROM v_files")
def k12(spark, d):
    own, issues = view(spark, d, "v_files"), view(spark, d, "v_issues")
    path = scratch(spark, "report")
    writers.write_report(r.project_report(own, issues), r.file_rows(own, issues), path)
    return spark.read.text(f"{path}/what=project_summary").select(F.get_json_object("value", "$.total_files").cast("long").alias("total_files"))


@query("k12_junit_cases", "SELECT concat('<testcase classname=\"', path, '\" name=\"', rule_id, '\">', CASE WHEN severity = 'info' THEN '' ELSE concat('<failure type=\"', severity, '\"/>') END, '</testcase>') AS value FROM v_issues")
def k12_cases(spark, d):
    return writers.junit_cases(view(spark, d, "v_issues"))


@query("k14_console", "SELECT path, rule_id FROM v_issues WHERE severity IN ('error', 'warning') ORDER BY ord LIMIT 10")
def k14(spark, d):
    return r.first_issues(view(spark, d, "v_issues")).select("path", "rule_id")


@query("k15_audit_log", "SELECT count(*) AS n FROM {events}")
def k15(spark, d):
    path = scratch(spark, "audit")
    writers.append_log(spark.read.parquet(f"{d}/events.parquet"), path, 300)
    return spark.read.json(path).agg(F.count(F.lit(1)).alias("n"))


@query("k17_round_trip", "SELECT source, target, type FROM v_calls_sparse")
def k17(spark, d):
    own = g.Graph(view(spark, d, "v_function").select("id", "type", "complexity"), view(spark, d, "v_calls_sparse"))
    return writers.from_graph_json(writers.graph_json(own), "id string, type string, complexity int", "source string, target string, type string").edges


@query("k19_dotted_config", values("before, after", "7, 5"))
def k19(spark, d):
    config = readers.set_dotted({"a": {"b": 7}}, "a.c.d", 5)
    return spark.createDataFrame([(readers.get_dotted(config, "a.b"), readers.get_dotted(config, "a.c.d"))], "before int, after int")


# Content and plugins

@query("p13_digest", values("name, args, ret", "'handle', 'self,item', NULL", "'run', 'self,items', 'int'", "'fetchAll', 'url', NULL", "'snake_name', '', NULL"))
def p13(spark, d):
    return c.digest(c.extract(files(spark))).select("name", F.concat_ws(",", "args").alias("args"), "ret")


@query("p16_analysis", values("part, n", "'complexity', 1", "'imports', 4", "'patterns', 0"))
def p16(spark, d):
    return spark.createDataFrame([(name, df.count()) for name, df in c.analysis(files(spark)).items()], "part string, n long")


@query("p18_intervals", """WITH s AS (SELECT concat('file:', p_size) AS path, p_partkey AS a, p_partkey + p_size AS b FROM {part}),
f AS (SELECT *, CASE WHEN a >= max(b) OVER (PARTITION BY path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY path ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT path, min(a) AS start, max(b) AS "end" FROM i GROUP BY path, island""")
def p18(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return c.merged_intervals(part.select(F.concat(F.lit("file:"), "p_size").alias("path"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end")))


@query("u06_selection", values("rule_id, n", "'high-fan-out', 1"))
def u06(spark, d):
    facts = c.extract(files(spark))
    metrics = spark.createDataFrame([("a.py", 20, 10)], "path string, fan_out int, lines_of_code int")
    chosen = u.baseline(c.exploded(facts, "functions"), metrics, complexity=False, size=False)
    return u.run_rules(chosen)[0].groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("e03_registration", values("rule, problem", "'x', NULL", "'bad', 'ValueError(''no'')'"))
def e03(spark, d):
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:  # plugins are code on the driver
        Path(folder, "good.py").write_text("def register(registry):\n    registry.rule('x', lambda path, content, context: [])\n")
        Path(folder, "bad.py").write_text("raise ValueError('no')\n")
        registry = plugins.Registry().load(folder)
    return spark.createDataFrame([(name, None) for name in registry.rules] + list(registry.errors.items()), "rule string, problem string")


@query("e08_strategies", values("kind, same", "'full', TRUE", "'skeleton', FALSE", "'signature', FALSE"))
def e08(spark, d):
    return spark.createDataFrame([(kind, c.compress(SOURCE, kind) == SOURCE) for kind in ("full", "skeleton", "signature")], "kind string, same boolean")


@query("e09_adapter", values("has_node, edges", "TRUE, 0"))
def e09(spark, d):
    store = store_of(spark, d)
    there = store.has_node("function:1")
    store.clear()
    return spark.createDataFrame([(there, store.graph.edges.count())], "has_node boolean, edges long")


@query("x04_stream_to_graph", values("id", "'file:a.py'", "'function:a.py:h'"))
def x04(spark, d):
    node, edge = "id string, type string, name string", "source string, target string, type string"
    own = g.Graph(spark.createDataFrame([("file:a.py", "file", "a.py"), ("function:a.py:f", "function", "f"), ("file:b.py", "file", "b.py")], node), spark.createDataFrame([("file:a.py", "function:a.py:f", "contains")], edge))
    store = scratch(spark, "graph")
    GraphStore(spark, store, 4).save(own)
    times = [("a.py", "modify", "2024-01-01T00:00:00"), ("a.py", "modify", "2024-01-01T00:00:00.500"), ("b.py", "delete", "2024-01-01T00:00:00"), ("late.py", "modify", "2024-01-01T02:00:00")]
    events = written(spark, "events", *(json.dumps(dict(zip(("path", "change_type", "ts"), row))) for row in times))

    def build(paths):
        mine = paths.where("path = 'a.py'")
        nodes = mine.select(F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(t).alias("type"), F.lit(n).alias("name")) for i, t, n in (("file:a.py", "file", "a.py"), ("function:a.py:h", "function", "h"))))).alias("n")).select("n.*")
        return g.Graph(nodes, mine.select(F.lit("file:a.py").alias("source"), F.lit("function:a.py:h").alias("target"), F.lit("contains").alias("type")))

    up.maintain(up.read_events(spark, events), store, build, scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return GraphStore(spark, store, 4).graph.nodes.select("id")
