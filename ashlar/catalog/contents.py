"""Queries of content analysis, rules, text operators, streams and plugins.

The driver's tables hold prose, so sources for the Python rules are given here; rules over lines run over the documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar import plugins
from ashlar.operators import content as c
from ashlar.operators import dependencies as deps
from ashlar.operators import rules as u
from ashlar.operators import text as x
from ashlar.schema import node_id
from ashlar.streaming import expiry
from ashlar.streaming import updates as up
from ashlar.plans.common import scratch
from ashlar.views import oracle, view

QUERIES: dict = {}
ORACLES: dict = {}
SOURCE = '''"""Core."""
import os
import numpy as np
from app.util import helper, other as o

timeout = 30
MAX_RETRIES = 5
PATH = "/etc/passwd"


class Base:
    """Base."""

    kind = "base"

    def handle(self, item):
        try:
            if item and self.kind:
                return helper(item)
        except Exception:
            pass


class Child(Base):
    def run(self, items: list) -> int:
        """Run."""
        for item in items:
            print(item)
        return len([i for i in items if i])


async def fetchAll(url):
    while url:
        conn = connect(url)
        conn.send(url)
    return None


def snake_name():
    pass
'''
GO = 'package store\n\nimport (\n\t"fmt"\n\t"github.com/x/y"\n)\n\ntype Item struct {}\ntype Source interface {}\n\nfunc NewItem() *Item {\n\tgo run()\n\tif err != nil {\n\t}\n\treturn nil\n}\n'
JAVA = "package a.b;\nimport java.util.List;\npublic class Main {\n  @Override\n  public int size(List x) {\n    if (x == null) return 0;\n    return 1;\n  }\n}\n"
SHELL = '#!/bin/bash\nsource lib.sh\nNAME=x\ngreet() {\n  echo hi\n}\ngreet\ncurl http://x | grep y\n'


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) x({columns})"


def files(spark):
    rows = [("app/core.py", "python", SOURCE), ("store/item.go", "go", GO), ("a/Main.java", "java", JAVA), ("run.sh", "shell", SHELL), ("bad.py", "python", "def (")]
    return spark.createDataFrame(rows, "path string, language string, content string")


def facts(spark, what=None):
    found = c.extract(files(spark))
    return c.exploded(found, what) if what else found


@query("p01_functions", values("qualified_name, line_start, complexity, is_async", "'Base.handle', 16, 4, FALSE", "'Child.run', 25, 3, FALSE", "'fetchAll', 32, 2, TRUE", "'snake_name', 39, 1, FALSE"))
def p01(spark, d):
    return facts(spark, "functions").select("qualified_name", "line_start", "complexity", "is_async")


@query("p02_classes", values("name, bases, methods, fields", "'Base', '', 'handle', 'kind'", "'Child', 'Base', 'run', ''"))
def p02(spark, d):
    return facts(spark, "classes").select("name", F.concat_ws(",", "bases").alias("bases"), F.concat_ws(",", "methods").alias("methods"), F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("fields"))


@query("p03_imports", values("path, alias, line", "'os', NULL, 2", "'numpy', 'np', 3", "'app.util.helper', NULL, 4", "'app.util.other', 'o', 4"))
def p03(spark, d):
    imports = facts(spark).select(F.explode("imports").alias("i"))
    return imports.select("i.path", "i.alias", "i.line")


@query("p04_globals", values("name, line", "'timeout', 6", "'MAX_RETRIES', 7", "'PATH', 8"))
def p04(spark, d):
    return facts(spark, "variables").select("name", "line")


@query("p05_semantic_tags", values("name, tags", "'handle', ''", "'run', 'io_op'", "'fetchAll', 'network'", "'snake_name', ''"))
def p05(spark, d):
    return c.semantic_tags(facts(spark, "functions")).select("name", F.concat_ws(",", "tags").alias("tags"))


@query("p06_complexity", values("digest, risk, cst", "7, 7, 8"))
def p06(spark, d):
    import ast

    tree = [ast.parse(SOURCE)]
    return spark.createDataFrame([tuple(c.complexity(tree, k) for k in ("digest", "risk", "cst"))], "digest int, risk int, cst int")


@query("p07_cognitive", values("name, cognitive", "'handle', 4", "'run', 1", "'fetchAll', 1", "'snake_name', 0"))
def p07(spark, d):
    return facts(spark, "functions").select("name", "cognitive")


@query("p08_go", values("package, imports, functions, structs, interfaces, goroutines", "'store', 'fmt,github.com/x/y', 'NewItem', 'Item', 'Source', 1"))
def p08(spark, d):
    found = c.go_facts(files(spark))
    return found.select("package", *(F.concat_ws(",", k).alias(k) for k in ("imports", "functions", "structs", "interfaces")), "goroutines")


@query("p10_go_fallback", values("package, error_checks", "'store', 1"))
def p10(spark, d):
    return c.go_facts(files(spark)).select("package", "error_checks")


@query("p10_page_links", "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM {pages}")
def p10_pages(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", F.regexp_count("html", F.lit('href="[^"]*"')).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("p11_java", values("package, imports, classes, methods, annotations, complexity", "'a.b', 'java.util.List', 'Main', 'size', 'Override', 4"))
def p11(spark, d):
    return c.java_facts(files(spark)).select("package", *(F.concat_ws(",", k).alias(k) for k in ("imports", "classes", "methods", "annotations")), "complexity")


@query("p12_shell", values("functions, variables, imports, commands", "'greet', 'NAME', 'lib.sh', 'curl,echo,grep'"))
def p12(spark, d):
    return c.shell_facts(files(spark)).select(*(F.concat_ws(",", k).alias(k) for k in ("functions", "variables", "imports", "commands")))


@query("p14_patterns", values("kind, name, confidence", "'factory', 'NewItem', 0.8::DOUBLE"))
def p14(spark, d):
    go = c.go_facts(files(spark)).select("path", F.explode("functions").alias("name"), F.lit(1).alias("line_start"), F.lit(5).alias("line_end"))
    own = facts(spark, "functions").select("path", "name", "line_start", "line_end").unionByName(go)
    return c.patterns(own, facts(spark, "classes")).select("kind", "name", "confidence")


@query("p15_threshold_issues", values("rule_id, severity, message", "'high-complexity', 'warning', 'complexity 7'", "'dependency-cycle', 'error', 'a -> b'", "'dependency-depth', 'warning', 'depth 7'"))
def p15(spark, d):
    metrics = facts(spark).where("parsed").select("path", F.col("complexity").alias("cyclomatic"))
    loops = deps.cycles(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "source string, target string"))
    return c.threshold_issues(metrics, loops, spark.createDataFrame([(7,)], "depth int"), most=6).select("rule_id", "severity", "message")


@query("p17_compression", values("strategy, lines, pruned", "'full', 40, FALSE", "'signature', 4, FALSE", "'skeleton', 31, TRUE"))
def p17(spark, d):
    own = files(spark).where("path = 'app/core.py'").withColumn("strategy", F.explode(F.array(*map(F.lit, ("full", "skeleton", "signature")))))
    return c.compressed(own).select("strategy", c.line_count(F.col("text")).alias("lines"), F.contains("text", F.lit("# Pruned")).alias("pruned"))


@query("a07_file_complexity", values("path, max_complexity, avg_complexity, over", "'app/core.py', 4, 2.5::DOUBLE, 1"))
def a07(spark, d):
    return c.file_complexity(facts(spark, "functions"), 3)


@query("a08_semantic_metrics", values("path, cyclomatic, cognitive, max_complexity, avg_complexity", "'app/core.py', 10, 6, 4, 2.5::DOUBLE"))
def a08(spark, d):
    return c.semantic_metrics(facts(spark, "functions"))


@query("a09_halstead", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+|[.,;:!?]')) AS value FROM {documents}), k AS (SELECT doc_id, value, CASE WHEN regexp_matches(value, '[a-z]') THEN 'operand' ELSE 'operator' END AS kind FROM t),
n AS (SELECT concat('doc/', doc_id) AS path, count(DISTINCT value) FILTER (kind = 'operator') AS d1, count(DISTINCT value) FILTER (kind = 'operand') AS d2, count(*) AS t FROM k GROUP BY doc_id) SELECT path, d1 + d2 AS length, t AS vocabulary, round((d1 + d2) * log2(t), 4) AS volume FROM n WHERE d1 > 0 AND d2 > 0""")
def a09(spark, d):
    tokens = view(spark, d, "v_docs").select("path", F.explode(F.regexp_extract_all("content", F.lit("[a-z]+|[.,;:!?]"), 0)).alias("value"))
    return c.halstead(tokens.withColumn("kind", F.when(F.rlike("value", F.lit("[a-z]")), "operand").otherwise("operator"))).select("path", "length", "vocabulary", F.round("volume", 4).alias("volume"))


@query("a10_module_digest", values("module, classes, functions, avg_complexity, complex", "'app.core', 2, 4, 2.5::DOUBLE, 0", "'bad', 0, 0, 0.0::DOUBLE, 0"))
def a10(spark, d):
    return c.module_digest(facts(spark, "functions"), facts(spark, "classes"), files(spark).where("language = 'python'"))


@query("a10_tech_stack", values("name", "'numpy'"))
def a10_stack(spark, d):
    return c.tech_stack(QUERIES["p03_imports"](spark, d).select("path"), spark.createDataFrame([("app.core",)], "module string"))


@query("a11_module_imports", values("module, deps", "'app.core', 'app.util.helper,app.util.other,numpy'"))
def a11(spark, d):
    imports = facts(spark).select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.path")
    return c.module_imports(imports).withColumn("deps", F.concat_ws(",", "deps"))


@query("a12_go_packages", values("package, files, error_checks, deps", "'store', 1, 1, 'github.com/x/y'"))
def a12(spark, d):
    return c.go_packages(c.go_facts(files(spark))).withColumn("deps", F.concat_ws(",", "deps"))


@query("a23_java_complexity", values("path, complexity", "'a/Main.java', 4"))
def a23(spark, d):
    return c.java_facts(files(spark)).select("path", "complexity")


@query("a24_ast_summary", values("path, function_count, class_count, import_count", "'app/core.py', 4, 2, 4", "'bad.py', 0, 0, 0"))
def a24(spark, d):
    return c.ast_summary(facts(spark)).drop("comment_lines")


@query("a25_go_concurrency", values("goroutines, channel_ops, error_checks", "1, 0, 1"))
def a25(spark, d):
    return c.go_facts(files(spark)).select("goroutines", "channel_ops", "error_checks")


@query("s02_language", values("path, language", "'a/b.PY', 'python'", "'x.go', 'go'", "'q.hh', 'cpp'", "'Makefile', 'unknown'", "'s.zsh', 'shell'"))
def s02(spark, d):
    return spark.createDataFrame([("a/b.PY",), ("x.go",), ("q.hh",), ("Makefile",), ("s.zsh",)], "path string").select("path", c.language_of(F.col("path")).alias("language"))


@query("s03_languages", "SELECT DISTINCT lang AS language FROM {documents}")
def s03(spark, d):
    return view(spark, d, "v_docs").select("language").distinct()


@query("s06_shebang", values("path", "'run.sh'", "'tool'"))
def s06(spark, d):
    rows = spark.createDataFrame([("run.sh", ""), ("tool", "#!/usr/bin/env bash\nx"), ("data", "x"), ("a.py", "#!/bin/sh")], "path string, content string")
    return rows.where(c.is_shell(F.col("path"), F.col("content"))).select("path")


@query("g14_build_graph", values("source, target, type", "'file:a.py', 'function:a.py:f', 'contains'", "'file:a.py', 'function:a.py:g', 'contains'", "'file:a.py', 'class:a.py:K', 'contains'", "'function:a.py:f', 'function:a.py:g', 'calls'", "'file:a.py', 'module:os', 'imports'"))
def g14(spark, d):
    return deps.build_graph(record(spark)).edges.select("source", "target", "type")


def record(spark):
    call = lambda n: (n, 1, "call", "")
    fn = lambda n, calls: (n, n, 1, 2, 1, ["x"], None, [], None, False, False, calls)
    row = ("a.py", "python", None, "x = 1\ny = 2\n", [fn("f", [call("g"), call("print")]), fn("g", [])], [("K", "K", 5, 9, ["Missing"], [("m",)])], [("os", None, None, "import", 1)])
    return spark.createDataFrame([row], deps.RECORD)


@query("g15_file_nodes", values("id, loc", "'file:a.py', 2"))
def g15(spark, d):
    return deps.build_graph(record(spark)).nodes.where("type = 'file'").select("id", F.col("loc").cast("int").alias("loc"))


@query("g16_nodes", values("id, type, name", "'file:a.py', 'file', 'a.py'", "'module:os', 'module', 'os'", "'function:a.py:f', 'function', 'f'", "'function:a.py:g', 'function', 'g'", "'class:a.py:K', 'class', 'K'"))
def g16(spark, d):
    return deps.build_graph(record(spark)).nodes.select("id", "type", "name")


@query("g17_call_targets", "SELECT p_partkey, CASE WHEN p_size < 10 THEN concat('function:builtin.', 'len') WHEN p_size < 20 THEN concat('function:external.', p_name) ELSE concat('function:', p_partkey) END AS target FROM {part}")
def g17(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    known = F.when(F.col("p_size") >= 20, F.concat(F.lit("function:"), "p_partkey"))
    return part.select("p_partkey", deps.resolved_call(known, F.when(F.col("p_size") < 10, "len").otherwise(F.col("p_name"))).alias("target"))


@query("g20_symbol_index", values("name, file", "'f', 'x/a.py'", "'h', 'y/a.py'"))
def g20(spark, d):
    return deps.symbol_index(symbols(spark)).select("name", "file")


def symbols(spark):
    return spark.createDataFrame([("x/a.py", "f", "function", "module", True), ("x/a.py", "g", "function", "local", False), ("y/a.py", "h", "class", "module", False)], "file string, name string, type string, scope string, is_exported boolean")


def resolved(spark):
    imports = spark.createDataFrame([("m.py", "x.a"), ("m.py", "x.a.f"), ("m.py", "a.h"), ("m.py", "gone"), ("x/a.py", "x.a")], "file string, path string")
    return deps.resolve_imports(imports, spark.createDataFrame([("m.py",), ("x/a.py",), ("y/a.py",)], "path string"), symbols(spark))


@query("g21_resolve_imports", values("file, path, defined_in, symbol", "'m.py', 'x.a', 'x/a.py', NULL", "'x/a.py', 'x.a', 'x/a.py', NULL", "'m.py', 'x.a.f', 'x/a.py', 'f'", "'m.py', 'a.h', 'y/a.py', 'h'"))
def g21(spark, d):
    return resolved(spark)


@query("g22_file_graph", values("src, dst", "'m.py', 'x/a.py'", "'m.py', 'y/a.py'"))
def g22(spark, d):
    return deps.file_dependencies(resolved(spark))


@query("m01_node_id", "SELECT concat('function:', CASE WHEN length(b) > 200 THEN concat(substr(b, 1, 180), '...', substr(md5(b), 1, 8)) ELSE b END) AS id FROM (SELECT concat('f.py:', text) AS b FROM {documents})")
def m01(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(node_id(F.lit("function"), F.col("text"), F.lit("f.py")).alias("id"))


def rule_query(name: str, make, *rows: str) -> None:
    @query(name, values("rule_id, severity, line", *rows))
    def run(spark, d, make=make):
        return make(spark).select("rule_id", "severity", "line")


rule_query("u02_high_complexity", lambda s: u.high_complexity(facts(s, "functions"), 3), "'high-cyclomatic-function', 'warning', 16")
rule_query("u05_return_hint", lambda s: u.missing_return_hint(facts(s, "functions")), *(f"'missing-return-hint', 'info', {n}" for n in (16, 32, 39)))
rule_query("u07_empty_handler", lambda s: u.empty_handler(facts(s)), "'001', 'error', 20")
rule_query("u08_hardcoded_config", lambda s: u.hardcoded_config(facts(s)), "'002', 'warning', 6", "'002', 'warning', 7")
rule_query("u09_mixed_naming", lambda s: u.mixed_naming(facts(s, "functions")), "'003', 'info', 1")
rule_query("u10_long_function", lambda s: u.long_function(facts(s, "functions"), 4), "'004', 'warning', 16")
rule_query("u12_hardcoded_path", lambda s: u.hardcoded_path(facts(s)), "'006', 'warning', 8")
rule_query("u13_print", lambda s: u.prints(facts(s)), "'007', 'info', 28")
rule_query("u14_broad_except", lambda s: u.broad_except(facts(s)), "'008', 'warning', 20")
rule_query("u15_placeholder", lambda s: u.placeholder(facts(s, "functions")), "'009', 'info', 39")
rule_query("u16_docstring", lambda s: u.missing_docstring(facts(s, "functions")), "'010', 'info', 16", "'010', 'info', 39")


@query("u03_fan_out", "SELECT path, 'warning' AS severity FROM v_metrics WHERE fan_out > 15")
def u03(spark, d):
    return u.high_fan_out(view(spark, d, "v_metrics")).select("path", "severity")


@query("u04_large_file", "SELECT path, 'info' AS severity FROM v_metrics WHERE lines_of_code > 950")
def u04(spark, d):
    return u.large_file(view(spark, d, "v_metrics"), 950).select("path", "severity")


LINES = "(SELECT concat('doc/', doc_id) AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {documents})"


@query("u11_leftover", f"SELECT path, pos::INT AS line FROM {LINES} WHERE contains(line, 'trash')")
def u11(spark, d):
    return u.leftover(view(spark, d, "v_docs"), "trash").select("path", "line")


@query("u01_rule_engine", values("rule_id, n", "'001', 1", "'002', 2", "'003', 1", "'006', 1", "'007', 1", "'008', 1", "'009', 1", "'010', 2"))
def u01(spark, d):
    return u.run_rules(u.source_rules(files(spark), facts(spark)))[0].groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("u17_severity", values("given, severity", "'HIGH', 'error'", "'low', 'info'", "'Warning', 'warning'", "'odd', 'warning'"))
def u17(spark, d):
    return spark.createDataFrame([("HIGH",), ("low",), ("Warning",), ("odd",)], "given string").select("given", u.plugin_severity(F.col("given")).alias("severity"))


@query("u18_recomputed_summary", values("kind, key, n", "'total', NULL, 3", "'severity', 'error', 1", "'severity', 'info', 2", "'rule', '001', 1", "'rule', '007', 1", "'rule', '009', 1"))
def u18(spark, d):
    own = facts(spark)
    return u.run_rules([u.empty_handler(own), u.prints(own), u.placeholder(facts(spark, "functions"))])[1]


@query("line_count", "SELECT concat('doc/', doc_id) AS path, (len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END)::INT AS lines FROM {documents} WHERE text <> '' AND NOT regexp_matches(text, '[\\r\\x0b\\x0c\\x1c-\\x1e]')")
def line_count(spark, d):
    """Of every document. The SQL leaves out texts that are empty or have line ends besides LF; the given tables have none."""
    return view(spark, d, "v_docs").select("path", c.line_count(F.col("content")).alias("lines"))


# Text

@query("t05_template", "SELECT path, coalesce(e.template, f.template) AS template FROM v_files v LEFT JOIN (VALUES ('BUILDING', 'p1', 'exact')) e(language, rule_id, template) ON e.language = v.language AND e.rule_id = v.project LEFT JOIN (VALUES ('BUILDING', 'own')) f(language, template) ON f.language = v.language")
def t05(spark, d):
    templates = spark.createDataFrame([("BUILDING", "p1", "exact"), ("BUILDING", None, "own")], "language string, rule_id string, template string")
    return x.with_template(view(spark, d, "v_files").select("path", "language", F.col("project").alias("rule_id")), templates).select("path", "template")


@query("t06_context_lines", f"SELECT path, string_agg(line, chr(10) ORDER BY pos) AS context FROM {LINES} WHERE pos BETWEEN 1 AND 4 GROUP BY path")
def t06(spark, d):
    return view(spark, d, "v_docs").select("path", x.context_lines(F.col("content"), F.lit(2), 4).alias("context"))


@query("t07_prompt", "SELECT path, concat('Fix ', path, chr(10), chr(10), 'in ', language) AS prompt FROM v_files")
def t07(spark, d):
    return view(spark, d, "v_files").select("path", x.rendered(F.lit("\nFix {path}\n\n\n\nin {language}\n"), {"path": F.col("path"), "language": F.col("language")}).alias("prompt"))


@query("t08_fuzzy_anchor", values("name, found", "'f', 'def f(a, b):'", "'h', 'def handler(x):'"))
def t08(spark, d):
    wanted = spark.createDataFrame([("a.py", "f", "def f():"), ("a.py", "h", "def handle(x):"), ("a.py", "zz", "nothing like it")], "path string, name string, anchor string")
    there = spark.createDataFrame([("a.py", "f", "def f(a, b):", 0), ("a.py", "g", "def handler(x):", 1)], "path string, name string, anchor string, ord int")
    return x.best_anchor(wanted, there).select("name", "found")


REPLY = "Here:\n```text\nno\n```\n```python\nx = 1\n```\nBecause."


@query("t11_code_block", values("own, other", "'x = 1' || chr(10), 'no' || chr(10)"))
def t11(spark, d):
    return spark.range(1).select(x.code_block(F.lit(REPLY), "python").alias("own"), x.code_block(F.lit(REPLY), "go").alias("other"))


@query("t12_block_replacement", values("content", "'a' || chr(10) || 'def f():' || chr(10) || '    return 2' || chr(10) || 'b'"))
def t12(spark, d):
    edit = [("p", "a\ndef f():\n    return 1\nb", "def f( ):", "def f():\n    return 2")]
    return x.block_replaced(spark.createDataFrame(edit, "path string, content string, header string, replacement string")).select("content")


@query("t13_suggestion", values("explanation, confidence", "chr(10) || 'Because.', 0.8::DOUBLE"))
def t13(spark, d):
    found = spark.range(1).select(x.suggestion(F.lit(REPLY), "python").alias("s"))
    return found.select("s.explanation", "s.confidence")


@query("t14_syntax_check", values("path, parses", "'app/core.py', TRUE", "'bad.py', FALSE"))
def t14(spark, d):
    return x.is_python(files(spark).where("language = 'python'"))


@query("d11_text_diff", values("diff", "concat_ws(chr(10), '--- old', '+++ new', '@@ -1,2 +1,2 @@', ' a', '-b', '+c')"))
def d11(spark, d):
    return x.text_diff(spark.createDataFrame([("p", "a\nb", "a\nc")], "path string, old string, new string")).select("diff")


# Streams

@query("x01_source_filter", values("path", "'src/a.py'", "'b.TSX'"))
def x01(spark, d):
    rows = spark.createDataFrame([("src/a.py",), (".git/a.py",), ("build/x.go",), ("b.TSX",), ("c.txt",)], "path string")
    return rows.where(up.watched(F.col("path")))


SESSIONS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM v_events WINDOW w AS (PARTITION BY path ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
s AS (SELECT path, CASE WHEN bool_or(change_type = 'delete') THEN 'delete' WHEN count(*) > 1 THEN 'modify' ELSE min(change_type) END AS change, count(*) AS events, min(ts) AS first, max(ts) AS last FROM n GROUP BY path, session) """


@query("x02_debounce", SESSIONS + "SELECT path, change, events, first, last FROM s")
def x02(spark, d):
    return up.coalesced(view(spark, d, "v_events"), 1_800_000_000)


@query("x03_merge", SESSIONS + "SELECT change, count(*) AS n FROM s GROUP BY change")
def x03(spark, d):
    return up.coalesced(view(spark, d, "v_events"), 1_800_000_000).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("x07_statistics", SESSIONS + "SELECT sum(events)::BIGINT AS events, count(*) AS changes, count(*) FILTER (change = 'delete') AS deletes, round(avg(epoch_us(last) - epoch_us(first)) / 1e6, 3) AS mean_seconds FROM s")
def x07(spark, d):
    return up.statistics(up.coalesced(view(spark, d, "v_events"), 1_800_000_000)).withColumn("mean_seconds", F.round("mean_seconds", 3))


@query("x08_forced", "SELECT concat('doc/', d) AS path, CASE WHEN EXISTS (SELECT 1 FROM {documents} WHERE doc_id = d) THEN 'modify' ELSE 'delete' END AS change_type FROM (VALUES (1), (-1)) t(d)")
def x08(spark, d):
    return up.forced(spark.createDataFrame([("doc/1",), ("doc/-1",)], "path string"), view(spark, d, "v_docs"), "2024-01-01").select("path", "change_type")


@query("x09_expiry", "SELECT event_id FROM {events} WHERE ts + INTERVAL 3600 SECONDS > TIMESTAMP '2024-01-30 00:00:00'")
def x09(spark, d):
    return up.unexpired(spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("ts", "updated_at"), "2024-01-30 00:00:00").select("event_id")


@query("x09_state", "SELECT concat('u', user_id) AS key, count(*) AS writes, max(ts) AS ts, TRUE AS fresh FROM {events} WHERE user_id IS NOT NULL GROUP BY user_id")
def x09_state(spark, d):
    """All events as a stream in one batch; nothing has expired by its end."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_type").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    folder, out = scratch(spark, "events"), scratch(spark, "latest")
    events.write.parquet(folder)
    stream = expiry.latest(spark.readStream.schema(events.schema).parquet(folder)).writeStream.option("checkpointLocation", scratch(spark, "state")).option("path", out)
    stream.format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("key", "writes", "ts", "fresh")


# Plugins

def prints(path: str, content: str, context: dict) -> list[tuple[str, int, str]]:
    """Lines that print and aren't comments."""
    return [("low", n, "print") for n, line in enumerate(content.splitlines(), 1) if "print(" in line and not line.lstrip().startswith("#")]


@query("e01_plugin_rule", values("path, severity, line", "'app/core.py', 'info', 28"))
def e01(spark, d):
    registry = plugins.Registry()
    registry.rule("no-print", prints)
    return plugins.run_rules(files(spark), registry).select("path", "severity", "line")


@query("e02_analyzer", values("language, n", "'python', 2", "'go', 1", "'java', 1", "'shell', 1"))
def e02(spark, d):
    registry = plugins.Registry()
    registry.analyzer("languages", lambda df: df.groupBy("language").agg(F.count(F.lit(1)).alias("n")))
    return plugins.run_analyzers(files(spark), registry)["languages"]


@query("e10_table_function", values("path, line", "'app/core.py', 28"))
def e10(spark, d):
    plugins.as_table_function(spark, "no_print", prints)
    return spark.sql("SELECT path, line FROM {files}, LATERAL no_print(path, content)", files=files(spark))
