"""Content analysis over programs that are written from the rows of part, one in each language for each part.

What a program holds follows from p_partkey, p_size and p_brand by the templates below, so SQL that never sees the programs
says what must be found in them: k conditions, w loops, and a handler where h is 1.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar import plugins
from ashlar.operators import content as c
from ashlar.operators import curly
from ashlar.operators import rules as u
from ashlar.operators import tasks as t
from ashlar.plans.common import scratch, spread
from ashlar.sources import writers
from ashlar.views import oracle

QUERIES: dict = {}
ORACLES: dict = {}

#: The numbers that the templates use, for Spark and DuckDB alike.
NUMBERS = (
    "p_partkey AS n, p_brand AS brand, p_size AS size, p_size % 5 AS b, p_size % 28 AS k, p_size % 3 AS w, (p_size + 1) % 2 AS h, "
    "CASE WHEN p_size % 7 = 0 THEN 'fetch' ELSE 'fetchPart' END AS loader, concat('src/m', p_partkey % 100, '/part', p_partkey, '.py') AS path"
)
PYTHON = (
    ('"""Part {n}."""\nimport os\nimport lib{b} as m\nfrom app.m{w} import helper\nlimit = {size}\nPATH = "/srv/{brand}"\n\n\n', "1"),
    ('class Item{n}(Base{b}):\n    """Item."""\n    kind = "x"\n\n    def run(self, items):\n', "1"),
    ("        if items:\n            items = items[1:]\n", "k"),
    ("        return items\n\n\nasync def {loader}(url):\n", "1"),
    ("    while url:\n        url = url[1:]\n", "w"),
    ("    print(url)\n", "1"),
    ("    try:\n        connect(url)\n    except Exception:\n        pass\n", "h"),
    ("\n\ndef to_do():\n    pass\n", "1"),
)
GO = (
    ('package p{w}\n\nimport (\n\t"fmt"\n\t"github.com/x/l{b}"\n)\n\ntype Item{n} struct {}\ntype Source interface {}\n\nfunc New{n}() *Item{n} {\n', "1"),
    ("\tgo run()\n", "w"),
    ("\tif err != nil {\n\t}\n", "h"),
    ("\treturn nil\n}\n", "1"),
)
JAVA = (
    ("package a.p{b};\nimport java.util.List;\npublic class Main{n} {\n  @Override\n  public int size{n}(List x) {\n", "1"),
    ("    if (x == null) return 0;\n", "k"),
    ("    return 1;\n  }\n}\n", "1"),
)
#: Generics, receivers, embedded fields, records, annotations; and strings and comments with code that mustn't count.
GO_TYPED = (
    ('package p{w}\n\nimport f "fmt"\n\n// func Hidden() {}\ntype Item{n}[K comparable] struct {\n\tBase{b}\n\tA, B int `json:"a"`\n}\n\ntype Reader interface {\n\tRead(p []byte) error\n}\n\nfunc (i *Item{n}[K]) Load(key K, more ...int) (K, error) {\n', "1"),
    ('\tif key == nil && i.A > 0 { // if\n\t\tx := "if { return }"\n\t}\n', "k"),
    ("\tfor range i.B {\n\t\tgo func() { _ = '{' }()\n\t}\n", "w"),
    ("\treturn key, nil\n}\n\nfunc make{n}() {}\n", "1"),
)
JAVA_TYPED = (
    ('package a.p{b};\nimport java.util.*;\n/* class No {} */\n@Service("x{")\npublic class Main{n}<T extends Comparable<T>> extends Base{b}<T> implements Runnable {\n  String s = "if (x) { return; }";\n'
     '  @GetMapping(path = "/x")\n  protected <R> List<R> load{n}(final Map<String, R> in, int... more) throws IOException {\n', "1"),
    ("    for (int i : more) { x = i > 0 ? i : 1; } // for\n", "k"),
    ("    do { i--; } while (i > 0 && i < 9);\n", "w"),
    ("    return null;\n  }\n  record Point(int x, List<T> ys) { Point { check(x); } }\n  abstract void none();\n}\n", "1"),
)
SHELL = (("#!/bin/bash\nsource lib{b}.sh\nNAME{n}=x\ngreet{n}() {\n  echo hi\n}\ngreet{n}\ncurl http://x | grep y\n", "1"),)


def programs(spark, d, template, language):
    """(path, language, content) for each part."""
    part = spread(spark.read.parquet(f"{d}/part.parquet"), "p_partkey").selectExpr(*[x.strip() for x in _split(NUMBERS)])

    def filled(text):
        pieces = F.lit("")
        for at, piece in enumerate(_holes(text)):
            pieces = F.concat(pieces, F.col(piece).cast("string") if at % 2 else F.lit(piece))
        return pieces

    content = F.concat(*[F.repeat(filled(text), F.col(times).cast("int")) if times != "1" else filled(text) for text, times in template])
    return part.select("path", F.lit(language).alias("language"), content.alias("content"))


def _holes(text):
    """Literal, name, literal, name, ..., of a template whose holes are {names}."""
    import re

    return re.split(r"\{(n|b|w|h|k|size|brand|loader)\}", text)


def _split(columns):
    """At the commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, char in enumerate(columns):
        depth += (char == "(") - (char == ")")
        if char == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


def query(name, sql):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = oracle(f"WITH p AS (SELECT {NUMBERS} FROM {{part}}), fn AS ({FUNCTIONS}) {sql}")
        return f

    return add


#: Of each function its file and numbers, in terms of p.
FUNCTIONS = """SELECT path, n, concat('Item', n, '.run') AS qualified_name, 'run' AS name, 13 AS line_start, 14 + 2 * k AS line_end, 1 + k AS complexity, k AS cognitive, FALSE AS is_async, '' AS tags FROM p
UNION ALL SELECT path, n, loader, loader, 17 + 2 * k, 18 + 2 * k + 2 * w + 4 * h, 1 + w + h, w + h, TRUE, CASE WHEN h = 1 THEN 'io_op,network' ELSE 'io_op' END FROM p
UNION ALL SELECT path, n, 'to_do', 'to_do', 21 + 2 * k + 2 * w + 4 * h, 22 + 2 * k + 2 * w + 4 * h, 1, 0, FALSE, '' FROM p"""


def facts(spark, d, *wanted):
    return c.extract(programs(spark, d, PYTHON, "python"), *wanted)


def facts_of(spark, d, what):
    return c.exploded(facts(spark, d, what), what)


@query("p01_functions", "SELECT path, qualified_name, line_start::INT AS line_start, line_end::INT AS line_end, complexity::INT AS complexity, is_async FROM fn")
def p01(spark, d):
    return facts_of(spark, d, "functions").select("path", "qualified_name", "line_start", "line_end", "complexity", "is_async")


@query("p02_classes", "SELECT path, concat('Item', n) AS name, concat('Base', b) AS bases, 'run' AS methods, 'kind' AS fields, (14 + 2 * k)::INT AS line_end FROM p")
def p02(spark, d):
    names = F.array_join(F.transform("fields", lambda f: f["name"]), ",")
    return facts_of(spark, d, "classes").select("path", "name", F.concat_ws(",", "bases").alias("bases"), F.concat_ws(",", "methods").alias("methods"), names.alias("fields"), "line_end")


@query("p03_imports", "SELECT path AS file, 'os' AS path, NULL::VARCHAR AS alias, 2 AS line FROM p UNION ALL SELECT path, concat('lib', b), 'm', 3 FROM p UNION ALL SELECT path, concat('app.m', w, '.helper'), NULL, 4 FROM p")
def p03(spark, d):
    return facts(spark, d, "imports").select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.path", "i.alias", "i.line")


@query("p04_globals", "SELECT path, 'limit' AS name, size::VARCHAR AS value, 5 AS line FROM p UNION ALL SELECT path, 'PATH', concat('''/srv/', brand, ''''), 6 FROM p")
def p04(spark, d):
    return facts_of(spark, d, "variables").select("path", "name", "value", "line")


@query("p05_semantic_tags", "SELECT path, name, tags FROM fn")
def p05(spark, d):
    return c.semantic_tags(facts_of(spark, d, "functions")).select("path", "name", F.concat_ws(",", "tags").alias("tags"))


@query("p06_complexity", "SELECT path, (1 + k + w + h)::INT AS digest, (1 + k + w + h)::INT AS risk, (2 + k + w + h)::INT AS cst FROM p")
def p06(spark, d):
    return c.complexities(programs(spark, d, PYTHON, "python"))


@query("p07_cognitive", "SELECT path, name, cognitive::INT AS cognitive FROM fn")
def p07(spark, d):
    return facts_of(spark, d, "functions").select("path", "name", "cognitive")


@query("p08_go", "SELECT path, concat('p', w) AS package, concat('fmt,github.com/x/l', b) AS imports, concat('New', n) AS functions, concat('Item', n) AS structs, 'Source' AS interfaces FROM p")
def p08(spark, d):
    found = c.go_facts(programs(spark, d, GO, "go"))
    return found.select("path", "package", *(F.concat_ws(",", k).alias(k) for k in ("imports", "functions", "structs", "interfaces")))


def typed(spark, d, template, language, what):
    return curly.declarations(programs(spark, d, template, language), what)


def listed(*names):
    return [F.concat_ws("|", name).alias(name) for name in names]


@query("p08_go_functions", """SELECT path, 'Load' AS name, concat('Item', n) AS owner, TRUE AS pointer, TRUE AS exported, '' AS type_parameters, 'key K|more ...int' AS parameters, '(K, error)' AS returns, 15 AS line_start, (17 + 3 * k + 3 * w)::INT AS line_end FROM p
UNION ALL SELECT path, concat('make', n), NULL, FALSE, FALSE, '', '', NULL, (19 + 3 * k + 3 * w)::INT, (19 + 3 * k + 3 * w)::INT FROM p""")
def p08_functions(spark, d):
    found = curly.functions(typed(spark, d, GO_TYPED, "go", "functions"))
    return found.select("path", "name", "owner", "pointer", "exported", *listed("type_parameters", "parameters"), "returns", "line_start", "line_end")


@query("p08_go_types", """SELECT path, concat('Item', n) AS name, 'struct' AS kind, 'K' AS type_parameters, concat('Base', b) AS bases, '' AS methods, TRUE AS exported, 6 AS line_start, 9 AS line_end FROM p
UNION ALL SELECT path, 'Reader', 'interface', '', '', 'Read', TRUE, 11, 13 FROM p""")
def p08_types(spark, d):
    found = curly.types(typed(spark, d, GO_TYPED, "go", "types"))
    return found.select("path", "name", "kind", *listed("type_parameters", "bases", "methods"), "exported", "line_start", "line_end")


@query("p08_go_fields", """SELECT path, concat('Base', b) AS field, concat('Base', b) AS type, NULL AS tag, TRUE AS embedded FROM p
UNION ALL SELECT path, unnest(['A', 'B']), 'int', 'json:"a"', FALSE FROM p""")
def p08_fields(spark, d):
    fields = curly.types(typed(spark, d, GO_TYPED, "go", "types")).select("path", F.explode("fields").alias("f"))
    return fields.select("path", F.col("f.name").alias("field"), "f.type", "f.tag", "f.embedded")


@query("p06_go", "SELECT path, 'Load' AS name, (2 + 2 * k + 2 * w)::INT AS complexity FROM p UNION ALL SELECT path, concat('make', n), 1 FROM p")
def p06_go(spark, d):
    return curly.functions(typed(spark, d, GO_TYPED, "go", "functions")).select("path", "name", "complexity")


@query("p06_java", "SELECT path, concat('load', n) AS name, (2 + 2 * k + 2 * w)::INT AS complexity FROM p UNION ALL SELECT path, unnest(['Point', 'none']), 1 FROM p")
def p06_java(spark, d):
    return curly.functions(typed(spark, d, JAVA_TYPED, "java", "functions")).select("path", "name", "complexity")


@query("p11_java_methods", """SELECT path, concat('load', n) AS name, concat('Main', n) AS owner, 'R' AS type_parameters, 'final Map<String, R> in|int... more' AS parameters, 'List<R>' AS returns, 'protected' AS modifiers, 'GetMapping' AS annotations, 'IOException' AS throws, 'network' AS tags, TRUE AS exported, 7 AS line_start, (10 + k + w)::INT AS line_end FROM p
UNION ALL SELECT path, 'Point', concat('Main', n, '.Point'), '', '', NULL, '', '', '', '', FALSE, (11 + k + w)::INT, (11 + k + w)::INT FROM p
UNION ALL SELECT path, 'none', concat('Main', n), '', '', 'void', 'abstract', '', '', '', FALSE, (12 + k + w)::INT, (12 + k + w)::INT FROM p""")
def p11_methods(spark, d):
    found = curly.functions(typed(spark, d, JAVA_TYPED, "java", "functions"))
    return found.select("path", "name", "owner", *listed("type_parameters", "parameters"), "returns", *listed("modifiers", "annotations", "throws", "tags"), "exported", "line_start", "line_end")


@query("p11_java_types", """SELECT path, concat('Main', n) AS name, 'class' AS kind, 'T' AS type_parameters, concat('Base', b, '<T>|Runnable') AS bases, '' AS components, concat('load', n, '|none') AS methods, 'service' AS tags, TRUE AS exported, 4 AS line_start, (13 + k + w)::INT AS line_end FROM p
UNION ALL SELECT path, 'Point', 'record', '', '', 'int x|List<T> ys', 'Point', '', FALSE, (11 + k + w)::INT, (11 + k + w)::INT FROM p""")
def p11_types(spark, d):
    found = curly.types(typed(spark, d, JAVA_TYPED, "java", "types"))
    components = F.concat_ws("|", F.transform("fields", lambda f: F.concat_ws(" ", f["type"], f["name"]))).alias("components")
    return found.select("path", "name", "kind", *listed("type_parameters", "bases"), components, *listed("methods", "tags"), "exported", "line_start", "line_end")


@query("p10_go_fallback", "SELECT path, concat('p', w) AS package, h::BIGINT AS error_checks FROM p")
def p10(spark, d):
    return c.go_facts(programs(spark, d, GO, "go")).select("path", "package", F.col("error_checks").cast("long").alias("error_checks"))


@query("p11_java", "SELECT path, concat('a.p', b) AS package, 'java.util.List' AS imports, concat('Main', n) AS classes, concat('size', n) AS methods, 'Override' AS annotations FROM p")
def p11(spark, d):
    found = c.java_facts(programs(spark, d, JAVA, "java"))
    return found.select("path", "package", *(F.concat_ws(",", k).alias(k) for k in ("imports", "classes", "methods", "annotations")))


@query("p12_shell", "SELECT path, concat('greet', n) AS functions, concat('NAME', n) AS variables, concat('lib', b, '.sh') AS imports, 'curl,echo,grep' AS commands FROM p")
def p12(spark, d):
    return c.shell_facts(programs(spark, d, SHELL, "shell")).select("path", *(F.concat_ws(",", k).alias(k) for k in ("functions", "variables", "imports", "commands")))


@query("p17_compression", "SELECT path, 'full' AS strategy, (22 + 2 * k + 2 * w + 4 * h)::INT AS lines, FALSE AS pruned FROM p UNION ALL SELECT path, 'signature', 3, FALSE FROM p UNION ALL SELECT path, 'skeleton', 22, TRUE FROM p")
def p17(spark, d):
    own = programs(spark, d, PYTHON, "python").withColumn("strategy", F.explode(F.array(*map(F.lit, ("full", "skeleton", "signature")))))
    return c.compressed(own).select("path", "strategy", c.line_count(F.col("text")).alias("lines"), F.contains("text", F.lit("# Pruned")).alias("pruned"))


@query("a07_file_complexity", "SELECT path, max(complexity)::INT AS max_complexity, avg(complexity) AS avg_complexity, count(*) FILTER (complexity > 10) AS over FROM fn GROUP BY path")
def a07(spark, d):
    return c.file_complexity(facts_of(spark, d, "functions"))


@query("a08_semantic_metrics", "SELECT path, sum(complexity)::BIGINT AS cyclomatic, sum(cognitive)::BIGINT AS cognitive, max(complexity)::INT AS max_complexity, avg(complexity) AS avg_complexity FROM fn GROUP BY path")
def a08(spark, d):
    return c.semantic_metrics(facts_of(spark, d, "functions"))


@query("a10_module_digest", "SELECT concat('src.m', n % 100, '.part', n) AS module, 1::BIGINT AS classes, 3::BIGINT AS functions, round((3 + k + w + h) / 3::DOUBLE, 1) AS avg_complexity, (1 + k >= 10)::BIGINT AS complex FROM p")
def a10(spark, d):
    return c.module_digests(facts(spark, d, "functions", "classes"))


@query("a10_tech_stack", "SELECT DISTINCT concat('lib', b) AS name FROM p UNION SELECT 'app'")
def a10_stack(spark, d):
    own = programs(spark, d, PYTHON, "python").select(F.substring_index("path", "/", 1).alias("module")).distinct()
    return c.tech_stack(QUERIES["p03_imports"](spark, d).select("path"), own)


@query("a11_module_imports", "SELECT concat('src.m', n % 100, '.part', n) AS module, concat('app.m', w, '.helper,lib', b) AS deps FROM p")
def a11(spark, d):
    return c.module_imports(QUERIES["p03_imports"](spark, d).select("file", "path")).withColumn("deps", F.concat_ws(",", "deps"))


@query("a12_go_packages", "SELECT concat('p', w) AS package, count(*) AS files, sum(h)::BIGINT AS error_checks, string_agg(DISTINCT concat('github.com/x/l', b), ',' ORDER BY concat('github.com/x/l', b)) AS deps FROM p GROUP BY w")
def a12(spark, d):
    return c.go_packages(c.go_facts(programs(spark, d, GO, "go"))).withColumn("deps", F.concat_ws(",", "deps"))


@query("a23_java_complexity", "SELECT path, (2 + 2 * k)::INT AS complexity FROM p")
def a23(spark, d):
    return c.java_facts(programs(spark, d, JAVA, "java")).select("path", "complexity")


@query("a24_ast_summary", "SELECT path, 3 AS function_count, 1 AS class_count, 3 AS import_count, 0 AS comment_lines FROM p")
def a24(spark, d):
    return c.ast_summary(facts(spark, d, "functions", "classes", "imports", "comment_lines"))


@query("a25_go_concurrency", "SELECT path, w::INT AS goroutines, 0 AS channel_ops, h::INT AS error_checks FROM p")
def a25(spark, d):
    return c.go_facts(programs(spark, d, GO, "go")).select("path", "goroutines", "channel_ops", "error_checks")


ENDINGS = "CASE p_partkey % 6 WHEN 0 THEN '.PY' WHEN 1 THEN '.go' WHEN 2 THEN '.hh' WHEN 3 THEN '' WHEN 4 THEN '.sh' ELSE '.odd' END"


@query("s02_language", f"SELECT concat('x/f', p_partkey, {ENDINGS}) AS path, CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'cpp' WHEN 4 THEN 'shell' ELSE 'unknown' END AS language FROM {{part}}")
def s02(spark, d):
    paths = spark.read.parquet(f"{d}/part.parquet").selectExpr(f"concat('x/f', p_partkey, {ENDINGS}) AS path")
    return paths.select("path", c.language_of(F.col("path")).alias("language"))


@query("s06_shebang", f"SELECT concat('x/f', p_partkey, {ENDINGS}) AS path FROM {{part}} WHERE p_partkey % 6 = 4 OR p_partkey % 6 = 3 AND p_size % 2 = 0")
def s06(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr(f"concat('x/f', p_partkey, {ENDINGS}) AS path", "concat(CASE WHEN p_size % 2 = 0 THEN '#!/usr/bin/env bash' ELSE '# bash' END, '\\n', p_name) AS content")
    return rows.where(c.is_shell(F.col("path"), F.col("content"))).select("path")


def rule_query(name, make, sql):
    @query(name, f"SELECT path, rule_id, severity, line::INT AS line FROM ({sql})")
    def run(spark, d, make=make):
        return make(spark, d).select("path", "rule_id", "severity", "line")


rule_query("u02_high_complexity", lambda s, d: u.high_complexity(facts_of(s, d, "functions")), "SELECT path, 'high-cyclomatic-function' AS rule_id, 'warning' AS severity, line_start AS line FROM fn WHERE complexity > 10")
rule_query("u05_return_hint", lambda s, d: u.missing_return_hint(facts_of(s, d, "functions")), "SELECT path, 'missing-return-hint' AS rule_id, 'info' AS severity, line_start AS line FROM fn")
rule_query("u07_empty_handler", lambda s, d: u.empty_handler(facts(s, d, "handlers")), "SELECT path, '001' AS rule_id, 'error' AS severity, 21 + 2 * k + 2 * w AS line FROM p WHERE h = 1")
rule_query("u08_hardcoded_config", lambda s, d: u.hardcoded_config(facts(s, d, "constants")), "SELECT path, '002' AS rule_id, 'warning' AS severity, 5 AS line FROM p")
rule_query("u09_mixed_naming", lambda s, d: u.mixed_naming(facts_of(s, d, "functions")), "SELECT path, '003' AS rule_id, 'info' AS severity, 1 AS line FROM p WHERE loader <> 'fetch'")
rule_query("u10_long_function", lambda s, d: u.long_function(facts_of(s, d, "functions")), "SELECT path, '004' AS rule_id, 'warning' AS severity, line_start AS line FROM fn WHERE line_end - line_start > 50 AND NOT is_async")
rule_query("u12_hardcoded_path", lambda s, d: u.hardcoded_path(facts(s, d, "constants")), "SELECT path, '006' AS rule_id, 'warning' AS severity, 6 AS line FROM p")
rule_query("u13_print", lambda s, d: u.prints(facts(s, d, "constants")), "SELECT path, '007' AS rule_id, 'info' AS severity, 18 + 2 * k + 2 * w AS line FROM p")
rule_query("u14_broad_except", lambda s, d: u.broad_except(facts(s, d, "handlers")), "SELECT path, '008' AS rule_id, 'warning' AS severity, 21 + 2 * k + 2 * w AS line FROM p WHERE h = 1")
rule_query("u15_placeholder", lambda s, d: u.placeholder(facts_of(s, d, "functions")), "SELECT path, '009' AS rule_id, 'info' AS severity, line_start AS line FROM fn WHERE name = 'to_do'")
rule_query("u16_docstring", lambda s, d: u.missing_docstring(facts_of(s, d, "functions")), "SELECT path, '010' AS rule_id, 'info' AS severity, line_start AS line FROM fn WHERE NOT is_async")


@query("u01_rule_engine", """, found AS (SELECT path, '001' AS rule_id FROM p WHERE h = 1 UNION ALL SELECT path, '002' FROM p UNION ALL SELECT path, '003' FROM p WHERE loader <> 'fetch' UNION ALL SELECT path, '004' FROM fn WHERE line_end - line_start > 50 AND NOT is_async
UNION ALL SELECT path, '006' FROM p UNION ALL SELECT path, '007' FROM p UNION ALL SELECT path, '008' FROM p WHERE h = 1 UNION ALL SELECT path, '009' FROM p UNION ALL SELECT path, '010' FROM fn WHERE NOT is_async) SELECT path, rule_id, count(*) AS n FROM found GROUP BY path, rule_id""")
def u01(spark, d):
    own = programs(spark, d, PYTHON, "python")
    issues = u.source_issues(own, c.extract(own, "functions", "handlers", "constants"))
    return issues.groupBy("path", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("p14_patterns", "SELECT path, 'long_function' AS kind, name, 1.0::DOUBLE AS confidence FROM fn WHERE line_end - line_start > 50")
def p14(spark, d):
    return c.file_patterns(facts(spark, d, "functions", "classes"))


@query("u17_severity", "SELECT n, CASE size % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'info' ELSE 'warning' END AS severity FROM p")
def u17(spark, d):
    given = F.element_at(F.array(*map(F.lit, ("HIGH", "low", "Warning", "odd"))), (F.col("p_size") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("n"), u.plugin_severity(given).alias("severity"))


@query("u18_recomputed_summary", "SELECT kind, key, n::BIGINT AS n FROM (SELECT 'total' AS kind, NULL::VARCHAR AS key, count(*) + sum(h) AS n FROM p UNION ALL SELECT 'severity', 'error', sum(h) FROM p UNION ALL SELECT 'severity', 'info', count(*) FROM p UNION ALL SELECT 'rule', '001', sum(h) FROM p UNION ALL SELECT 'rule', '007', count(*) FROM p)")
def u18(spark, d):
    own = facts(spark, d, "handlers", "constants")
    return u.run_rules([u.empty_handler(own), u.prints(own)])[1]


@query("k16_export", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, count(props) AS props FROM {events} GROUP BY event_type")
def k16(spark, d):
    path = scratch(spark, "export")
    writers.export(spark.read.parquet(f"{d}/events.parquet"), path, "event_type")
    back = spark.read.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").json(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count("props").alias("props"))


def r15_tokens(spark, d):
    """The context window by real token counts; a tokenizer is beyond SQL, so a test counts by hand."""
    import public_tokenizers

    from ashlar.functions.tokens import token_count

    turns = spark.read.parquet(f"{d}/conversations.parquet").where("text IS NOT NULL")
    cost = token_count(public_tokenizers.path("byte_bpe_50k.json"))
    return t.context_window(turns.select(F.concat(F.lit("c"), "conv_id").alias("project"), F.col("turn").alias("ord"), "text", cost("text").alias("cost")), 300)


QUERIES["r15_token_window"] = r15_tokens


class Outline:
    """What a Python source defines; what => 'functions' names them, 'counts' counts them."""

    def schema(self, what: str = "functions") -> str:
        return "path string, name string, line int" if what == "functions" else "path string, functions int, classes int"

    def analyze(self, path, rows, what="functions"):
        for row in rows:
            facts = c.python_facts(row["content"] or "", ("functions",) if what == "functions" else ("functions", "classes"))
            if what == "functions":
                yield from ((path, f["name"], f["line_start"]) for f in facts["functions"])
            else:
                yield path, len(facts["functions"]), len(facts["classes"])


@query("e06_semantic_analyzer", "SELECT path, name, line_start AS line FROM fn")
def e06(spark, d):
    plugins.as_file_function(spark, "outline", Outline())
    return spark.sql("SELECT * FROM outline(TABLE({files}), what => 'functions')", files=programs(spark, d, PYTHON, "python").select("path", "content"))


@query("e06_analyzer_schema", "SELECT path, 3 AS functions, 1 AS classes FROM p")
def e06_schema(spark, d):
    plugins.as_file_function(spark, "outline", Outline())
    return spark.sql("SELECT * FROM outline(TABLE({files}), what => 'counts')", files=programs(spark, d, PYTHON, "python").select("path", "content"))


def hubs(rows, least=10):
    """The most complex function of a file, where its complexity is least or more and over half the file's."""
    total, (most, name) = sum(r["complexity"] for r in rows), max((r["complexity"], r["name"]) for r in rows)
    return [(name, most / total)] if most >= least and 2 * most > total else []


@query("e07_pattern_rule", "SELECT path, 'hub' AS kind, 'run' AS subject, (1e0 + k) / (3 + k + w + h) AS confidence, 3 AS facts FROM p WHERE 1 + k >= 6 AND 2 * (1 + k) > 3 + k + w + h")
def e07(spark, d):
    plugins.as_file_function(spark, "hub", plugins.PatternRule("hub", hubs))
    return spark.sql("SELECT * FROM hub(TABLE({functions}), explain => true, least => 6)", functions=facts_of(spark, d, "functions").select("path", "name", "complexity"))
