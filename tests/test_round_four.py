"""Spreading of small rows with heavy work, one pass over sources, and what else a reviewer found in this round."""

import pytest
from pyspark.sql import functions as F

from ashlar import catalog
from ashlar.catalog import analytics, programs
from ashlar.operators import content as c
from ashlar.operators import curly
from ashlar.operators import rules as u
from ashlar.operators.graph import reach
from ashlar.plans.common import spread
from tests.oracle import DATA

SOURCE = '''import os
limit = 3


@register(a or b)
def outer(x=[i for i in y if i]):
    """Doc."""
    with open("/tmp/x") as f, lock:
        if x and f or y:
            def inner_one():
                print(x)
    try:
        go.run(outer(1))
    except (KeyError, OSError):
        raise
    except Exception:
        pass
    return 1


class K(Base, pkg.Other):
    kind: str = "k"

    async def camelCase(self):
        pass


match limit:
    case 3:
        def from_case():
            return None
'''


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a/m.py", "python", SOURCE), ("a/bad.py", "python", "def ("), ("a/none.py", "python", None), ("a/x.go", "go", "// TODO\npackage x"), ("a/t.py", "python", "# TODO\nx = 'C:\\\\d'\n")]
    return spark.createDataFrame(rows, "path string, language string, content string")


def test_heavy_rows_are_spread_over_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    own = programs.programs(spark, DATA, programs.PYTHON, "python")
    used = own.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > cores // 2  # one row group, so one task before
    assert spread(spark.range(12001), "id").rdd.getNumPartitions() == max(cores, 3)


def test_functions_from_one_walk():
    by = {f["name"]: f for f in c.python_facts(SOURCE, ("functions",))["functions"]}
    assert list(by) == ["outer", "inner_one", "camelCase", "from_case"]
    assert (by["outer"]["complexity"], by["outer"]["cognitive"], by["outer"]["calls"]) == (7, 7, ["register", "open", "run", "outer", "print"])
    assert by["inner_one"]["qualified_name"] == "outer.inner_one" and by["camelCase"]["is_method"]


def test_wanted_facts_are_those_of_all(spark, files):
    every = {r.path: r.asDict(True) for r in c.extract(files).collect()}
    assert len(every) == 4 and not every["a/bad.py"]["parsed"]
    for names in (("functions",), ("imports", "handlers"), ("constants", "comment_lines"), ("classes", "variables", "complexity")):
        found = c.extract(files, *names)
        assert found.columns == [n for n in c.extract(files).columns if n in (*names, "path", "parsed")]
        assert all(every[r.path][k] == v for r in found.collect() for k, v in r.asDict(True).items())


def test_issues_of_one_pass_are_those_of_ten_rules(spark, files):
    facts = c.extract(files)
    one, ten = u.source_issues(files, facts), u.run_rules(u.source_rules(files, facts))[0]
    assert one.columns == ten.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, ten.collect()))
    assert {r.rule_id for r in one.collect()} >= {"001", "002", "003", "005", "006", "007", "008", "009", "010"}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_digests_and_patterns_of_one_pass(spark, files):
    facts = c.extract(files, "functions", "classes")
    functions, classes = c.exploded(facts, "functions"), c.exploded(facts, "classes")
    python = files.where("language = 'python'")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(c.module_digests(facts, 3)) == rows(c.module_digest(functions, classes, python, 3))
    assert rows(c.file_patterns(facts)) == rows(c.patterns(functions, classes))


def test_dual_quota_of_the_tables(spark):
    """More rounds than one over tables whose columns can't be null: union of two copies of one checkpoint failed before."""
    folder = "/root/testdata/sf0.01"
    tasks = analytics.all_tasks(spark, folder).select("id", "project", "path", "rule_id", "priority", "ord").collect()
    files, rules, expected = {}, {}, set()
    for r in sorted(tasks, key=lambda r: (r.project, r.priority, r.ord)):
        if files.get((r.project, r.path), 0) < 3 and rules.get((r.project, r.rule_id), 0) < 20:
            files[r.project, r.path] = files.get((r.project, r.path), 0) + 1
            rules[r.project, r.rule_id] = rules.get((r.project, r.rule_id), 0) + 1
            expected.add(r.id)
    assert {r.id for r in catalog.QUERIES["w05_dual_quota"](spark, folder).collect()} == expected


def test_declarations_of_one_kind(spark):
    rows = [("a.go", "go", "package p\nfunc F() { x := `\n` }\nfunc (t *T) G(a, b int) error { if a && b { return nil } }\ntype T struct {\n\tB\n}"), ("b.java", "java", "class K {\n  void m() { x = a ? b : c; } }"), ("c.go", "go", None)]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    every = {r.path: r.asDict(True) for r in curly.declarations(files).collect()}
    assert [(f["name"], f["complexity"], f["line_start"], f["line_end"]) for f in every["a.go"]["functions"]] == [("F", 1, 2, 3), ("G", 4, 4, 4)]
    assert every["b.java"]["functions"][0]["complexity"] == 2
    for what in ("functions", "types"):
        found = curly.declarations(files, what)
        assert found.columns == ["path", "language", what]
        assert {r.path: r.asDict(True)[what] for r in found.collect()} == {path: row[what] for path, row in every.items()}


def test_edges_are_made_once_for_all_rounds(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.range(0, 12, 1, 1).selectExpr("id AS source", "id + 1 AS target").mapInArrow(count, "source long, target long")
    found = reach(edges, spark.range(1))
    assert {(r.id, r.depth) for r in found.collect()} == {(n, n) for n in range(13)}
    assert made.value == 12  # 12 a round before
