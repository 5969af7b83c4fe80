"""Goldens, and small models in plain Python."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ashlar.operators import content as c
from ashlar.operators import dependencies as deps
from ashlar.operators import graph as g
from ashlar.operators import history as h
from ashlar.operators import policy as y
from ashlar.operators import risk as k
from ashlar.operators import rules as u
from ashlar.operators import tasks as t
from ashlar.schema import exact_round, split_lines


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def scores(df):
    return {r.path: r.score for r in df.collect()}


def test_propagation_chain_and_cycle(spark):
    chain = k.propagate(table(spark, [("A", "B"), ("B", "C")], "src string, dst string"), table(spark, [("A", 0.0), ("B", 0.0), ("C", 100.0)], "path string, score double"), 0.5, 5)
    assert scores(chain) == {"A": 25.0, "B": 50.0, "C": 100.0}
    cycle = k.propagate(table(spark, [("A", "B"), ("B", "A")], "src string, dst string"), table(spark, [("A", 10.0), ("B", 10.0)], "path string, score double"), 0.1, 10)
    assert all(abs(v - 11.11) < 0.1 for v in scores(cycle).values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 6)), max_size=10), st.lists(st.floats(0, 1), min_size=6, max_size=6))
def test_propagation_model(spark, edges, base):
    deps_ = table(spark, [(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string")
    found = scores(k.propagate(deps_, table(spark, [(f"n{i}", x) for i, x in enumerate(base)], "path string, score double"), 0.3, 4))
    now = list(base)
    for _ in range(4):
        step = [base[i] + sum(0.3 * now[b] for a, b in edges if a == i and b < 6) for i in range(6)]
        step = [x if abs(x - z) > 0.01 else z for x, z in zip(step, now)]
        if step == now:
            break
        now = step
    assert all(abs(found[f"n{i}"] - now[i]) < 1e-6 for i in range(6))


def test_weighted_risk(spark):
    schema = "path string, lines_of_code int, max_complexity int, avg_complexity double, fan_out int, churn double, coverage double, authors int"
    rows = {r.path: r for r in k.weighted_risk(table(spark, [("a", 50, 5, 2.0, 2, 0.0, None, 0), ("b", 1500, 15, 8.0, 25, 0.0, None, 0)], schema), reported=False).collect()}
    assert rows["a"].level == "low" and "low_risk" in rows["a"].factors
    assert {"high_complexity", "high_fan_out", "large_file"} <= set(rows["b"].factors) and rows["b"].score == 0.75 and rows["b"].level == "high"


def test_history_diff(spark):
    file, issue = "path string, score double, level string", "path string, id string, severity string"
    old = table(spark, [("a", 0.2, "low"), ("b", 0.8, "high"), ("c", 0.5, "medium")], file)
    new = table(spark, [("a", 0.9, "high"), ("b", 0.1, "low"), ("d", 0.6, "medium")], file)
    none = table(spark, [], issue)
    assert h.project_diff(old, new, none, none).first().high_delta == 0
    assert {r.path: r.status for r in h.file_diff(old, new, none, none).collect()} == {"a": "modified", "b": "modified", "c": "removed", "d": "added"}
    row = h.file_diff(old, old, table(spark, [("a", "123", "error")], issue), table(spark, [("a", "456", "error")], issue)).where("path = 'a'").first()
    assert (row.status, row.added, row.resolved) == ("modified", 1, 1)


def test_structural_diff(spark):
    s = "path string, hash string, cyclomatic int"
    rows = h.structural_diff(table(spark, [("a", "1", 15)], s), table(spark, [("a", "2", 18), ("b", "3", 1)], s)).collect()
    assert {(r.path, r.status, r.cyclomatic_delta) for r in rows} == {("a", "modified", 3), ("b", "added", None)}


def test_dual_quota_model(spark):
    rng = random.Random(7)
    rows = [(i, f"p{rng.randint(0, 2)}", f"f{rng.randint(0, 5)}", f"r{rng.randint(0, 3)}", rng.randint(1, 5), i) for i in range(400)]
    found = {r.id for r in t.within_quotas(table(spark, rows, "id int, project string, path string, rule_id string, priority int, ord int"), 4, 12).collect()}
    files, rules, wanted = Counter(), Counter(), set()
    for i, project, path, rule, _, _ in sorted(rows, key=lambda r: (r[1], r[4], r[5])):
        if files[project, path] < 4 and rules[project, rule] < 12:
            files[project, path] += 1
            rules[project, rule] += 1
            wanted.add(i)
    assert found == wanted


def test_budget_skips_and_continues(spark):
    rows = [("p", "a", 0.9, 0, 1, 10, 100), ("p", "b", 0.8, 1, 1, 5, 6), ("p", "c", 0.1, 2, 1, 2, 3)]
    found = {r.path: r.strategy for r in t.budget_allocation(table(spark, rows, "project string, path string, score double, ord int, signature_cost int, skeleton_cost int, full_cost int"), 10).collect()}
    assert found == {"a": "signature", "b": "full", "c": "full"}


def test_context_window_ends_at_first_overflow(spark):
    rows = [("p", 0, "x" * 40, 10), ("p", 1, "y" * 400, 100), ("p", 2, "z", 1)]
    found = t.context_window(table(spark, rows, "project string, ord int, text string, cost long"), 80).orderBy("ord").collect()
    assert [(r.ord, len(r.text), r.whole) for r in found] == [(0, 40, True), (1, 210, False)]


def test_graph_delta_round_trip(spark):
    n, e = "id string, type string, complexity int", "source string, target string, type string"
    old = g.Graph(table(spark, [("a", "function", 1), ("b", "function", 2), ("c", "function", 3)], n), table(spark, [("a", "b", "calls"), ("b", "c", "calls")], e))
    new = g.Graph(table(spark, [("a", "function", 9), ("b", "function", 2), ("d", "function", 4)], n), table(spark, [("a", "b", "calls"), ("b", "d", "calls")], e))
    delta = g.diff(old, new)
    assert {(r.op, r.n) for r in g.delta_summary(delta).collect()} == {("update_node", 1), ("delete_node", 1), ("add_node", 1), ("add_edge", 1), ("delete_edge", 1)}
    back = g.apply_delta(old, delta, new)
    assert set(back.nodes.collect()) == set(new.nodes.collect()) and set(back.edges.collect()) == set(new.edges.collect())
    assert not g.has_changes(g.diff(new, new))


def test_cycles_and_layers(spark):
    edges = table(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("x", "a"), ("y", "y")], "source string, target string")
    assert sorted(map(tuple, (r.cycle for r in deps.cycles(edges, 3).collect()))) == [("a", "b"), ("a", "b", "c"), ("y",)]
    assert deps.longest_path(edges).first().depth == 0
    assert deps.longest_path(table(spark, [("a", "b"), ("b", "c"), ("a", "c")], "source string, target string")).first().depth == 3
    with pytest.raises(ValueError):
        deps.task_layers(table(spark, [("a", 1), ("b", 1)], "id string, priority int"), table(spark, [("a", "b"), ("b", "a")], "id string, on string"))


def test_split_lines(spark):
    texts = ["", "a", "a\n", "a\nb\n", "a\r\nb\rc\x0bd", "\n", "x y\x85z", "a\n\nb"]
    found = table(spark, [(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", split_lines(F.col("x")).alias("lines")).orderBy("i").collect()
    assert [list(r.lines) for r in found] == [x.splitlines() for x in texts]


def test_exact_round(spark):
    values = [0.125, 2.675, 1.005, -0.125, 0.375]
    assert [r[0] for r in table(spark, [(x,) for x in values], "x double").select(exact_round(F.col("x"))).collect()] == [round(x, 2) for x in values]


def test_org_health(spark):
    rows = [(f"proj{i}", 1, i, False, 0.5, 0.15) for i in (1, 2)]
    found = k.by_health(k.health(table(spark, rows, "project string, high_risk_files int, errors int, regressed boolean, completion double, avg_risk double"))).collect()
    assert [(r.project, r.health) for r in found] == [("proj2", 102.8), ("proj1", 102.9)]


def test_policies(spark):
    context = table(spark, [(1, True, ["python"])], "high_risk_files int, has_regression boolean, languages array<string>")
    rules = y.policy_set({"rules": [{"id": "a", "conditions": [{"field": "high_risk_files", "op": ">", "value": 0}]}, {"id": "b", "conditions": [{"field": "has_regression", "op": "==", "value": True}], "actions": ["suggest_block_ci"]}, {"id": "c", "conditions": [{"field": "languages", "op": "in", "value": ["python", "go"]}]}, {"id": "d", "conditions": [{"field": "risk_level", "op": "!=", "value": 1}]}]})
    assert {(r.rule, r.severity) for r in y.decisions(context, rules).collect()} == {("a", "warning"), ("b", "error"), ("c", "warning")}


def test_handlers_that_log_or_raise():
    facts = c.python_facts("try:\n    x()\nexcept Exception:\n    log.error('x')\ntry:\n    x()\nexcept:\n    raise\n")
    assert [(f["kind"], f["raises"], f["only_pass"]) for f in facts["handlers"]] == [("Exception", False, False), (None, True, False)]
    assert c.python_facts("def (")["parsed"] is False


def test_empty_tables(spark):
    empty = table(spark, [], "path string, language string, content string")
    facts = c.extract(empty)
    assert u.run_rules(u.source_rules(empty, facts))[0].count() == 0
    assert g.reach(table(spark, [], "source string, target string"), table(spark, [("a",)], "id string")).count() == 1
