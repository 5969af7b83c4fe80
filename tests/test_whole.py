"""Domain tables hold all rows of the driver's tables: queries against plain Python that reads the tables itself."""

import json
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
import yaml
from pyspark.sql import functions as F

from ashlar import catalog
from ashlar.sources import writers
from ashlar.views import view
from tests.oracle import DATA


def calls():
    """Consecutive lines of an order as (part, part), repeated as often as they come."""
    parts = defaultdict(list)
    rows = pq.read_table(f"{DATA}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey"]).to_pylist()
    for r in rows:
        parts[r["l_orderkey"], r["l_linenumber"]].append(r["l_partkey"])
    return [(r["l_partkey"], t) for r in rows for t in parts.get((r["l_orderkey"], r["l_linenumber"] + 1), ())]


@pytest.fixture(scope="module")
def after():
    """Calls to a greater part, by caller."""
    found = defaultdict(set)
    for s, t in calls():
        if s < t:
            found[s].add(t)
    return found


def depths(after):
    """Nodes on the longest path from each."""
    found = {}
    for s in sorted(set(after) | {t for ts in after.values() for t in ts}, reverse=True):
        found[s] = 1 + max((found[t] for t in after.get(s, ())), default=0)
    return found


def test_calls_dag_holds_all_lines(spark, after):
    edges = [(r.source, r.target) for r in view(spark, DATA, "v_calls_dag").collect()]
    assert sorted(edges) == sorted((s, t) for s, ts in after.items() for t in ts)


def test_paths(spark, after):
    longest = depths(after)
    assert catalog.QUERIES["g25_longest_path"](spark, DATA).first().depth == max(longest.values())
    assert catalog.QUERIES["g26_call_depth"](spark, DATA).first().depth == longest[min(after)]


def test_layers(spark, after):
    layer = defaultdict(int)
    for s in sorted(after):
        for t in after[s]:
            layer[t] = max(layer[t], layer[s] + 1)
    assert {r.id: r.layer for r in catalog.QUERIES["g30_layers"](spark, DATA).collect()} == {i: layer[i] for i in pq.read_table(f"{DATA}/part.parquet")["p_partkey"].to_pylist()}


def test_skipped(spark, after):
    failed = {i for i in pq.read_table(f"{DATA}/part.parquet")["p_partkey"].to_pylist() if i % 50 == 1}
    seen, todo = set(failed), list(failed)
    while todo:
        new = after.get(todo.pop(), set()) - seen
        seen |= new
        todo += new
    assert sorted(r.id for r in catalog.QUERIES["g31_skipped"](spark, DATA).collect()) == sorted(seen - failed)


def test_deps_are_all_calls(spark):
    pairs = calls()
    assert sorted((r.src, r.dst) for r in view(spark, DATA, "v_deps").collect()) == sorted(pairs)
    parts = {s for s, _ in pairs} | {t for _, t in pairs}
    fan = {r.path: (r.fan_out, r.fan_in) for r in catalog.QUERIES["g29_fan"](spark, DATA).collect()}
    assert fan == {p: (sum(s == p for s, _ in set(pairs)), sum(t == p for _, t in set(pairs))) for p in parts}
    old, new = ({p for p in pairs if p[end] % 2 == 0} for end in (0, 1))
    expected = [("added", *p) for p in new - old] + [("removed", *p) for p in old - new]
    assert sorted(tuple(r) for r in catalog.QUERIES["d04_dependency_diff"](spark, DATA).select("op", "src", "dst").collect()) == sorted(expected)


def test_propagation_over_all_dependencies(spark):
    own = {r["p_partkey"]: min(r["p_size"] / 50, 1.0) for r in pq.read_table(f"{DATA}/part.parquet", columns=["p_partkey", "p_size"]).to_pylist()}
    score = dict(own)
    for _ in range(5):
        gain = defaultdict(float)
        for s, t in calls():
            gain[s] += 0.2 * score[t]
        score = {p: own[p] + gain[p] if abs(own[p] + gain[p] - score[p]) > 0.01 else score[p] for p in own}
    found = {r.path: r.score for r in catalog.QUERIES["r07_propagation"](spark, DATA).collect()}
    assert found == pytest.approx(score, abs=1e-4)
    levels = {p: next(level for least, level in ((0.9, "critical"), (0.7, "high"), (0.4, "medium"), (-1, "low")) if min(1.0, x) >= least) for p, x in score.items()}
    relabelled = {r.path: (r.level, r.risen) for r in catalog.QUERIES["r08_relabel"](spark, DATA).collect()}
    assert relabelled == {p: (levels[p], min(1.0, round(x, 4)) > own[p] + 0.05) for p, x in score.items()}


def test_every_event_is_in_one_snapshot(spark):
    rows = pq.read_table(f"{DATA}/events.parquet").to_pylist()
    old, new = ([r for r in rows if (r["ts"].replace(tzinfo=None).isoformat() < "2024-01-16") == first] for first in (True, False))
    for name, part in (("old", old), ("new", new)):
        top = defaultdict(float)
        for r in part:
            top[f"u{r['user_id']}"] = max(top[f"u{r['user_id']}"], r["value"])
        assert {r.path: r.top for r in view(spark, DATA, f"v_raw_{name}").collect()} == {u: int(x) for u, x in top.items()}
        issues = {(f"u{r['user_id']}", f"{r['event_type']}{r['user_id'] % 4}") for r in part}
        assert {(r.path, r.id) for r in view(spark, DATA, f"v_{name}_issues").collect()} == issues


def test_snapshots_of_a_small_table(spark, tmp_path):
    """Users only before, only after and on both sides of the split; no event between 4 and 26 January is left out."""
    events = [(1, "2024-01-10", 1, "error", 95.0), (2, "2024-01-15 23:59:59", 2, "click", 10.0), (3, "2024-01-16", 2, "click", 10.0), (4, "2024-01-20", 3, "error", 75.0), (5, "2024-01-12", 4, "view", 20.0), (6, "2024-01-25", 4, "error", 80.0)]
    rows = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    files = {r.path: (r.status, r.score_delta, r.added, r.resolved) for r in catalog.QUERIES["d02_file_diff"](spark, d).collect()}
    assert files == {"u1": ("removed", -0.95, 0, 1), "u2": ("unchanged", 0.0, 0, 0), "u3": ("added", 0.75, 1, 0), "u4": ("modified", 0.6, 1, 1)}
    assert {(r.path, r.status) for r in catalog.QUERIES["d03_structural_diff"](spark, d).collect()} == {("u1", "removed"), ("u3", "added"), ("u4", "modified")}
    assert catalog.QUERIES["d01_project_diff"](spark, d).first().asDict() == {"high_delta": 2, "issues_delta": 0, "errors_delta": 1}
    assert {(r.kind, r.delta) for r in catalog.QUERIES["d08_regressions"](spark, d).collect()} == {("error_issues", 1), ("high_risk_files", 2)}


def test_line_count_of_every_text(spark, tmp_path):
    texts = [None, "", "\n", "a", "a\nb\n", "a\r\nb\r\nc", "a\rb", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed\n", "a\x85b", "a b c"]
    rows = [(i, text, "en", "s", len(text or "")) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.path: r.lines for r in catalog.QUERIES["line_count"](spark, str(tmp_path)).collect()}
    assert found == {f"doc/{i}": len((text or "").splitlines()) for i, text in enumerate(texts)}


def test_scores_on_a_threshold(spark, tmp_path):
    expected, rows = {}, []
    for size in range(1, 51):
        c = min((0.5 * min(size % 25, 20) / 2 + 0.3 * min(size % 25 / 2, 10) + 0.2 * min(size, 20) / 2) / 10, 1)
        coverage = 1.0 if size % 5 == 0 else (1 - size % 10 / 10) * 10 / 10
        rest = 0.3 * c + 0.25 * min(size % 11 / 10, 1) + 0.25 * coverage + 0.1 * min(size % 8 / 5, 1)
        for limit in (0.4, 0.7):
            loc = round((limit - rest) * 10_000)
            if c <= 0.7 and 0 <= loc <= 1000 and abs(rest + 0.1 * loc / 1000 - limit) < 1e-9:
                expected[f"file:{len(rows)}"] = limit
                rows.append((len(rows), "n", "b", "t", size, float(loc)))
    assert set(expected.values()) == {0.4, 0.7}
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    scored = {r.path: r for r in catalog.QUERIES["r04_weighted_risk"](spark, str(tmp_path)).collect()}
    assert {path: r.score for path, r in scored.items()} == expected
    factors = {r.path: r.factors for r in catalog.QUERIES["r05_factors"](spark, str(tmp_path)).collect()}
    assert {path: "low_risk" in x for path, x in factors.items()} == {path: r.level == "low" for path, r in scored.items()}


def test_documents_of_more_rows_than_their_bound(spark, tmp_path):
    rows = spark.range(1200).select(F.concat(F.lit("f: "), "id").alias("path"), (F.col("id") / 1200).alias("score"), F.when(F.col("id") % 2 == 0, F.array(F.col("id"))).alias("lines"), F.create_map(F.lit("a"), F.col("id")).alias("tags"))
    report = rows.agg(F.count(F.lit(1)).alias("total_files"))
    with pytest.raises(ValueError, match="yaml_items"):
        writers.yaml_document(rows)
    with pytest.raises(ValueError, match="write_report"):
        writers.report_json(report, rows)
    few = rows.where("id < 1000")
    assert len(yaml.safe_load(writers.yaml_document(few))) == len(json.loads(writers.report_json(report, few))["files"]) == 1000
    expected = {f"f: {i}": {"path": f"f: {i}", "score": i / 1200, **({"lines": [i]} if i % 2 == 0 else {}), "tags": {"a": i}} for i in range(1200)}
    writers.yaml_items(rows).write.text(f"{tmp_path}/yaml")
    found = yaml.safe_load("\n".join(r.value for r in spark.read.text(f"{tmp_path}/yaml", wholetext=True).collect()))
    assert {r["path"]: r for r in found} == expected and len(found) == 1200
    writers.write_report(report, rows, f"{tmp_path}/report")
    files = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/report/what=files").collect()]
    assert {r["path"]: r for r in files} == expected and len(files) == 1200
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/report/what=project_summary").collect()] == [{"total_files": 1200}]
