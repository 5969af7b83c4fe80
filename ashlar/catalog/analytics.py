"""Queries of reports, risk, history, tasks, policies and organisation roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.operators import history as h
from ashlar.operators import policy as y
from ashlar.operators import report as r
from ashlar.operators import risk as k
from ashlar.operators import tasks as t
from ashlar.plans.common import scratch
from ashlar.sources import writers
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


def both(spark, d):
    return view(spark, d, "v_files"), view(spark, d, "v_issues")


@query("a01_issue_summary", "SELECT 'total' AS kind, NULL AS key, count(*) AS n FROM v_issues UNION ALL SELECT 'severity', severity, count(*) FROM v_issues GROUP BY severity UNION ALL SELECT 'rule', rule_id, count(*) FROM v_issues GROUP BY rule_id")
def a01(spark, d):
    return r.issue_summary(view(spark, d, "v_issues"))


PER_FILE = """WITH c AS (SELECT path, rule_id, count(*) AS n, min(ord) AS first FROM v_issues GROUP BY path, rule_id),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first) AS rank FROM c),
top AS (SELECT path, string_agg(rule_id, ',' ORDER BY rank) AS top_rules FROM k WHERE rank <= 3 GROUP BY path),
s AS (SELECT path, count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM v_issues GROUP BY path) """


@query("a02_file_issue_counts", PER_FILE + "SELECT path, total, errors, warnings, top_rules FROM s JOIN top USING (path)")
def a02(spark, d):
    return r.file_issue_counts(view(spark, d, "v_issues")).withColumn("top_rules", F.concat_ws(",", "top_rules"))


@query("r01_project_report", """SELECT total_files, high_risk_files, medium_risk_files, total_files - high_risk_files - medium_risk_files AS low_risk_files, languages, total_issues, error_issues, warning_issues, info_issues FROM
(SELECT count(*) AS total_files, count(*) FILTER (level = 'high') AS high_risk_files, count(*) FILTER (level = 'medium') AS medium_risk_files, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM v_files),
(SELECT count(*) AS total_issues, count(*) FILTER (severity = 'error') AS error_issues, count(*) FILTER (severity = 'warning') AS warning_issues, count(*) FILTER (severity = 'info') AS info_issues FROM v_issues)""")
def r01(spark, d):
    return r.project_report(*both(spark, d)).withColumn("languages", F.concat_ws(",", "languages"))


@query("r02_file_rows", PER_FILE + "SELECT f.path, language, score, level, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(top_rules, '') AS top_rules FROM v_files f LEFT JOIN s ON s.path = f.path LEFT JOIN top ON top.path = f.path")
def r02(spark, d):
    return r.file_rows(*both(spark, d)).withColumn("top_rules", F.concat_ws(",", "top_rules"))


@query("r01_files_per_language", "SELECT language, count(*) AS n FROM v_files GROUP BY language")
def r01_languages(spark, d):
    return r.files_per_language(view(spark, d, "v_files"))


@query("a03_risk_summary", "SELECT round(avg(score), 6) AS avg_risk, count(*) FILTER (level IN ('high', 'critical')) AS high_risk_files, count(*) FILTER (level = 'medium') AS medium_risk_files, count(*) FILTER (level = 'low') AS low_risk_files FROM v_files")
def a03(spark, d):
    return r.risk_summary(view(spark, d, "v_files")).withColumn("avg_risk", F.round("avg_risk", 6))


@query("a04_merged_summary", "SELECT count(*) AS file_count, round(avg(score), 6) AS avg_risk, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low FROM v_files")
def a04(spark, d):
    each = view(spark, d, "v_files").groupBy("language").agg(F.count(F.lit(1)).alias("file_count"), F.avg("score").alias("avg_risk"), *(F.count_if(F.col("level") == x).alias(x) for x in ("high", "medium", "low")))
    return r.merged_summary(each).withColumn("avg_risk", F.round("avg_risk", 6))


@query("a05_base_metrics", "SELECT sum(loc)::BIGINT AS total_lines, count(*) AS files, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM v_files")
def a05(spark, d):
    return r.base_metrics(view(spark, d, "v_files")).withColumn("languages", F.concat_ws(",", "languages"))


@query("a06_pattern_counts", "SELECT level, count(*) AS n FROM v_files GROUP BY level")
def a06(spark, d):
    return r.tally(view(spark, d, "v_files"), "level")


@query("w01_top_files", "SELECT path, score, ord FROM v_files ORDER BY score DESC, ord LIMIT 10")
def w01(spark, d):
    return r.top_files(view(spark, d, "v_files")).select("path", "score", "ord")


@query("w02_top_rules", "SELECT rule_id, n, rank FROM (SELECT rule_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(ord)) AS rank FROM v_issues GROUP BY rule_id) WHERE rank <= 10")
def w02(spark, d):
    return r.ranked_rules(view(spark, d, "v_issues"), [], 10)


@query("w03_report_table", "SELECT path, score, ord FROM v_files ORDER BY score DESC, ord LIMIT 20")
def w03(spark, d):
    return r.top_files(view(spark, d, "v_files"), 20).select("path", "score", "ord")


@query("w12_complex_functions", "SELECT id, complexity FROM v_function ORDER BY complexity DESC, id LIMIT 10")
def w12(spark, d):
    return view(spark, d, "v_function").orderBy(F.col("complexity").desc(), "id").limit(10).select("id", "complexity")


@query("w13_dashboard", "SELECT regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g') AS src, regexp_replace(target, '[^A-Za-z0-9_]', '_', 'g') AS dst FROM v_calls ORDER BY source, target LIMIT 20")
def w13(spark, d):
    edges = view(spark, d, "v_calls").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return r.dashboard_slice(edges, view(spark, d, "v_files"))


@query("w15_first_issues", "SELECT id, path, severity FROM v_issues WHERE severity IN ('error', 'warning') ORDER BY ord LIMIT 10")
def w15(spark, d):
    return r.first_issues(view(spark, d, "v_issues")).select("id", "path", "severity")


@query("d09_union_of_files", "SELECT path, language FROM v_files WHERE language IN ('BUILDING', 'MACHINERY') UNION ALL SELECT path, language FROM v_files WHERE language = 'BUILDING'")
def d09(spark, d):
    files = view(spark, d, "v_files").select("path", "language")
    return r.merge_snapshots([files.where(F.col("language") == x) for x in ("BUILDING", "MACHINERY", "BUILDING")])


@query("d10_distinct_dependencies", "SELECT DISTINCT concat('class:', c_nationkey) AS name FROM {customer}")
def d10(spark, d):
    files = view(spark, d, "v_imports").groupBy("source").agg(F.collect_list("target").alias("deps"))
    return r.distinct_dependencies(files)


# Risk

STATIC = "(0.5e0 * least(CAST(max_complexity AS DOUBLE), 20e0) / 2e0 + 0.3e0 * least(CAST(avg_complexity AS DOUBLE), 10e0) + 0.2e0 * least(CAST(fan_out AS DOUBLE), 20e0) / 2e0)"


@query("r03_static_score", f"SELECT path, round({STATIC}, 6) AS score FROM v_metrics")
def r03(spark, d):
    return view(spark, d, "v_metrics").select("path", F.round(k.static_score(F.col("max_complexity"), F.col("avg_complexity"), F.col("fan_out")), 6).alias("score"))


NORMS = f"""WITH n AS (SELECT *, least({STATIC} / 10e0, 1e0) AS c, least(churn / 10e0, 1e0) AS ch, least(coalesce((1e0 - coverage) * 10e0, 10e0) / 10e0, 1e0) AS co, least(authors / 5e0, 1e0) AS au, least(lines_of_code / 1000e0, 1e0) AS sz FROM v_metrics),
s AS (SELECT *, CASE WHEN c > 0.7e0 THEN greatest(0.3e0 * c + 0.25e0 * ch + 0.25e0 * co + 0.1e0 * au + 0.1e0 * sz, 0.75e0) ELSE 0.3e0 * c + 0.25e0 * ch + 0.25e0 * co + 0.1e0 * au + 0.1e0 * sz END AS full_score FROM n) """


@query("r04_weighted_risk", NORMS + "SELECT path, round(full_score, 4) AS score, CASE WHEN full_score >= 0.7 THEN 'high' WHEN full_score >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM s WHERE abs(full_score - 0.7) > 1e-9 AND abs(full_score - 0.4) > 1e-9")
def r04(spark, d):
    return with_full_score(spark, d).select("path", F.round("full", 4).alias("score"), "level")


def with_full_score(spark, d):
    """Scored files with the score before rounding. The SQL leaves out scores on a threshold, where engines may differ; the given tables have none."""
    static = k.static_score(F.col("max_complexity"), F.col("avg_complexity"), F.col("fan_out"))
    norms = {"complexity": static / 10.0, "churn": F.col("churn") / 10.0, "coverage": F.coalesce((1.0 - F.col("coverage")) * 10.0, F.lit(10.0)) / 10.0, "authors": F.col("authors") / 5.0, "size": F.col("lines_of_code") / 1000.0}
    total = sum(F.lit(w) * F.least(norms[n], F.lit(1.0)) for n, w in k.WEIGHTS.items())
    full = F.when(norms["complexity"] > k.LIFT_FROM, F.greatest(total, F.lit(k.LIFT_TO))).otherwise(total)
    return k.weighted_risk(view(spark, d, "v_metrics")).withColumn("full", full)


@query("r05_factors", NORMS + """SELECT path, concat_ws(',', CASE WHEN round(c * 10, 2) > 6 THEN 'high_complexity,high_cyclomatic_complexity' END, CASE WHEN fan_out > 20 THEN 'high_fan_out' END, CASE WHEN round(ch * 10, 2) > 6 THEN 'high_churn' END,
CASE WHEN round(co * 10, 2) > 8 THEN 'low_coverage' END, CASE WHEN round(au * 10, 2) > 6 THEN 'many_authors' END, CASE WHEN round(sz * 10, 2) > 8 THEN 'large_file' END, CASE WHEN full_score < 0.4 THEN 'low_risk' END) AS factors FROM s WHERE abs(full_score - 0.4) > 1e-9""")
def r05(spark, d):
    return k.weighted_risk(view(spark, d, "v_metrics")).select("path", F.concat_ws(",", "factors").alias("factors"))


@query("r06_coverage_risk", "SELECT path, coalesce((1 - rate) * 10, 10)::DOUBLE AS risk FROM v_docs LEFT JOIN v_coverage USING (path)")
def r06(spark, d):
    return view(spark, d, "v_docs").join(view(spark, d, "v_coverage"), "path", "left").select("path", k.coverage_risk(F.col("rate")).alias("risk"))


def propagation_sql(rounds: int, factor: float, epsilon: float) -> str:
    steps = ["WITH s0 AS (SELECT path, score AS own, score FROM v_base)"]
    for i in range(rounds):
        steps.append(f"s{i + 1} AS (SELECT s.path, s.own, CASE WHEN abs(s.own + coalesce(g.gain, 0) - s.score) > {epsilon} THEN s.own + coalesce(g.gain, 0) ELSE s.score END AS score FROM s{i} s LEFT JOIN (SELECT src AS path, sum(score * {factor}) AS gain FROM v_deps JOIN s{i} t ON t.path = dst GROUP BY src) g ON g.path = s.path)")
    return ", ".join(steps) + f" SELECT path, round(score, 4) AS score FROM s{rounds}"


@query("r07_propagation", propagation_sql(5, 0.2, 0.01))
def r07(spark, d):
    return k.propagate(view(spark, d, "v_deps"), view(spark, d, "v_base"), 0.2, 5).select("path", F.round("score", 4).alias("score"))


@query("r08_relabel", "WITH p AS (" + propagation_sql(5, 0.2, 0.01).replace("WITH s0", "SELECT path, least(1e0, score) AS score FROM (WITH s0", 1) + ")) SELECT p.path, CASE WHEN p.score >= 0.9 THEN 'critical' WHEN p.score >= 0.7 THEN 'high' WHEN p.score >= 0.4 THEN 'medium' ELSE 'low' END AS level, p.score > b.score + 0.05 AS risen FROM p JOIN v_base b USING (path)")
def r08(spark, d):
    base = view(spark, d, "v_base").withColumn("factors", F.array().cast("array<string>"))
    spread = k.propagate(view(spark, d, "v_deps"), base, 0.2, 5).select("path", F.round("score", 4).alias("score"))
    return k.relabel(base, spread).select("path", "level", F.array_contains("factors", "risk_propagated").alias("risen"))


@query("r09_single_file", f"SELECT path, round(CASE WHEN c > 0.7e0 THEN greatest(0.3e0 * c + 0.25e0 * 0 + 0.1e0 * sz, 0.75e0) ELSE 0.3e0 * c + 0.1e0 * sz END, 4) AS score FROM (SELECT path, least({STATIC} / 10e0, 1e0) AS c, least(lines_of_code / 1000e0, 1e0) AS sz FROM v_metrics)")
def r09(spark, d):
    files = view(spark, d, "v_metrics")
    c = F.least(k.static_score(F.col("max_complexity"), F.col("avg_complexity"), F.col("fan_out")) / 10.0, F.lit(1.0))
    alone = files.withColumn("churn", F.lit(0.0)).withColumn("coverage", F.lit(None).cast("double")).withColumn("authors", F.lit(0))
    exact = F.lit(0.3) * c + F.lit(0.1) * F.least(F.col("lines_of_code") / 1000.0, F.lit(1.0))
    return k.weighted_risk(alone, reported=False).select("path", F.round(F.when(c > 0.7, F.greatest(exact, F.lit(0.75))).otherwise(exact), 4).alias("score"))


@query("a17_history", "SELECT path, count(*) AS commits, count(DISTINCT author) AS authors, max(ts) AS last_modified FROM v_commits GROUP BY path")
def a17(spark, d):
    return k.file_history(view(spark, d, "v_commits"))


@query("a18_churn", "SELECT path, round(least(10e0, count(*) / 3e0), 2) AS churn FROM v_commits GROUP BY path")
def a18(spark, d):
    return k.file_history(view(spark, d, "v_commits")).select("path", k.churn_score(F.col("commits"), 90).alias("churn"))


@query("a19_authors", "SELECT path, count(DISTINCT author) AS authors FROM v_commits GROUP BY path")
def a19(spark, d):
    return k.file_history(view(spark, d, "v_commits")).select("path", "authors")


@query("a20_uncovered", "SELECT path FROM v_coverage WHERE rate = 0")
def a20(spark, d):
    return k.uncovered(view(spark, d, "v_coverage"))


@query("w04_hotspots", "SELECT path, count(*) AS commits FROM v_commits GROUP BY path ORDER BY commits DESC, path LIMIT 20")
def w04(spark, d):
    return k.hotspots(view(spark, d, "v_commits"), 20)


@query("g32_coverage_match", "SELECT concat('src/', path) AS path, rate FROM v_docs LEFT JOIN v_coverage USING (path)")
def g32(spark, d):
    files = view(spark, d, "v_docs").select(F.concat(F.lit("src/"), "path").alias("path"))
    return k.match_coverage(files, view(spark, d, "v_coverage").withColumn("ord", F.monotonically_increasing_id()))


@query("g33_coverage_strict", "SELECT path, coalesce(rate, 0) AS rate FROM v_docs LEFT JOIN v_coverage USING (path)")
def g33(spark, d):
    return k.match_coverage(view(spark, d, "v_docs").select("path"), view(spark, d, "v_coverage").withColumn("ord", F.monotonically_increasing_id()), strict=True)


HEALTH = """WITH e AS (SELECT project, count(*) AS errors FROM v_issues JOIN v_files USING (path) WHERE severity = 'error' GROUP BY project),
h AS (SELECT p.project, high_risk_files, avg_risk, coalesce(errors, 0) AS errors, high_risk_files % 2 = 1 AS regressed, 0.5e0 AS completion FROM v_projects p LEFT JOIN e ON e.project = p.project),
x AS (SELECT *, round(greatest(0e0, 100e0 - 2e0 * high_risk_files - 0.1e0 * errors - 15e0 * regressed::INT + 10e0 * completion), 2) AS health, CASE WHEN avg_risk > 0.7 THEN 'high' WHEN avg_risk > 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM h) """


def healthy(spark, d):
    files, issues = both(spark, d)
    errors = issues.where("severity = 'error'").join(files.select("path", "project"), "path").groupBy("project").agg(F.count(F.lit(1)).alias("errors"))
    projects = view(spark, d, "v_projects").join(errors, "project", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return k.health(projects.withColumn("regressed", F.col("high_risk_files") % 2 == 1).withColumn("completion", F.lit(0.5)))


@query("k13_org_report", HEALTH + "SELECT project, risk_level, errors, regressed, health FROM x")
def k13(spark, d):
    """All projects, from the report as it was written."""
    path = scratch(spark, "org")
    writers.org_report(healthy(spark, d).select("project", "risk_level", "errors", "regressed", "health"), path)
    lines = spark.read.text(f"{path}/what=projects")
    return lines.select(F.from_json("value", "project string, risk_level string, errors long, regressed boolean, health double").alias("x")).select("x.*")


@query("k13_org_summary", HEALTH + "SELECT count(*) AS total_projects, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'low') AS low, count(*) FILTER (regressed) AS regressions FROM x")
def k13_summary(spark, d):
    path = scratch(spark, "org")
    writers.org_report(healthy(spark, d).select("project", "risk_level", "errors", "regressed", "health"), path)
    form = "total_projects long, projects_by_risk_level struct<high: long, medium: long, low: long>, projects_with_regressions long"
    found = spark.read.text(f"{path}/what=summary").select(F.from_json("value", form).alias("x"))
    return found.select("x.total_projects", "x.projects_by_risk_level.*", F.col("x.projects_with_regressions").alias("regressions"))


@query("k13_org_markdown", HEALTH + "SELECT project, concat('| ', project, ' | ', printf('%.2f', health), ' | ', upper(risk_level[1]), risk_level[2:], ' | ', errors, ' | 0 | ', CASE WHEN regressed THEN '⚠️' ELSE '✅' END, ' |') AS value FROM x")
def k13_markdown(spark, d):
    return writers.org_markdown(healthy(spark, d).withColumn("open_tasks", F.lit(0)))


@query("k12_report_files", PER_FILE + "SELECT f.path, score, level, coalesce(total, 0) AS total FROM v_files f LEFT JOIN s ON s.path = f.path")
def k12_files(spark, d):
    """All files, from the report as it was written."""
    path = scratch(spark, "report")
    own, issues = both(spark, d)
    writers.write_report(r.project_report(own, issues), r.file_rows(own, issues), path)
    return spark.read.text(f"{path}/what=files").select(F.from_json("value", "path string, score double, level string, total long").alias("x")).select("x.*")


@query("k11_markdown_rows", PER_FILE + "SELECT f.path, concat('| ', f.path, ' | ', round(CAST(score AS DECIMAL(18, 9)), 2)::DECIMAL(18, 2), ' | ', level, ' | ', coalesce(total, 0), ' |') AS value FROM v_files f LEFT JOIN s ON s.path = f.path")
def k11_rows(spark, d):
    return writers.markdown_rows(r.file_rows(*both(spark, d)))


@query("k14_review", """WITH e AS (SELECT * FROM v_issues WHERE severity = 'error'), n AS (SELECT count(*) AS n FROM e)
SELECT 0::INTEGER AS place, concat('Found ', n, ' high severity issues.') AS value FROM n
UNION ALL SELECT * FROM (SELECT row_number() OVER (ORDER BY ord)::INTEGER AS place, concat('- **', path, '**: ', rule_id) FROM e) WHERE place <= 10
UNION ALL SELECT 11, concat('...and ', n - 10, ' more.') FROM n""")
def k14_review(spark, d):
    return writers.review_lines(view(spark, d, "v_issues"))


@query("r10_health", HEALTH + "SELECT project, health, errors FROM x")
def r10(spark, d):
    return healthy(spark, d).select("project", "health", "errors")


@query("r11_risk_level", HEALTH + "SELECT project, risk_level FROM x")
def r11(spark, d):
    return healthy(spark, d).select("project", "risk_level")


@query("a13_overview", HEALTH + "SELECT count(*) AS projects, count(*) FILTER (regressed) AS regressions, round(avg(health), 6) AS avg_health FROM x")
def a13(spark, d):
    return k.overview(healthy(spark, d)).withColumn("avg_health", F.round("avg_health", 6))


@query("a14_risk_histogram", HEALTH + "SELECT l AS risk_level, count(x.project) AS n FROM (VALUES ('high'), ('medium'), ('low')) t(l) LEFT JOIN x ON risk_level = l GROUP BY l")
def a14(spark, d):
    return k.risk_histogram(healthy(spark, d))


CALLS = "SELECT event_id % 7 AS cost, (user_id % 10) * 1e0 AS latency, event_type <> 'error' AS success FROM {events}"


def calls(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 7).alias("cost"), (F.col("user_id") % 10).cast("double").alias("latency"), (F.col("event_type") != "error").alias("success"))


@query("a21_call_costs", f"SELECT sum(cost)::DOUBLE AS total_cost, count(*) AS calls, round(avg(cost), 6) AS avg_cost, round(avg(latency), 6) AS avg_latency, round(avg(success::INT), 6) AS success_rate FROM ({CALLS})")
def a21(spark, d):
    found = k.call_costs(calls(spark, d))
    return found.select(F.col("total_cost").cast("double").alias("total_cost"), "calls", *(F.round(c, 6).alias(c) for c in ("avg_cost", "avg_latency", "success_rate")))


@query("a22_high_cost", f"SELECT sum(cost)::DOUBLE AS total_cost FROM ({CALLS}) HAVING sum(cost) > 10")
def a22(spark, d):
    return k.costs_over(calls(spark, d), 10).select(F.col("total_cost").cast("double").alias("total_cost"))


# History

def sides(spark, d):
    return [view(spark, d, f"v_{n}") for n in ("old_files", "new_files", "old_issues", "new_issues")]


@query("d01_project_diff", """SELECT (SELECT count(*) FROM v_new_files WHERE level = 'high') - (SELECT count(*) FROM v_old_files WHERE level = 'high') AS high_delta, (SELECT count(*) FROM v_new_issues) - (SELECT count(*) FROM v_old_issues) AS issues_delta,
(SELECT count(*) FROM v_new_issues WHERE severity = 'error') - (SELECT count(*) FROM v_old_issues WHERE severity = 'error') AS errors_delta""")
def d01(spark, d):
    return h.project_diff(*sides(spark, d))


@query("d02_file_diff", """WITH c AS (SELECT coalesce(o.path, n.path) AS path, count(*) FILTER (o.id IS NULL) AS added, count(*) FILTER (n.id IS NULL) AS resolved FROM v_old_issues o FULL JOIN v_new_issues n ON o.path = n.path AND o.id = n.id GROUP BY 1),
b AS (SELECT coalesce(o.path, n.path) AS path, o.level AS ol, n.level AS nl, coalesce(n.score, 0) - coalesce(o.score, 0) AS score_delta FROM v_old_files o FULL JOIN v_new_files n ON o.path = n.path)
SELECT b.path, CASE WHEN ol IS NULL THEN 'added' WHEN nl IS NULL THEN 'removed' WHEN ol <> nl OR coalesce(added, 0) > 0 OR coalesce(resolved, 0) > 0 THEN 'modified' ELSE 'unchanged' END AS status, round(score_delta, 6) AS score_delta, coalesce(added, 0) AS added, coalesce(resolved, 0) AS resolved FROM b LEFT JOIN c ON c.path = b.path""")
def d02(spark, d):
    return h.file_diff(*sides(spark, d)).withColumn("score_delta", F.round("score_delta", 6))


@query("d03_structural_diff", """WITH o AS (SELECT path, level AS hash, CAST(score * 100 AS INT) AS cyclomatic FROM v_old_files), n AS (SELECT path, level AS hash, CAST(score * 100 AS INT) AS cyclomatic FROM v_new_files)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS status, n.cyclomatic - o.cyclomatic AS cyclomatic_delta FROM o FULL JOIN n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash""")
def d03(spark, d):
    old, new = (f.select("path", F.col("level").alias("hash"), F.round(F.col("score") * 100).cast("int").alias("cyclomatic")) for f in sides(spark, d)[:2])
    return h.structural_diff(old, new)


@query("d04_dependency_diff", "WITH o AS (SELECT DISTINCT src, dst FROM v_deps WHERE src % 2 = 0), n AS (SELECT DISTINCT src, dst FROM v_deps WHERE dst % 2 = 0) SELECT 'added' AS op, * FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', * FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def d04(spark, d):
    deps = view(spark, d, "v_deps")
    return h.dependency_diff(deps.where("src % 2 = 0"), deps.where("dst % 2 = 0"))


@query("d08_regressions", "SELECT 'error_issues' AS kind, 'error' AS severity, CAST(x AS BIGINT) AS delta FROM (SELECT (SELECT count(*) FROM v_new_issues WHERE severity = 'error') - (SELECT count(*) FROM v_old_issues WHERE severity = 'error') AS x) WHERE x > -1 UNION ALL SELECT 'high_risk_files', 'warning', x FROM (SELECT (SELECT count(*) FROM v_new_files WHERE level = 'high') - (SELECT count(*) FROM v_old_files WHERE level = 'high') AS x) WHERE x > -100")
def d08(spark, d):
    return h.regressions(h.project_diff(*sides(spark, d)), -100, -1)


TREND = "SELECT project, day, high::BIGINT AS high, issues, errors::BIGINT AS errors FROM v_points"


@query("w08_latest", f"SELECT project, day, high, issues, errors FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY day DESC) AS rank FROM ({TREND})) WHERE rank <= 3")
def w08(spark, d):
    return h.latest(view(spark, d, "v_points"), 3).drop("rank")


@query("w09_trend", f"SELECT *, high - lag(high) OVER w AS high_change, issues - lag(issues) OVER w AS issues_change, errors - lag(errors) OVER w AS errors_change FROM ({TREND}) WINDOW w AS (PARTITION BY project ORDER BY day)")
def w09(spark, d):
    return h.trend(view(spark, d, "v_points"))


@query("w10_last_two", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY day DESC) AS rank FROM ({TREND})) SELECT a.project, a.high, b.high AS high_before, a.errors, b.errors AS errors_before, a.high > b.high OR a.errors > b.errors AS regressed FROM t a JOIN t b ON a.project = b.project AND a.rank = 1 AND b.rank = 2""")
def w10(spark, d):
    return h.last_two(view(spark, d, "v_points"))


@query("w11_retention", """WITH v AS (SELECT concat('p', o_custkey % 20) AS project, concat('v', o_orderkey) AS version, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS ts, o_orderkey FROM {orders}), f AS (SELECT *, coalesce(ts >= (SELECT max(o_orderdate) FROM {orders}) - INTERVAL 400 DAYS, FALSE) AS fresh FROM v)
SELECT project, version, fresh AND row_number() OVER (PARTITION BY project, fresh ORDER BY ts DESC NULLS LAST, o_orderkey DESC) <= 5 AS keep FROM f""")
def w11(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    now = str(orders.agg(F.max("o_orderdate")).first()[0])
    versions = orders.select(F.concat(F.lit("p"), (F.col("o_custkey") % 20).cast("string")).alias("project"), F.concat(F.lit("v"), "o_orderkey").alias("version"), F.when(F.col("o_orderkey") % 10 == 0, "not a time").otherwise(F.col("o_orderdate").cast("string")).alias("timestamp"))
    return h.retention(versions, now, 400, 5)


@query("k06_next_version", "SELECT concat('p', o_custkey % 20) AS project, concat('v', max(o_orderkey) + 1) AS next FROM {orders} GROUP BY 1")
def k06(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return h.next_version(orders.select(F.concat(F.lit("p"), (F.col("o_custkey") % 20).cast("string")).alias("project"), F.concat(F.lit("v"), "o_orderkey").alias("version")))


@query("k12_junit_counts", "SELECT count(*) AS tests, count(*) FILTER (severity IN ('error', 'warning')) AS failures FROM v_issues")
def k12(spark, d):
    from ashlar.sources.writers import junit_counts

    return junit_counts(view(spark, d, "v_issues"))


# Tasks

TASKS = """WITH x AS (SELECT i.id, project, i.path, language, rule_id, level AS risk_level, severity, i.ord FROM v_issues i JOIN v_files f ON f.path = i.path),
t AS (SELECT *, CASE WHEN severity = 'error' THEN CASE risk_level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END WHEN severity = 'warning' THEN CASE risk_level WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END ELSE 5 END AS priority FROM x) """


def all_tasks(spark, d):
    return t.issue_tasks(*both(spark, d))


@query("t01_plan", TASKS + "SELECT id, project, path, language, rule_id, priority, risk_level, 'pending' AS status, ord FROM t")
def t01(spark, d):
    return all_tasks(spark, d)


@query("r12_priority", TASKS + "SELECT priority, count(*) AS n FROM t GROUP BY priority")
def r12(spark, d):
    return r.tally(all_tasks(spark, d), "priority")


@query("a15_task_summary", TASKS + "SELECT 'priority' AS kind, priority::VARCHAR AS key, count(*) AS n FROM t GROUP BY priority UNION ALL SELECT 'language', language, count(*) FROM t GROUP BY language UNION ALL SELECT 'risk_level', risk_level, count(*) FROM t GROUP BY risk_level")
def a15(spark, d):
    return t.task_summary(all_tasks(spark, d))


@query("w05_dual_quota")
def w05(spark, d):
    return t.within_quotas(all_tasks(spark, d), 3, 20).select("id", "project", "path", "rule_id", "priority")


@query("w06_grouped", TASKS + "SELECT project, rule_id, min(priority) AS best, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY priority, ord, id) AS ids FROM t GROUP BY project, rule_id")
def w06(spark, d):
    return t.grouped(all_tasks(spark, d)).select("project", "rule_id", "best", "n", F.array_join(F.transform("tasks", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("t02_flattened", TASKS + "SELECT project, priority, ord, id FROM t")
def t02(spark, d):
    return t.flattened(t.grouped(all_tasks(spark, d)))


@query("t03_find_task", TASKS + "SELECT id, path FROM t WHERE id = 17")
def t03(spark, d):
    return all_tasks(spark, d).where("id = 17").select("id", "path").limit(1)


@query("t04_file_list", "SELECT path, score, level FROM v_files WHERE language = 'BUILDING' AND level = 'high'")
def t04(spark, d):
    return view(spark, d, "v_files").where("language = 'BUILDING' AND level = 'high'").select("path", "score", "level")


@query("w07_selection", TASKS + "SELECT id, priority FROM t WHERE language = 'BUILDING' AND risk_level IN ('medium', 'high') ORDER BY priority, ord LIMIT 25")
def w07(spark, d):
    return t.selected(all_tasks(spark, d), ["BUILDING"], least_level="medium", limit=25).select("id", "priority")


@query("w14_suggestion_quota", "SELECT id, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) AS place FROM v_issues WHERE severity IN ('error', 'warning')) WHERE place <= 2 ORDER BY ord LIMIT 100")
def w14(spark, d):
    return t.suggestion_quota(view(spark, d, "v_issues"), ["error", "warning"], 2, 100).select("id", "path")


@query("r13_strategy", "SELECT path, CASE WHEN score >= 0.7 OR ord % 10 = 0 THEN 'full' WHEN score >= 0.3 THEN 'skeleton' ELSE 'signature' END AS strategy FROM v_files")
def r13(spark, d):
    return view(spark, d, "v_files").select("path", t.strategy(F.col("score"), F.col("ord") % 10 == 0).alias("strategy"))


@query("r14_budget")
def r14(spark, d):
    files = view(spark, d, "v_files").select("project", "path", "score", "ord", (F.col("loc") % 10 + 1).alias("signature_cost"), (F.col("loc") % 100 + 11).alias("skeleton_cost"), (F.col("loc") + 111).alias("full_cost"))
    return t.budget_allocation(files, 50_000)


@query("r15_context_window", """WITH c AS (SELECT concat('c', conv_id) AS project, turn AS ord, text, ceil(length(text) / 4.0)::BIGINT AS cost FROM {conversations} WHERE text IS NOT NULL),
l AS (SELECT *, 300 - coalesce(sum(cost) OVER (PARTITION BY project ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM c)
SELECT project, ord, CASE WHEN cost <= left_over THEN text ELSE substr(text, 1, (left_over * 3)::INT) END AS text, cost <= left_over AS whole FROM l WHERE left_over >= 0 AND (cost <= left_over OR left_over > 50)""")
def r15(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("text IS NOT NULL")
    return t.context_window(turns.select(F.concat(F.lit("c"), "conv_id").alias("project"), F.col("turn").alias("ord"), "text", t.token_cost(F.col("text")).alias("cost")), 300)


# Policies

def context(spark, d):
    files, issues = both(spark, d)
    return r.project_report(files, issues).withColumn("has_regression", F.lit(True))


@query("y01_conditions", "SELECT path, score > 0.5 AS above, level IN ('high', 'critical') AS bad, level NOT IN ('low') AS not_low, FALSE AS unknown FROM v_files")
def y01(spark, d):
    files = view(spark, d, "v_files")
    return files.select("path", y.condition(files, "score", ">", 0.5).alias("above"), y.condition(files, "level", "in", ["high", "critical"]).alias("bad"), y.condition(files, "level", "not in", ["low"]).alias("not_low"), y.condition(files, "nothing", "==", 1).alias("unknown"))


POLICIES = y.policy_set({"rules": [
    {"id": "high", "conditions": [{"field": "high_risk_files", "op": ">", "value": 0}], "actions": ["warn"]},
    {"id": "regressed", "conditions": [{"field": "has_regression", "op": "==", "value": True}], "actions": [{"type": "suggest_block_ci"}]},
    {"id": "none", "conditions": [{"field": "total_files", "op": "<", "value": 0}], "actions": ["warn"]},
    {"id": "file", "scope": "file", "conditions": [], "actions": ["warn"]},
    {"id": "building", "conditions": [{"field": "languages", "op": "in", "value": ["BUILDING"]}], "actions": ["warn"]},
]})


@query("y02_policies", "SELECT * FROM (VALUES ('high', 'warning'), ('regressed', 'error'), ('building', 'warning')) x(rule, severity)")
def y02(spark, d):
    return y.decisions(context(spark, d), POLICIES).select("rule", "severity")


@query("y03_validation", "SELECT 'unknown operator ~' AS problem")
def y03(spark, d):
    try:
        y.policy_set({"rules": [{"id": "x", "conditions": [{"field": "a", "op": "~", "value": 1}]}]})
    except ValueError as problem:
        return spark.createDataFrame([(str(problem),)], "problem string")


@query("y04_gate", "SELECT FALSE AS passed, 'errors,high_risk_files,regression,policy' AS reasons")
def y04(spark, d):
    return y.gate(context(spark, d).withColumn("error_decisions", F.lit(1)), 0, 0).select("passed", F.concat_ws(",", "reasons").alias("reasons"))


@query("y05_fail_on_high", "SELECT count(*) > 0 AS failed FROM v_issues WHERE severity = 'error'")
def y05(spark, d):
    return r.fails_on_high(*both(spark, d))


@query("y06_failure_kind", "SELECT event_id, CASE event_type WHEN 'click' THEN 'transient' WHEN 'error' THEN 'contextual' WHEN 'purchase' THEN 'validation' WHEN 'signup' THEN 'conflict' ELSE 'unknown' END AS kind FROM {events}")
def y06(spark, d):
    said = F.create_map(*map(F.lit, ("click", "Network gone", "error", "Anchor not found", "purchase", "a Test Failed", "signup", "merge conflict in x")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", y.failure_kind(F.coalesce(said[F.col("event_type")], F.lit("?"))).alias("kind"))
