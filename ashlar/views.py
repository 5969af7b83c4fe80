"""Domain tables over the driver's tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")
_LEVEL = "CASE WHEN {0} >= 0.9 THEN 'critical' WHEN {0} >= 0.7 THEN 'high' WHEN {0} >= 0.4 THEN 'medium' ELSE 'low' END"
VIEWS = {
    "v_function": "SELECT concat('function:', p_partkey) AS id, 'function' AS type, p_name AS name, concat(p_brand, '.', p_name) AS qualified_name, concat('file:', p_partkey % 100 + 1) AS path, p_type AS language, p_size AS complexity, CAST(floor(p_retailprice) AS INT) AS loc FROM {part}",
    "v_file": "SELECT concat('file:', c_custkey) AS id, 'file' AS type, c_name AS name, c_name AS qualified_name, c_name AS path, c_mktsegment AS language, CAST(NULL AS INT) AS complexity, CAST(floor(abs(c_acctbal)) AS INT) AS loc FROM {customer}",
    "v_class": "SELECT concat('class:', n_nationkey) AS id, 'class' AS type, n_name AS name, n_name AS qualified_name, CAST(NULL AS STRING) AS path, CAST(NULL AS STRING) AS language, CAST(NULL AS INT) AS complexity, CAST(NULL AS INT) AS loc FROM {nation}",
    "v_module": "SELECT concat('module:', r_regionkey) AS id, 'module' AS type, r_name AS name, r_name AS qualified_name, CAST(NULL AS STRING) AS path, CAST(NULL AS STRING) AS language, CAST(NULL AS INT) AS complexity, CAST(NULL AS INT) AS loc FROM {region}",
    "v_nodes": "SELECT * FROM v_function UNION ALL SELECT * FROM v_file UNION ALL SELECT * FROM v_class UNION ALL SELECT * FROM v_module",
    "v_pairs": "SELECT l1.l_partkey AS s, l2.l_partkey AS t, l1.l_linenumber AS line FROM {lineitem} l1 JOIN {lineitem} l2 ON l1.l_orderkey = l2.l_orderkey AND l2.l_linenumber = l1.l_linenumber + 1",
    "v_calls": "SELECT DISTINCT concat('function:', s) AS source, concat('function:', t) AS target, 'calls' AS type FROM v_pairs",
    "v_calls_sparse": "SELECT DISTINCT concat('function:', s) AS source, concat('function:', t) AS target, 'calls' AS type FROM v_pairs WHERE line = 6 AND s < t",
    "v_calls_dag": "SELECT DISTINCT s AS source, t AS target FROM v_pairs WHERE s < t",
    "v_imports": "SELECT concat('file:', c_custkey) AS source, concat('class:', c_nationkey) AS target, 'imports' AS type FROM {customer}",
    "v_inherits": "SELECT concat('class:', n_nationkey) AS source, concat('module:', n_regionkey) AS target, 'inherits' AS type FROM {nation}",
    "v_contains": "SELECT concat('file:', p_partkey % 100 + 1) AS source, concat('function:', p_partkey) AS target, 'contains' AS type FROM {part}",
    "v_edges": "SELECT * FROM v_calls UNION ALL SELECT * FROM v_imports UNION ALL SELECT * FROM v_inherits UNION ALL SELECT * FROM v_contains",
    "v_scored": "SELECT concat('file:', c_custkey) AS path, c_mktsegment AS language, concat('p', c_nationkey) AS project, floor(c_acctbal + 1000) / 11000.0e0 AS score, c_custkey AS ord, CAST(floor(abs(c_acctbal)) AS INT) AS loc FROM {customer}",
    "v_files": f"SELECT *, {_LEVEL.format('score')} AS level FROM v_scored",
    "v_issues": "SELECT o_orderkey AS id, concat('file:', o_custkey) AS path, concat(o_orderstatus, o_orderkey % 7) AS rule_id, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'error' WHEN o_orderpriority LIKE '3%' THEN 'warning' ELSE 'info' END AS severity, o_orderkey AS ord FROM {orders}",
    "v_commits": "SELECT concat('u', user_id) AS path, event_type AS author, ts FROM {events}",
    "v_points": "SELECT event_type AS project, CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS issues, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS high, sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS errors FROM {events} GROUP BY event_type, CAST(ts AS DATE)",
    "v_raw_old": "SELECT concat('u', user_id) AS path, floor(max(value)) AS top FROM {events} WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY user_id",
    "v_raw_new": "SELECT concat('u', user_id) AS path, floor(max(value)) AS top FROM {events} WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY user_id",
    "v_old_files": f"SELECT path, CAST(top % 100 AS INT) / 100.0e0 AS score, {_LEVEL.format('CAST(top % 100 AS INT) / 100.0e0')} AS level FROM v_raw_old",
    "v_new_files": f"SELECT path, CAST(top % 100 AS INT) / 100.0e0 AS score, {_LEVEL.format('CAST(top % 100 AS INT) / 100.0e0')} AS level FROM v_raw_new",
    "v_old_issues": "SELECT DISTINCT concat('u', user_id) AS path, concat(event_type, user_id % 4) AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity FROM {events} WHERE ts < TIMESTAMP '2024-01-16 00:00:00'",
    "v_new_issues": "SELECT DISTINCT concat('u', user_id) AS path, concat(event_type, user_id % 4) AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity FROM {events} WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'",
    "v_deps": "SELECT s AS src, t AS dst FROM v_pairs",
    "v_base": "SELECT p_partkey AS path, least(p_size / 50.0e0, 1.0e0) AS score FROM {part}",
    "v_metrics": "SELECT concat('file:', p_partkey) AS path, CAST(floor(p_retailprice) AS INT) AS lines_of_code, p_size % 25 AS max_complexity, (p_size % 25) / 2.0e0 AS avg_complexity, p_size AS fan_out, (p_size % 11) * 1.0e0 AS churn, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_size % 10) / 10.0e0 END AS coverage, p_size % 8 AS authors FROM {part}",
    "v_coverage": "SELECT concat('doc/', doc_id) AS path, CAST(quality AS DOUBLE) AS rate FROM {labels}",
    "v_docs": "SELECT concat('doc/', doc_id) AS path, lang AS language, source AS project, text AS content, n_chars AS size, doc_id AS ord FROM {documents}",
    "v_events": "SELECT concat('u', user_id) AS path, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS change_type, ts, event_id AS ord FROM {events}",
    "v_projects": "SELECT project, count(*) AS total_files, sum(CASE WHEN level = 'high' THEN 1 ELSE 0 END) AS high_risk_files, avg(score) AS avg_risk FROM v_files GROUP BY project",
}


def closure(sql: str) -> list[str]:
    """The views that sql needs, each after those it needs itself."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in VIEWS and name not in found:
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def _with(sql: str) -> str:
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in closure(sql))
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if not ctes:
        return sql
    return f"WITH {head[1] or ''}{ctes}, {sql[head.end():]}" if head else f"WITH {ctes} {sql}"


def oracle(sql: str) -> str:
    """sql over views, for DuckDB."""
    return reduce(lambda s, t: s.replace("{%s}" % t, t), TABLES, _with(sql))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame."""
    sql = _with(f"SELECT * FROM {name}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)
