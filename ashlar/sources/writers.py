"""Sinks: graphs, versioned snapshots, history, reports, logs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ashlar.operators.graph import Graph, add_edges, add_nodes
from ashlar.operators.history import next_version


def save_graph(graph: Graph, path: str, generation: int = 0) -> None:
    """Nodes and edges below path, parts by type, so that a scan of one type reads its folder only."""
    graph.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/g={generation}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/g={generation}/edges")


def load_graph(spark: SparkSession, path: str, generation: int = 0, schemas: tuple | None = None) -> Graph:
    """schemas, of nodes and edges, are needed where a part may be empty."""
    read = lambda part, i: (spark.read.schema(schemas[i]) if schemas else spark.read).parquet(f"{path}/g={generation}/{part}")
    return Graph(read("nodes", 0), read("edges", 1))


def upsert(spark: SparkSession, path: str, generation: int, more: Graph) -> Graph:
    """The next generation: nodes replaced by id, edges added that are new and don't dangle. The one before stays readable."""
    graph = add_edges(add_nodes(load_graph(spark, path, generation), more.nodes), more.edges)
    save_graph(graph, path, generation + 1)
    return load_graph(spark, path, generation + 1)


def graph_json(graph: Graph) -> DataFrame:
    """Each node and edge as a JSON text; from_graph_json reads it back."""
    return graph.nodes.select(F.lit("node").alias("what"), F.to_json(F.struct("*")).alias("value")).unionByName(graph.edges.select(F.lit("edge").alias("what"), F.to_json(F.struct("*")).alias("value")))


def from_graph_json(rows: DataFrame, nodes: str, edges: str) -> Graph:
    read = lambda what, schema: rows.where(F.col("what") == what).select(F.from_json("value", schema).alias("x")).select("x.*")
    return Graph(read("node", nodes), read("edge", edges))


def write_version(files: DataFrame, root: str, project: str) -> str:
    """Appends files as the project's next version and names it. One writer at a time for each project."""
    spark = files.sparkSession
    try:
        before = spark.read.parquet(root).where(F.col("project") == project).select("project", "version").distinct()
        row = next_version(before).first()
    except Exception as missing:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        row = None
    version = row["next"] if row else "v1"
    files.withColumn("project", F.lit(project)).withColumn("version", F.lit(version)).write.mode("append").partitionBy("project", "version").parquet(root)
    return version


def write_history(root: str, project: str, snapshot: str, created_at: str, files: DataFrame, issues: DataFrame) -> None:
    """Appends a row to snapshots (risk_score is the mean times 100, cut), and the issues."""
    spark = files.sparkSession
    mean = files.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg"))
    row = mean.select(F.lit(project).alias("project"), F.lit(snapshot).alias("snapshot"), F.to_timestamp(F.lit(created_at)).alias("created_at"), (F.col("avg") * 100).cast("int").alias("risk_score"))
    row.write.mode("append").parquet(f"{root}/snapshots")
    issues.withColumn("project", F.lit(project)).withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("project").parquet(f"{root}/issues")
    spark.createDataFrame([(project,)], "project string").write.mode("append").parquet(f"{root}/projects")


# Documents of a bounded size

def report_json(report: DataFrame, rows: DataFrame, most: int = 1000) -> str:
    """A project's summary and its files, the worst first, where there are at most so many."""
    files = rows.orderBy(F.col("score").desc(), "path").limit(most + 1).toJSON().take(most + 1)
    if len(files) > most:
        raise ValueError("too many files for one document: write_report instead")
    return json.dumps({"project_summary": report.first().asDict(recursive=True), "files": [json.loads(r) for r in files]}, default=str, indent=2)


def write_report(report: DataFrame, rows: DataFrame, path: str) -> None:
    """A project's summary and all its files as JSON lines, below what=project_summary and what=files."""
    line = F.to_json(F.struct("*")).alias("value")
    lines = report.select(F.lit("project_summary").alias("what"), line).unionByName(rows.select(F.lit("files").alias("what"), line))
    lines.write.mode("overwrite").partitionBy("what").text(path)


def markdown_rows(rows: DataFrame) -> DataFrame:
    """A line of the report's table for each file, to be written as text by the executors; a score's decimals are rounded
    half up."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    parts = [cell("path"), F.format_string("%.2f", F.col("score")), cell("level"), cell("total")]
    return rows.select("path", F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |")).alias("value"))


def review_lines(issues: DataFrame, most: int = 10) -> DataFrame:
    """(place, value): a review's summary of errors, the first most of them by ord, then how many more there are."""
    errors = issues.where(F.col("severity").isin("error", "high"))
    n = errors.agg(F.count(F.lit(1)).alias("n"))
    first = errors.orderBy("ord").limit(most).select(F.row_number().over(Window.orderBy("ord")).alias("place"), F.concat(F.lit("- **"), "path", F.lit("**: "), "rule_id").alias("value"))  # most rows
    head = n.select(F.lit(0).alias("place"), F.when(F.col("n") == 0, "No high severity issues.").otherwise(F.concat(F.lit("Found "), "n", F.lit(" high severity issues."))).alias("value"))
    more = n.where(F.col("n") > most).select(F.lit(most + 1).alias("place"), F.concat(F.lit("...and "), F.col("n") - most, F.lit(" more.")).alias("value"))
    return head.unionByName(first).unionByName(more)


def report_markdown(report: DataFrame, rows: DataFrame, most: int = 20) -> str:
    summary = report.first().asDict()
    out = ["# Project report", "", *(f"- {name}: {value}" for name, value in summary.items()), "", "| file | score | level | issues |", "|-|-|-|-|"]
    out += [f"| {r['path']} | {r['score']:.2f} | {r['level']} | {r['total']} |" for r in rows.orderBy(F.col("score").desc(), "path").take(most)]
    return "\n".join(out) + "\n"


def org_report(projects: DataFrame, path: str) -> None:
    """projects(project, risk_level, health, ...) as JSON lines below what=summary (how many there are, and of each level),
    and what=projects (all of them)."""
    level = lambda name: F.count_if(F.col("risk_level") == name).alias(name)
    summary = projects.agg(F.count(F.lit(1)).alias("total_projects"), F.struct(level("high"), level("medium"), level("low")).alias("projects_by_risk_level"), F.coalesce(F.sum(F.col("regressed").cast("long")), F.lit(0)).alias("projects_with_regressions"))
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    lines = summary.select(F.lit("summary").alias("what"), line).unionByName(projects.select(F.lit("projects").alias("what"), line))
    lines.write.mode("overwrite").partitionBy("what").text(path)


def org_markdown(projects: DataFrame) -> DataFrame:
    """The rows of the projects' table, to be written as text by the executors; org_heading goes before them."""
    cell = lambda c: F.coalesce(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    mark = F.when(F.col("regressed"), "⚠️").otherwise("✅")
    parts = [cell(F.col("project")), F.format_string("%.2f", F.col("health")), cell(F.initcap("risk_level")), cell(F.col("errors")), cell(F.col("open_tasks")), mark]
    return projects.select("project", F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |")).alias("value"))


def junit_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("severity").isin("error", "warning")).alias("failures"))


def junit_cases(issues: DataFrame) -> DataFrame:
    """One XML element for each issue, to be written as text by the executors."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    failure = F.when(F.col("severity").isin("error", "warning"), F.concat(F.lit('<failure type="'), escape(F.col("severity")), F.lit('"/>'))).otherwise("")
    return issues.select(F.concat(F.lit('<testcase classname="'), escape(F.col("path")), F.lit('" name="'), escape(F.col("rule_id")), F.lit('">'), failure, F.lit("</testcase>")).alias("value"))


def junit_xml(issues: DataFrame, name: str = "scan", most: int = 10_000) -> str:
    """The whole document where there are at most so many issues."""
    counts = junit_counts(issues).first()
    if counts["tests"] > most:
        raise ValueError("too many issues for one document: write junit_cases instead")
    cases = "".join(r[0] for r in junit_cases(issues).collect())
    return f'<testsuite name={quoteattr(name)} tests="{counts["tests"]}" failures="{counts["failures"]}">{cases}</testsuite>'


def _yaml(rows: list[dict]) -> str:
    import yaml

    without = lambda x: {k: without(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [without(v) for v in x] if isinstance(x, list) else x
    return yaml.safe_dump([without(r) for r in rows], sort_keys=False)


def yaml_document(rows: DataFrame, most: int = 1000) -> str:
    """Rows as YAML without nulls, where there are at most so many."""
    found = rows.take(most + 1)
    if len(found) > most:
        raise ValueError("too many rows for one document: write yaml_items instead")
    return _yaml([r.asDict(recursive=True) for r in found])


def yaml_items(rows: DataFrame) -> DataFrame:
    """Each row as an item of a YAML list without nulls, to be written as text by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [_yaml([r]).rstrip("\n") for r in batch.to_pylist(maps_as_pydicts="strict")]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def write_json(df: DataFrame, path: str, schema: str | None = None) -> None:
    """JSON lines; with a schema, columns that lack or don't fit raise before anything is written."""
    if schema:
        df = df.to(df.sparkSession.createDataFrame([], schema).schema)
    df.write.mode("overwrite").json(path)


def append_log(events: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    events.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def export(rows: DataFrame, path: str, kind: str) -> None:
    """Decisions or events as JSON lines below path, a folder for each value of kind; earlier exports stay.

    A row's other columns are in its line as they are, nulls left out. For a stream, stream_export does this by batch.
    """
    rows.write.mode("append").partitionBy(kind).json(path)


def stream_export(rows: DataFrame, path: str, kind: str, checkpoint: str):
    """A running query that exports each row of a stream once: the file sink commits what a batch has written."""
    return rows.writeStream.format("json").partitionBy(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
