"""Report, issue and project summaries over files(path, language, level, score, ord) and issues(path, rule_id, severity, ord)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def issue_summary(issues: DataFrame) -> DataFrame:
    """(kind, key, n): the total, by severity, by rule; one pass by grouping sets."""
    sets = issues.groupingSets([[], ["severity"], ["rule_id"]], "severity", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "severity").otherwise("rule")
    return sets.select(kind.alias("kind"), F.coalesce("severity", "rule_id").alias("key"), "n")


def ranked_rules(issues: DataFrame, per: list[str], most: int) -> DataFrame:
    """The most frequent rules of each group, ties in order of first appearance: (*per, rule_id, n, rank)."""
    counted = issues.groupBy(*per, "rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.col("n").desc(), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select(*per, "rule_id", "n", "rank")


def file_issue_counts(issues: DataFrame, rules: int = 3) -> DataFrame:
    """(path, total, errors, warnings, top_rules array)."""
    counted = issues.groupBy("path").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    top = ranked_rules(issues, ["path"], rules).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "rule_id"))), lambda x: x["rule_id"]).alias("top_rules"))
    return counted.join(top, "path")


def file_rows(files: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for each file; without risk it is low and 0.0, without issues 0."""
    none = F.array().cast("array<string>")
    joined = files.join(file_issue_counts(issues), "path", "left")
    return joined.select("path", "language", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("level", F.lit("low")).alias("level"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "errors", "warnings")), F.coalesce("top_rules", none).alias("top_rules"))


def project_report(files: DataFrame, issues: DataFrame, critical_is_high: bool = False) -> DataFrame:
    """One row: file and issue counts by level and severity; whatever isn't high or medium counts as low, critical too."""
    high = F.col("level").isin("high", "critical") if critical_is_high else F.col("level") == "high"
    medium = F.col("level") == "medium"
    of_files = files.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(high).alias("high_risk_files"), F.count_if(medium).alias("medium_risk_files"), F.array_sort(F.collect_set("language")).alias("languages"))
    of_issues = issues.agg(F.count(F.lit(1)).alias("total_issues"), *(F.count_if(F.col("severity") == s).alias(f"{s}_issues") for s in ("error", "warning", "info")))
    one = F.lit(1).alias("one")
    joined = of_files.select("*", one).join(of_issues.select("*", one), "one")  # one row each
    return joined.withColumn("low_risk_files", F.col("total_files") - F.col("high_risk_files") - F.col("medium_risk_files")).drop("one")


def files_per_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def risk_summary(files: DataFrame) -> DataFrame:
    """Mean score and counts by level; critical counts as high; zeros when there are no files."""
    count = lambda *levels: F.count_if(F.col("level").isin(*levels))
    return files.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_risk"), count("high", "critical").alias("high_risk_files"), count("medium").alias("medium_risk_files"), count("low").alias("low_risk_files"))


def top_files(files: DataFrame, n: int = 10) -> DataFrame:
    return files.orderBy(F.col("score").desc(), "ord").limit(n)


def first_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    """Errors and warnings in scan order."""
    return issues.where(F.col("severity").isin("error", "warning")).orderBy("ord").limit(n)


def merge_snapshots(parts: list[DataFrame]) -> DataFrame:
    """Files of several languages' snapshots, one after the other; nothing is deduplicated."""
    return reduce(DataFrame.unionByName, parts)


def merged_summary(summaries: DataFrame) -> DataFrame:
    """summaries(file_count, avg_risk, high, medium, low) added up; the mean is weighted by files."""
    total = F.sum("file_count")
    mean = F.when(total > 0, F.sum(F.col("avg_risk") * F.col("file_count")) / total).otherwise(0.0)
    return summaries.agg(total.alias("file_count"), mean.alias("avg_risk"), *(F.sum(c).alias(c) for c in ("high", "medium", "low")))


def distinct_dependencies(files: DataFrame) -> DataFrame:
    """files(deps array) to the sorted distinct names, as rows."""
    return files.select(F.explode("deps").alias("name")).distinct()


def base_metrics(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("total_lines"), F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_set("language")).alias("languages"))


def tally(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def dashboard_slice(deps: DataFrame, files: DataFrame, n: int = 20, fallback: int = 10) -> DataFrame:
    """The first edges with ids fit for a diagram; without edges the first high-risk files."""
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    if not deps.isEmpty():
        return deps.orderBy("src", "dst").limit(n).select(clean("src").alias("src"), clean("dst").alias("dst"))
    return files.where("level = 'high'").orderBy("ord").limit(fallback).select(clean("path").alias("src"), F.lit(None).cast("string").alias("dst"))


def fails_on_high(files: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: whether any issue is an error or high, or any file is high."""
    bad = issues.where(F.col("severity").isin("error", "high")).limit(1).select(F.lit(1).alias("x")).unionByName(files.where("level = 'high'").limit(1).select(F.lit(1).alias("x")))
    return bad.agg((F.count(F.lit(1)) > 0).alias("failed"))
