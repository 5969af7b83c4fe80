"""Snapshot diffs, trends, regressions and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def project_diff(old_files, new_files, old_issues, new_issues) -> DataFrame:
    """One row of changes, new less old; only the level high itself counts as high."""
    def side(files: DataFrame, issues: DataFrame, sign: int) -> DataFrame:
        f = files.select(F.when(F.col("level") == "high", sign).otherwise(0).alias("high"), F.lit(0).alias("issues"), F.lit(0).alias("errors"))
        i = issues.select(F.lit(0).alias("high"), F.lit(sign).alias("issues"), F.when(F.col("severity") == "error", sign).otherwise(0).alias("errors"))
        return f.unionByName(i)

    both = side(new_files, new_issues, 1).unionByName(side(old_files, old_issues, -1))
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_delta") for c in ("high", "issues", "errors")))


def file_diff(old_files, new_files, old_issues, new_issues) -> DataFrame:
    """(path, status, score_delta, added, resolved): a full outer join on the path. A file is modified if its level or
    its set of issue ids changed; a change of score alone leaves it unchanged."""
    state = lambda files, side: files.select("path", F.col("score").alias(f"{side}_score"), F.col("level").alias(f"{side}_level"))
    marks = old_issues.select("path", "id").distinct().withColumn("was", F.lit(True)).join(new_issues.select("path", "id").distinct().withColumn("now", F.lit(True)), ["path", "id"], "full_outer")
    changed = marks.groupBy("path").agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("resolved"))
    both = state(old_files, "old").join(state(new_files, "new"), "path", "full_outer").join(changed, "path", "left")
    added, resolved = (F.coalesce(c, F.lit(0)) for c in ("added", "resolved"))
    status = F.when(F.col("old_level").isNull(), "added").when(F.col("new_level").isNull(), "removed").when((F.col("old_level") != F.col("new_level")) | (added > 0) | (resolved > 0), "modified").otherwise("unchanged")
    delta = F.coalesce("new_score", F.lit(0.0)) - F.coalesce("old_score", F.lit(0.0))
    return both.select("path", status.alias("status"), delta.alias("score_delta"), added.alias("added"), resolved.alias("resolved"))


def structural_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new (path, hash, cyclomatic) to (path, status, cyclomatic_delta); files with equal hashes aren't listed."""
    both = old.select("path", F.struct("hash", "cyclomatic").alias("was")).join(new.select("path", F.struct("hash", "cyclomatic").alias("now")), "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was.hash").eqNullSafe(F.col("now.hash")), "modified")
    return both.select("path", status.alias("status"), F.when(status == "modified", F.col("now.cyclomatic") - F.col("was.cyclomatic")).alias("cyclomatic_delta")).where("status IS NOT NULL")


def dependency_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, src, dst) over distinct edges."""
    pairs = lambda df: df.select("src", "dst")
    return pairs(new).subtract(pairs(old)).select(F.lit("added").alias("op"), "src", "dst").unionByName(pairs(old).subtract(pairs(new)).select(F.lit("removed").alias("op"), "src", "dst"))


def regressions(diff: DataFrame, most_high: int = 5, most_errors: int = 10) -> DataFrame:
    """project_diff's row to warnings: (kind, severity, delta)."""
    found = F.array(
        F.when(F.col("high_delta") > most_high, F.struct(F.lit("high_risk_files").alias("kind"), F.lit("warning").alias("severity"), F.col("high_delta").alias("delta"))),
        F.when(F.col("errors_delta") > most_errors, F.struct(F.lit("error_issues").alias("kind"), F.lit("error").alias("severity"), F.col("errors_delta").alias("delta"))),
    )
    return diff.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.*")


def trend(points: DataFrame, key: str = "day") -> DataFrame:
    """points(project, key, high, issues, errors) in order of time, with the change since the point before."""
    before = Window.partitionBy("project").orderBy(key)
    return points.select("project", key, "high", "issues", "errors", *((F.col(c) - F.lag(c).over(before)).alias(f"{c}_change") for c in ("high", "issues", "errors")))


def latest(points: DataFrame, n: int = 1, key: str = "day") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.col(key).desc()))
    return points.withColumn("rank", rank).where(F.col("rank") <= n)


def last_two(points: DataFrame, key: str = "day") -> DataFrame:
    """Projects with two points or more: whether high-risk files or errors rose at the last one."""
    two = latest(points, 2, key).groupBy("project").agg(*(F.max_by(c, key).alias(c) for c in ("high", "errors")), *(F.min_by(c, key).alias(f"{c}_before") for c in ("high", "errors")), F.count(F.lit(1)).alias("n"))
    rose = (F.col("high") > F.col("high_before")) | (F.col("errors") > F.col("errors_before"))
    return two.where("n = 2").select("project", "high", "high_before", "errors", "errors_before", rose.alias("regressed"))


def retention(versions: DataFrame, now: str, days: int = 30, most: int = 10) -> DataFrame:
    """versions(project, version, timestamp string) with keep: not older than days and among the most newest of those.
    A timestamp that can't be read has expired; one without a zone is UTC."""
    ts = F.try_to_timestamp("timestamp")
    fresh = F.coalesce(ts >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("project", "fresh").orderBy(F.col("ts").desc(), F.col("number").desc()))
    marked = versions.withColumn("ts", ts).withColumn("fresh", fresh).withColumn("number", F.regexp_extract("version", r"(\d+)", 1).try_cast("int"))
    return marked.withColumn("rank", rank).select("project", "version", (F.col("fresh") & (F.col("rank") <= most)).alias("keep"))


def next_version(versions: DataFrame) -> DataFrame:
    """(project, next): one more than the largest vN."""
    return versions.groupBy("project").agg(F.concat(F.lit("v"), (F.coalesce(F.max(F.regexp_extract("version", r"^v(\d+)$", 1).try_cast("int")), F.lit(0)) + 1).cast("string")).alias("next"))
