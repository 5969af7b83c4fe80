"""Risk scores of files, their propagation along dependencies, project health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.plans.common import checkpointed
from ashlar.schema import half_up

#: Weights, and the values at which each part is full. Fixed values.
WEIGHTS = {"complexity": 0.30, "churn": 0.25, "coverage": 0.25, "authors": 0.10, "size": 0.10}
SCALES = {"complexity": 10.0, "churn": 10.0, "coverage": 10.0, "authors": 5.0, "size": 1000.0}
HIGH, MEDIUM, CRITICAL, LIFT_FROM, LIFT_TO = 0.7, 0.4, 0.9, 0.7, 0.75


def static_score(max_complexity: Column, avg_complexity: Column, fan_out: Column) -> Column:
    """0 to 10."""
    capped = lambda c, top: F.least(F.coalesce(c, F.lit(0)).cast("double"), F.lit(float(top)))
    return 0.5 * capped(max_complexity, 20) / 2.0 + 0.3 * capped(avg_complexity, 10) + 0.2 * capped(fan_out, 20) / 2.0


def coverage_risk(rate: Column, reported: bool = True) -> Column:
    """Without a report 0; a file that the report lacks is 10."""
    return F.coalesce((1.0 - rate) * 10.0, F.lit(10.0)) if reported else F.lit(0.0)


def churn_score(commits: Column, days: int = 90) -> Column:
    return half_up(F.least(F.lit(10.0), commits / max(days / 30.0, 1.0)))


def level_of(score: Column, critical: bool = False) -> Column:
    level = F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")
    return F.when(score >= CRITICAL, "critical").otherwise(level) if critical else level


def weighted_risk(files: DataFrame, reported: bool = True) -> DataFrame:
    """files(path, lines_of_code, max_complexity, avg_complexity, fan_out, churn, coverage, authors) with score (two
    digits), level (from the score before rounding), factors and the parts of the score on a scale of ten."""
    raw = {
        "complexity": static_score(F.col("max_complexity"), F.col("avg_complexity"), F.col("fan_out")),
        "churn": F.coalesce("churn", F.lit(0.0)),
        "coverage": coverage_risk(F.col("coverage"), reported),
        "authors": F.coalesce("authors", F.lit(0)),
        "size": F.coalesce("lines_of_code", F.lit(0)),
    }
    found = files.select("*", *(F.least(value / SCALES[name], F.lit(1.0)).alias(f"norm_{name}") for name, value in raw.items()))
    total = sum(F.lit(weight) * F.col(f"norm_{name}") for name, weight in WEIGHTS.items())
    lifted = F.when(F.col("norm_complexity") > LIFT_FROM, F.greatest(total, F.lit(LIFT_TO))).otherwise(total)
    parts = [half_up(F.col(f"norm_{name}") * 10).alias(f"part_{name}") for name in WEIGHTS]
    found = found.select("*", lifted.alias("full_score"), *parts)
    found = found.withColumn("level", level_of(F.col("full_score"))).withColumn("score", half_up(F.col("full_score")))
    return found.withColumn("factors", factors()).drop("full_score", *(f"norm_{name}" for name in WEIGHTS))


def factors() -> Column:
    tags = [
        (F.col("part_complexity") > 6, "high_complexity"), (F.col("part_complexity") > 6, "high_cyclomatic_complexity"), (F.col("fan_out") > 20, "high_fan_out"),
        (F.col("part_churn") > 6, "high_churn"), (F.col("part_coverage") > 8, "low_coverage"), (F.col("part_authors") > 6, "many_authors"),
        (F.col("part_size") > 8, "large_file"), (F.col("level") == "low", "low_risk"),
    ]
    return F.filter(F.array(*(F.when(condition, tag) for condition, tag in tags)), lambda t: t.isNotNull())


def propagate(deps: DataFrame, base: DataFrame, factor: float = 0.5, rounds: int = 10, epsilon: float = 0.01) -> DataFrame:
    """deps(src, dst) and base(path, score) to (path, score): each round adds to a file's own score factor times those of
    the files it depends on. A new score is taken only if it moves by more than epsilon from the last one taken; rounds
    end when none moves. Repeated dependencies count each time; ends that base lacks don't count."""
    base = checkpointed(base.select("path", F.col("score").alias("own")))
    pairs = deps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    scores = base.select("path", F.col("own").alias("score"))
    for _ in range(rounds):
        gained = pairs.join(scores.withColumnRenamed("path", "dst"), "dst").groupBy(F.col("src").alias("path")).agg(F.sum(F.col("times") * F.col("score") * factor).alias("gain"))
        step = base.join(scores, "path").join(gained, "path", "left").withColumn("next", F.col("own") + F.coalesce("gain", F.lit(0.0)))
        step = checkpointed(step.select("path", "own", F.when(F.abs(F.col("next") - F.col("score")) > epsilon, F.col("next")).otherwise(F.col("score")).alias("score"), (F.abs(F.col("next") - F.col("score")) > epsilon).alias("moved")))
        scores = step.select("path", "score")
        if step.where("moved").isEmpty():
            break
    return scores


def relabel(scored: DataFrame, propagated: DataFrame) -> DataFrame:
    """scored(path, score, factors, ...) after propagation: capped at 1, level anew, tagged where the score rose by over 0.05."""
    joined = scored.join(propagated.select("path", F.col("score").alias("spread")), "path", "left")
    capped = F.least(F.lit(1.0), F.coalesce("spread", "score"))
    joined = joined.withColumn("spread", capped)
    tags = F.when(F.col("spread") > F.col("score") + 0.05, F.concat("factors", F.array(F.lit("risk_propagated")))).otherwise(F.col("factors"))
    return joined.withColumn("factors", tags).withColumn("level", level_of(F.col("spread"), critical=True)).withColumn("score", half_up(F.col("spread"))).drop("spread")


# Version history

def file_history(commits: DataFrame) -> DataFrame:
    """commits(path, author, ts) to (path, commits, authors, last_modified)."""
    return commits.groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("authors"), F.max("ts").alias("last_modified"))


def hotspots(commits: DataFrame, n: int = 10) -> DataFrame:
    return commits.groupBy("path").agg(F.count(F.lit(1)).alias("commits")).orderBy(F.col("commits").desc(), "path").limit(n)


# Coverage

def match_coverage(files: DataFrame, coverage: DataFrame, strict: bool = False) -> DataFrame:
    """files(path), coverage(path, rate, ord) to (path, rate): equal paths, else the first entry of which one path ends in
    the other and whose last names are equal; none gives null, or 0 if strict (and 1 if there is no coverage at all).

    The longer path is cut to each length that the other side's paths of its last name have, and the cut is joined by
    equality: a name that very many paths share (__init__.py) gives a row for each path and length, not for each pair.
    """
    files = files.select("path")
    leaf = lambda c: F.substring_index(c, "/", -1)
    entries = coverage.select(F.col("path").alias("entry"), "rate", "ord")
    equal = files.join(entries.select(F.col("entry").alias("path"), "rate"), "path").groupBy("path").agg(F.max("rate").alias("exact"))
    rest = files.select("path").join(equal, "path", "left_anti").distinct()

    def cut(longer: DataFrame, column: str, shorter: DataFrame, other: str) -> DataFrame:
        lengths = shorter.groupBy(leaf(F.col(other)).alias("leaf")).agg(F.collect_set(F.length(other)).alias("lengths"))
        found = longer.withColumn("leaf", leaf(F.col(column))).join(lengths, "leaf").withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length(column))
        return found.withColumn(other, F.expr(f"right({column}, n)")).drop("leaf", "lengths", "n")

    shorter = cut(rest, "path", entries, "entry").join(entries, "entry").select("path", "rate", "ord")
    longer = cut(entries, "entry", rest, "path").join(rest, "path").select("path", "rate", "ord")
    close = shorter.unionByName(longer).groupBy("path").agg(F.min_by("rate", "ord").alias("close"))
    rate = F.coalesce("exact", "close", F.lit((1.0 if coverage.isEmpty() else 0.0)) if strict else F.lit(None).cast("double"))
    return files.select("path").join(equal, "path", "left").join(close, "path", "left").select("path", rate.alias("rate"))


def uncovered(coverage: DataFrame) -> DataFrame:
    return coverage.where("rate = 0").select("path")


# Projects

def health(projects: DataFrame, per_high: float = 2.0, per_error: float = 0.1, if_regressed: float = 15.0, for_done: float = 10.0) -> DataFrame:
    """projects(project, high_risk_files, errors, regressed, completion, avg_risk) with health (at least 0) and risk_level."""
    regressed = F.coalesce(F.col("regressed").cast("int"), F.lit(0))
    value = F.lit(100.0) - per_high * F.coalesce("high_risk_files", F.lit(0)) - per_error * F.coalesce("errors", F.lit(0)) - if_regressed * regressed + for_done * F.coalesce("completion", F.lit(0.0))
    level = F.when(F.col("avg_risk") > HIGH, "high").when(F.col("avg_risk") > MEDIUM, "medium").otherwise("low")
    return projects.withColumn("health", half_up(F.greatest(F.lit(0.0), value))).withColumn("risk_level", level)


def overview(healthy: DataFrame) -> DataFrame:
    return healthy.agg(F.count(F.lit(1)).alias("projects"), F.count_if("regressed").alias("regressions"), F.coalesce(F.avg("health"), F.lit(0.0)).alias("avg_health"))


def by_health(healthy: DataFrame) -> DataFrame:
    """The worst first."""
    return healthy.orderBy("health", "project")


def risk_histogram(healthy: DataFrame) -> DataFrame:
    """(risk_level, n) with zeros for levels that don't occur."""
    every = healthy.sparkSession.createDataFrame([("high",), ("medium",), ("low",)], "risk_level string")
    counted = healthy.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))


def call_costs(calls: DataFrame) -> DataFrame:
    """calls(cost, latency, success) to totals and means; zeros without calls."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return calls.agg(zero(F.sum("cost")).alias("total_cost"), F.count(F.lit(1)).alias("calls"), zero(F.avg("cost")).alias("avg_cost"), zero(F.avg("latency")).alias("avg_latency"), zero(F.avg(F.col("success").cast("double"))).alias("success_rate"))


def costs_over(calls: DataFrame, threshold: float) -> DataFrame:
    return calls.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost")).where(F.col("total_cost") > threshold)
