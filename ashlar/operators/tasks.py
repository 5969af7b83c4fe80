"""Remediation tasks: building, quotas, grouping, selection, budgets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.plans.common import checkpointed, stored

PER_FILE, PER_RULE = 10, 50
RANKS = {"low": 1, "medium": 2, "high": 3, "unknown": 0}


def priority(severity: Column, level: Column) -> Column:
    error = F.when(level == "high", 1).when(level == "medium", 2).otherwise(3)
    warning = F.when(level == "high", 2).when(level == "medium", 3).otherwise(4)
    return F.when(severity == "error", error).when(severity == "warning", warning).otherwise(5)


def issue_tasks(files: DataFrame, issues: DataFrame) -> DataFrame:
    """A task for each issue of a known file: (id, project, path, language, rule_id, priority, risk_level, status, ord)."""
    known = files.select("path", "project", "language", F.coalesce("level", F.lit("unknown")).alias("risk_level"))
    joined = issues.select("id", "path", "rule_id", "severity", "ord").join(known, "path")
    return joined.select("id", "project", "path", "language", "rule_id", priority(F.col("severity"), F.col("risk_level")).alias("priority"), "risk_level", F.lit("pending").alias("status"), "ord")


def within_quotas(tasks: DataFrame, per_file: int = PER_FILE, per_rule: int = PER_RULE) -> DataFrame:
    """Of each project's tasks by (priority, ord), those that find both their file and their rule below its quota; a task
    that is turned away uses neither up, so the choice depends on all before it.

    Decided in rounds over all projects at once. Among the tasks that are still open, one is taken if, even should all open
    ones before it be taken, its file and its rule have room; one is turned away once its file or its rule is full. Both
    are what reading in order would decide, and the first open task is always taken. Only the first per_file of a file and
    per_rule of a rule are ranked in a round, each task of Spark cutting its own beforehand, so no file, rule or project
    has to be sorted in one place. Null files and rules are each one; ties of (priority, ord) are broken in any one way.
    """
    fields, key = tasks.columns, "__task"
    place = F.struct("priority", "ord", key)
    open_, _ = stored(tasks.select("*", F.monotonically_increasing_id().alias(key)), "open")
    taken = None
    while True:
        first = open_
        for column, quota in (("path", per_file), ("rule_id", per_rule)):
            used = None if taken is None else taken.groupBy("project", column).agg(F.count(F.lit(1)).alias("used"))
            ranked = open_.select("project", column, key, F.row_number().over(Window.partitionBy("project", column).orderBy(place)).alias("rank")).where(F.col("rank") <= quota)
            if used is not None:
                same = [ranked[c].eqNullSafe(used[c]) for c in ("project", column)]
                ranked = ranked.join(used, same, "left").where(F.col("rank") + F.coalesce("used", F.lit(0)) <= quota).select(key)
            first = first.join(ranked.select(key), key, "left_semi")
        fresh, n = stored(first, "taken")
        if not n:
            return (fresh if taken is None else taken).select(*fields)
        taken = fresh if taken is None else taken.unionByName(fresh)
        open_ = open_.join(fresh.select(key), key, "left_anti")
        for column, quota in (("path", per_file), ("rule_id", per_rule)):
            full = taken.groupBy("project", column).agg(F.count(F.lit(1)).alias("used")).where(F.col("used") >= quota)
            open_ = open_.join(full, [open_[c].eqNullSafe(full[c]) for c in ("project", column)], "left_anti")
        open_, _ = stored(open_, "open")


def grouped(tasks: DataFrame, by: str = "rule_id") -> DataFrame:
    """Groups by rule, file or level with their tasks in order, the group with the best priority first."""
    order = F.sort_array(F.collect_list(F.struct("priority", "ord", "id")))
    return tasks.groupBy("project", by).agg(order.alias("tasks"), F.min("priority").alias("best"), F.count(F.lit(1)).alias("n")).orderBy("project", "best", by)


def flattened(groups: DataFrame) -> DataFrame:
    return groups.select("project", F.explode("tasks").alias("task")).select("project", "task.*")


def task_summary(tasks: DataFrame) -> DataFrame:
    """(kind, key, n) by priority, language and level; one pass by grouping sets."""
    named = tasks.select(F.col("priority").cast("string").alias("priority"), "language", "risk_level")
    sets = named.groupingSets([["priority"], ["language"], ["risk_level"]], "priority", "language", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "priority").when(F.col("g") == 5, "language").otherwise("risk_level")
    return sets.select(kind.alias("kind"), F.coalesce("priority", "language", "risk_level").alias("key"), "n")


def selected(tasks: DataFrame, languages: list[str] | None = None, rules: list[str] | None = None, least_level: str | None = None, limit: int | None = None) -> DataFrame:
    """Levels rank low 1, medium 2, high 3 and anything else 0."""
    if languages:
        tasks = tasks.where(F.col("language").isin(languages))
    if rules:
        tasks = tasks.where(F.col("rule_id").isin(rules))
    if least_level:
        rank = F.coalesce(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[F.col("risk_level")], F.lit(0))
        tasks = tasks.where(rank >= RANKS.get(least_level, 0))
    ordered = tasks.orderBy("priority", "ord")
    return ordered.limit(limit) if limit else ordered


def suggestion_quota(issues: DataFrame, severities: list[str], per_file: int = 10, per_run: int = 100) -> DataFrame:
    """The first issues of each file, and of those the first of the run, all calls taken to succeed."""
    own = F.row_number().over(Window.partitionBy("path").orderBy("ord"))
    return issues.where(F.col("severity").isin(severities)).withColumn("place", own).where(F.col("place") <= per_file).orderBy("ord").limit(per_run).drop("place")


def strategy(score: Column, focal: Column) -> Column:
    return F.when(focal | (score >= 0.7), "full").when(score >= 0.3, "skeleton").otherwise("signature")


def budget_allocation(files: DataFrame, budget: int) -> DataFrame:
    """files(project, path, score, ord, signature_cost, skeleton_cost, full_cost) with a strategy each, by the score.

    All begin as signatures. A first pass lifts files to skeletons where the rest of the budget allows, a second one
    skeletons to full; a file that doesn't fit is passed over. What is left depends on all files before, so a project is
    one sequence, by task; it streams in order, and only what is left is kept.
    """
    spent = files.groupBy("project").agg((F.lit(budget) - F.sum("signature_cost")).cast("long").alias("left"))
    start = files.select("project", "path", "score", "ord", *[F.col(f"{k}_cost").cast("long").alias(k) for k in ("signature", "skeleton", "full")])
    first = _lifted(start.withColumn("strategy", F.lit("signature")).join(spent, "project"), "signature", "skeleton")
    first = checkpointed(first)
    rest = first.groupBy("project").agg(F.min("left").alias("left"))  # it never grows
    return _lifted(first.drop("left").join(rest, "project"), "skeleton", "full").select("project", "path", "strategy")


def _lifted(files: DataFrame, before: str, better: str) -> DataFrame:
    """files whose strategy is before get the better one, in order, as far as left allows; left is what remains then."""
    schema = files.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, left = object(), 0
        for batch in batches:
            batch = batch.reset_index(drop=True)
            kinds, rest = batch["strategy"].tolist(), []
            for i, (own, at_first, cost) in enumerate(zip(batch["project"], batch["left"], batch[better] - batch[before])):
                if own != project:
                    project, left = own, int(at_first)
                if kinds[i] == before and cost <= left:
                    kinds[i], left = better, left - int(cost)
                rest.append(left)
            yield batch.assign(strategy=kinds, left=rest)

    ordered = files.repartition("project").sortWithinPartitions("project", F.col("score").desc(), "ord")
    return ordered.mapInPandas(run, schema)


def context_window(parts: DataFrame, budget: int, header: int = 0) -> DataFrame:
    """parts(project, ord, text, cost) in order until the budget: whole ones while they fit; the first that doesn't is cut
    to three characters for each token left if over 50 are, and ends the window."""
    before = Window.partitionBy("project").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget - header) - F.coalesce(F.sum("cost").over(before), F.lit(0))
    found = parts.withColumn("left", left).where("left >= 0").withColumn("whole", F.col("cost") <= F.col("left"))
    kept = found.where(F.col("whole") | (F.col("left") > 50))
    return kept.select("project", "ord", F.when(F.col("whole"), F.col("text")).otherwise(F.expr("left(text, CAST(left * 3 AS INT))")).alias("text"), "whole")


def token_cost(text: Column) -> Column:
    """A token for four characters, rounded up; functions.tokens.token_count counts real ones."""
    return F.ceil(F.length(text) / 4).cast("long")
