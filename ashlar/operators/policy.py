"""Policies as data, compiled to columns; gates for continuous integration."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

OPERATORS = ("==", "!=", ">", "<", ">=", "<=", "in", "not in")


@dataclass(frozen=True)
class Rule:
    id: str
    conditions: tuple[tuple[str, str, object], ...]
    actions: tuple[str, ...] = ("warn",)
    scope: str = "project"


@dataclass
class PolicySet:
    rules: list[Rule] = field(default_factory=list)


def policy_set(document: dict) -> PolicySet:
    """A parsed document to rules; raises on an operator that isn't one of the eight."""
    rules = []
    for rule in document.get("rules", []):
        conditions = tuple((c["field"], c.get("operator", c.get("op")), c["value"]) for c in rule.get("conditions", []))
        if wrong := [op for _, op, _ in conditions if op not in OPERATORS]:
            raise ValueError(f"unknown operator {wrong[0]}")
        rules.append(Rule(rule["id"], conditions, tuple(a["type"] if isinstance(a, dict) else a for a in rule.get("actions", [])), rule.get("scope", "project")))
    return PolicySet(rules)


def read_policy(path: str) -> PolicySet:
    """YAML or TOML by the file's ending."""
    text = Path(path).read_text()
    if path.endswith(".toml"):
        import tomllib

        return policy_set(tomllib.loads(text))
    import yaml

    return policy_set(yaml.safe_load(text))


def condition(context: DataFrame, name: str, op: str, value: object) -> Column:
    """A predicate that is never null; an unknown field isn't met. in and not in on an array ask whether any element is."""
    if name not in context.columns:
        return F.lit(False)
    column = F.col(name)
    if op in ("in", "not in"):
        array = isinstance(context.schema[name].dataType, ArrayType)
        found = F.arrays_overlap(column, F.array(*map(F.lit, value))) if array else column.isin(*value)
        found = ~found if op == "not in" else found
    else:
        b = F.lit(value)
        found = {"==": column == b, "!=": column != b, ">": column > b, "<": column < b, ">=": column >= b, "<=": column <= b}[op]
    return F.coalesce(found, F.lit(False))


def decisions(context: DataFrame, policies: PolicySet) -> DataFrame:
    """context's rows against project rules: (*context, rule, severity), a row for each rule whose conditions all hold."""
    hits = []
    for rule in policies.rules:
        if rule.scope != "project":
            continue
        met = reduce(lambda a, b: a & b, (condition(context, *c) for c in rule.conditions), F.lit(True))
        severity = "error" if "suggest_block_ci" in rule.actions else "warning"
        hits.append(F.when(met, F.struct(F.lit(rule.id).alias("rule"), F.lit(severity).alias("severity"))))
    kind = "array<struct<rule:string,severity:string>>"
    found = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast(kind)
    return context.withColumn("hit", F.explode(found)).select(*context.columns, "hit.rule", "hit.severity")


def gate(report: DataFrame, most_errors: int = 0, most_high: int = -1) -> DataFrame:
    """report(error_issues, high_risk_files, has_regression, error_decisions) with passed and reasons; a negative bound is
    none, a regression only adds a reason."""
    high = (F.col("high_risk_files") > most_high) & F.lit(most_high >= 0)
    fails = (F.col("error_issues") > most_errors) | high | (F.col("error_decisions") > 0)
    reasons = F.array(F.when(F.col("error_issues") > most_errors, "errors"), F.when(high, "high_risk_files"), F.when(F.col("has_regression"), "regression"), F.when(F.col("error_decisions") > 0, "policy"))
    return report.select("*", (~fails).alias("passed"), F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


#: Kinds of failure and the words that tell them, the first that fits counts. Fixed values.
FAILURES = (
    ("transient", ("timeout", "network")),
    ("contextual", ("anchor not found", "fuzzy match failed")),
    ("validation", ("test failed", "validation failed")),
    ("conflict", ("merge conflict",)),
)


def failure_kind(error: Column) -> Column:
    low, kind = F.lower(error), F.lit("unknown")
    for name, words in reversed(FAILURES):
        kind = F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), name).otherwise(kind)
    return kind
