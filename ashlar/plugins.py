"""Plugins: rules and analyzers from files, as table functions and DataFrame functions."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult, PartitioningColumn

from ashlar.operators.rules import plugin_severity

ISSUE = "path string, rule_id string, severity string, line int, message string"
#: check(path, content, context) gives (severity, line, message) rows.
Check = Callable[[str, str, dict], list[tuple[str, int, str]]]


@dataclass
class Registry:
    rules: dict[str, Check] = field(default_factory=dict)
    analyzers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def rule(self, name: str, check: Check) -> None:
        self.rules[name] = check

    def analyzer(self, name: str, apply: Callable[[DataFrame], DataFrame]) -> None:
        self.analyzers[name] = apply

    def load(self, folder: str) -> Registry:
        """Runs register(registry) of each module in folder, or of its Plugin class; one that fails is noted and skipped."""
        for path in sorted(Path(folder).glob("*.py")):
            spec = importlib.util.spec_from_file_location(path.stem, path)
            module = importlib.util.module_from_spec(spec)
            try:
                spec.loader.exec_module(module)
                (module.Plugin() if hasattr(module, "Plugin") else module).register(self)
            except Exception as problem:  # a plugin may fail in any way
                self.errors[path.stem] = repr(problem)
        return self


def run_rules(files: DataFrame, registry: Registry, context: dict | None = None) -> DataFrame:
    """files(path, content) to issues, all rules in one pass over the contents."""
    rules, context = dict(registry.rules), context or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, name, *found) for path, content in zip(batch["path"], batch["content"]) for name, check in rules.items() for found in check(path, content or "", context)]
            yield pd.DataFrame(rows, columns=["path", "rule_id", "severity", "line", "message"])

    issues = files.select("path", "content").mapInPandas(run, ISSUE)
    return issues.withColumn("severity", plugin_severity(issues["severity"]))


def as_table_function(spark: SparkSession, name: str, check: Check) -> None:
    """check as a SQL table function: SELECT ... FROM files, LATERAL name(path, content)."""

    class Rule:
        def eval(self, path: str, content: str):
            for severity, line, message in check(path, content or "", {}):
                yield severity, line, message

    spark.udtf.register(name, udtf(Rule, returnType="severity string, line int, message string"))


def flat_schema(columns: str) -> StructType:
    """"name type, ..." of plain types; where an analyzer's schema is asked for there is no session to parse it."""
    kinds = {"string": StringType, "int": IntegerType, "long": LongType, "double": DoubleType, "boolean": BooleanType}
    pairs = [column.split() for column in columns.split(",")]
    return StructType([StructField(name, kinds[kind]()) for name, kind in pairs])


def as_file_function(spark: SparkSession, name: str, analyzer) -> None:
    """An analyzer of files as a table function over a table: SELECT * FROM name(TABLE(rows), option => value, ...).

    rows has a path. Spark deals rows out by path and gives the analyzer one file at a time: analyzer.schema(**options)
    names the columns (of plain types), which so may depend on the options, and analyzer.analyze(path, rows, **options) gives tuples of them
    for a file's rows. Rows without path are one file; a table without rows gives none.
    """

    class OfFile:
        @staticmethod
        def analyze(rows, **options):
            return AnalyzeResult(flat_schema(analyzer.schema(**{k: v.value for k, v in options.items()})), partitionBy=[PartitioningColumn("path")])

        def __init__(self):
            self.rows, self.options = [], {}

        def eval(self, rows, **options):
            self.rows.append(rows)
            self.options = options

        def terminate(self):
            if self.rows:
                yield from analyzer.analyze(self.rows[0]["path"], self.rows, **self.options)

    spark.udtf.register(name, udtf(OfFile))


class PatternRule:
    """A pattern over the facts of a file, for as_file_function: found(rows, **options) gives (subject, confidence) pairs.
    explain => true adds a column that says how many facts were looked at."""

    def __init__(self, kind: str, found: Callable[..., list[tuple[str, float]]]):
        self.kind, self.found = kind, found

    def schema(self, explain: bool = False, **_) -> str:
        return "path string, kind string, subject string, confidence double" + (", facts int" if explain else "")

    def analyze(self, path: str, rows: list, explain: bool = False, **options) -> Iterator[tuple]:
        for subject, confidence in self.found(rows, **options):
            yield (path, self.kind, subject, float(confidence), *([len(rows)] if explain else []))


def run_analyzers(files: DataFrame, registry: Registry) -> dict[str, DataFrame]:
    return {name: files.transform(apply) for name, apply in registry.analyzers.items()}
