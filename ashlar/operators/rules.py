"""Rules: tables of facts to issues (path, rule_id, severity, line, symbol, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.operators.content import exploded
from ashlar.operators.report import issue_summary

COLUMNS = "path string, rule_id string, severity string, line int, symbol string, message string"
CONFIG, SNAKE, CAMEL = r"timeout|retries|limit|threshold", r"^[a-z0-9]+(_[a-z0-9]+)+$", r"^[a-z]+[a-z0-9]*[A-Z]"


def issue(df: DataFrame, rule: str, severity: str, line: Column | None = None, symbol: Column | None = None, message: Column | None = None) -> DataFrame:
    none = F.lit(None)
    value = lambda c, kind: (none if c is None else c).cast(kind)
    return df.select("path", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), value(line, "int").alias("line"), value(symbol, "string").alias("symbol"), F.coalesce(value(message, "string"), F.lit(rule)).alias("message"))


# Metric rules

def high_complexity(functions: DataFrame, most: int = 10) -> DataFrame:
    return issue(functions.where(F.col("complexity") > most), "high-cyclomatic-function", "warning", F.col("line_start"), F.col("name"))


def high_fan_out(metrics: DataFrame, most: int = 15) -> DataFrame:
    return issue(metrics.where(F.col("fan_out") > most), "high-fan-out", "warning")


def large_file(metrics: DataFrame, most: int = 500) -> DataFrame:
    return issue(metrics.where(F.col("lines_of_code") > most), "large-file", "info")


def missing_return_hint(functions: DataFrame) -> DataFrame:
    return issue(functions.where("return_type IS NULL AND NOT startswith(name, '_')"), "missing-return-hint", "info", F.col("line_start"), F.col("name"))


def baseline(functions: DataFrame, metrics: DataFrame, complexity: bool = True, fan_out: bool = True, size: bool = True, hints: bool = False) -> list[DataFrame]:
    """The rules that the switches choose."""
    chosen = [(complexity, lambda: high_complexity(functions)), (fan_out, lambda: high_fan_out(metrics)), (size, lambda: large_file(metrics)), (hints, lambda: missing_return_hint(functions))]
    return [rule() for on, rule in chosen if on]


# Source rules

def empty_handler(facts: DataFrame) -> DataFrame:
    """A handler whose only statement is pass."""
    return issue(exploded(facts, "handlers").where("only_pass"), "001", "error", F.col("line"))


def hardcoded_config(facts: DataFrame) -> DataFrame:
    return issue(exploded(facts, "constants").where((F.col("kind") == "number") & F.rlike(F.lower("name"), F.lit(CONFIG))), "002", "warning", F.col("line"), F.col("name"))


def mixed_naming(functions: DataFrame) -> DataFrame:
    public = functions.where("NOT startswith(name, '_')")
    both = public.groupBy("path").agg(F.count_if(F.rlike("name", F.lit(SNAKE))).alias("snake"), F.count_if(F.rlike("name", F.lit(CAMEL))).alias("camel"))
    return issue(both.where("snake > 0 AND camel > 0"), "003", "info", F.lit(1))


def long_function(functions: DataFrame, most: int = 50) -> DataFrame:
    return issue(functions.where((F.col("line_end") - F.col("line_start") > most) & ~F.col("is_async")), "004", "warning", F.col("line_start"), F.col("name"))


def leftover(files: DataFrame, needle: str = "TODO") -> DataFrame:
    """Each line, of any language, that holds needle."""
    lines = files.where(F.contains("content", F.lit(needle))).select("path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "text")).where(F.contains("text", F.lit(needle)))
    return issue(lines, "005", "info", F.col("at") + 1)


def hardcoded_path(facts: DataFrame) -> DataFrame:
    strings = exploded(facts, "constants").where("kind = 'string' AND length(value) > 3")
    return issue(strings.where(F.startswith("value", F.lit("/")) | F.contains("value", F.lit("C:\\"))), "006", "warning", F.col("line"))


def prints(facts: DataFrame) -> DataFrame:
    return issue(exploded(facts, "constants").where("kind = 'print'"), "007", "info", F.col("line"))


def broad_except(facts: DataFrame) -> DataFrame:
    return issue(exploded(facts, "handlers").where("(kind IS NULL OR kind = 'Exception') AND NOT raises"), "008", "warning", F.col("line"))


def placeholder(functions: DataFrame) -> DataFrame:
    return issue(functions.where("only_pass"), "009", "info", F.col("line_start"), F.col("name"))


def missing_docstring(functions: DataFrame) -> DataFrame:
    return issue(functions.where("NOT docstring AND NOT is_async AND NOT startswith(name, '_')"), "010", "info", F.col("line_start"), F.col("name"))


def source_rules(files: DataFrame, facts: DataFrame) -> list[DataFrame]:
    functions = exploded(facts, "functions")
    return [
        empty_handler(facts), hardcoded_config(facts), mixed_naming(functions), long_function(functions), leftover(files),
        hardcoded_path(facts), prints(facts), broad_except(facts), placeholder(functions), missing_docstring(functions),
    ]


def source_issues(files: DataFrame, facts: DataFrame, most: int = 50) -> DataFrame:
    """What source_rules find, in one pass over facts with functions, handlers and constants: each file's issues are made from
    its own arrays, where ten rules apart would parse it ten times. mixed_naming is by row of facts."""
    none = F.lit(None)

    def found(array, keep, rule, severity, line=lambda x: x["line"], symbol=lambda x: none):
        value = lambda x: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), line(x).cast("int").alias("line"), symbol(x).cast("string").alias("symbol"), F.lit(rule).alias("message"))
        return F.transform(F.filter(array, keep), value)

    public = lambda f: ~F.startswith(f["name"], F.lit("_"))
    like = lambda pattern: F.exists("functions", lambda f: public(f) & F.rlike(f["name"], F.lit(pattern)))
    of_function = (lambda f: f["line_start"], lambda f: f["name"])
    mixed = F.when(like(SNAKE) & like(CAMEL), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    path = lambda x: (x["kind"] == "string") & (F.length(x["value"]) > 3) & (F.startswith(x["value"], F.lit("/")) | F.contains(x["value"], F.lit("C:\\")))
    every = F.concat(
        found("handlers", lambda x: x["only_pass"], "001", "error"),
        found("constants", lambda x: (x["kind"] == "number") & F.rlike(F.lower(x["name"]), F.lit(CONFIG)), "002", "warning", symbol=lambda x: x["name"]),
        found(mixed, lambda x: F.lit(True), "003", "info", lambda x: x),
        found("functions", lambda f: (f["line_end"] - f["line_start"] > most) & ~f["is_async"], "004", "warning", *of_function),
        found("constants", path, "006", "warning"),
        found("constants", lambda x: x["kind"] == "print", "007", "info"),
        found("handlers", lambda x: (x["kind"].isNull() | (x["kind"] == "Exception")) & ~x["raises"], "008", "warning"),
        found("functions", lambda f: f["only_pass"], "009", "info", *of_function),
        found("functions", lambda f: ~f["docstring"] & ~f["is_async"] & public(f), "010", "info", *of_function),
    )
    return facts.select("path", F.explode(every).alias("x")).select("path", "x.*").unionByName(leftover(files))


def run_rules(rules: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All issues, which replace those before, and their summary."""
    issues = reduce(DataFrame.unionByName, rules)
    return issues, issue_summary(issues)


def plugin_severity(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low.isin("info", "warning", "error"), low).when(low == "high", "error").when(low == "low", "info").otherwise("warning")
