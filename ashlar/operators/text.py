"""Text operators: context windows, prompts, fuzzy anchors, suggestions, text diffs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context_lines(content: Column, line: Column, size: int, from_line: bool = False) -> Column:
    """Lines around line, counted from 1: size / 2 before it up to size / 2 behind it; from_line leaves out the first one."""
    lines, half = F.split(content, "\n"), size // 2
    start = F.greatest(line - half + int(from_line), F.lit(1))
    end = F.least(F.size(lines), line + half)
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")


def rendered(template: Column, values: dict[str, Column], most_lines: int | None = None) -> Column:
    """{name} replaced, runs of blank lines squeezed, ends trimmed, cut to most_lines."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{%s}" % name), F.coalesce(value.cast("string"), F.lit("")))
    text = F.regexp_replace(F.regexp_replace(template, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.array_join(F.slice(F.split(text, "\n"), 1, most_lines), "\n") if most_lines else text


def with_template(tasks: DataFrame, templates: DataFrame) -> DataFrame:
    """templates(language, rule_id, template): the one of language and rule, else the language's own (rule_id null)."""
    exact = templates.where("rule_id IS NOT NULL").select("language", "rule_id", F.col("template").alias("exact"))
    default = templates.where("rule_id IS NULL").select("language", F.col("template").alias("fallback"))
    joined = tasks.join(F.broadcast(exact), ["language", "rule_id"], "left").join(F.broadcast(default), "language", "left")  # a written catalogue
    return joined.withColumn("template", F.coalesce("exact", "fallback")).drop("exact", "fallback")


def best_anchor(wanted: DataFrame, candidates: DataFrame, least: float = 0.75) -> DataFrame:
    """wanted(path, name, anchor), candidates(path, name, anchor, ord) to (path, name, found): the only candidate of the
    name, else the most similar anchor of the file if its ratio is over least."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])

    named = wanted.join(candidates.select("path", "name", F.col("anchor").alias("found")), ["path", "name"]).groupBy("path", "name").agg(F.first("found").alias("found"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    rest = wanted.join(named, ["path", "name"], "left_anti")
    pairs = rest.join(candidates.select("path", F.col("anchor").alias("other"), "ord"), "path").withColumn("ratio", ratio("anchor", "other")).where(F.col("ratio") > least)
    best = pairs.groupBy("path", "name").agg(F.max_by("other", F.struct("ratio", -F.col("ord"))).alias("found"))
    return named.unionByName(best)


def code_block(text: Column, language: str) -> Column:
    """The first fenced block of the language, else the first of any."""
    own = F.regexp_extract(text, rf"(?s)```{language}[ \t]*\n(.*?)```", 1)
    other = F.regexp_extract(text, r"(?s)```[^\n]*\n(.*?)```", 1)
    return F.nullif(F.when(own != "", own).otherwise(other), F.lit(""))


def suggestion(text: Column, language: str, confidence: float = 0.8) -> Column:
    """struct(code, explanation, confidence): explanation is what follows the last fence."""
    pieces = F.split(text, "```")
    tail = F.when(F.size(pieces) > 1, F.trim(F.element_at(pieces, -1)))
    return F.struct(code_block(text, language).alias("code"), tail.alias("explanation"), F.lit(confidence).alias("confidence"))


def replace_block(content: str, header: str, replacement: str, least: float = 0.6) -> str | None:
    """content with the indented block under the line most like header replaced, if it's alike enough."""
    lines = content.split("\n")
    scored = [(difflib.SequenceMatcher(None, line.strip(), header.strip()).ratio(), -i) for i, line in enumerate(lines) if line.strip()]
    if not scored or max(scored)[0] <= least:
        return None
    at = -max(scored)[1]
    indent = len(lines[at]) - len(lines[at].lstrip())
    end = at + 1
    while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > indent):
        end += 1
    return "\n".join([*lines[:at], *replacement.split("\n"), *lines[end:]])


def block_replaced(edits: DataFrame) -> DataFrame:
    """edits(path, content, header, replacement) with the new content, null where no block is alike enough."""

    @F.pandas_udf("string")
    def apply(content: pd.Series, header: pd.Series, replacement: pd.Series) -> pd.Series:
        return pd.Series([replace_block(*row) for row in zip(content, header, replacement)], dtype=object)

    return edits.withColumn("content", apply("content", "header", "replacement"))


def text_diff(pairs: DataFrame) -> DataFrame:
    """pairs(path, old, new) with a unified diff."""

    @F.pandas_udf("string")
    def unified(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "old", "new", lineterm="")) for a, b in zip(old, new)])

    return pairs.select("path", unified("old", "new").alias("diff"))


def is_python(files: DataFrame) -> DataFrame:
    """Whether each content parses."""
    import ast

    @F.pandas_udf("boolean")
    def parses(content: pd.Series) -> pd.Series:
        def ok(text: str) -> bool:
            try:
                ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError):
                return False
            return True

        return content.map(ok)

    return files.select("path", parses("content").alias("parses"))
