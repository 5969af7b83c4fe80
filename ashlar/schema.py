"""Node and edge catalogue, node identifiers, Python-compatible helpers on columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node types with their required and optional properties; edge types with the node types at both ends. Fixed values.
NODE_TYPES = {
    "file": ("path", "language", "loc", "hash"),
    "module": ("name", "version"),
    "function": ("name", "qualified_name", "line_start", "line_end", "complexity", "params", "return_type", "decorators", "docstring", "is_async", "is_generator"),
    "class": ("name", "qualified_name", "line_start", "line_end", "methods", "base_classes", "docstring"),
    "variable": ("name", "qualified_name", "type", "scope", "line_number"),
}
EDGE_TYPES = {
    "contains": (("file", "module", "class"), ("function", "class", "variable")),
    "calls": (("function",), ("function",)),
    "inherits": (("class",), ("class",)),
    "imports": (("file",), ("module", "function", "class")),
    "references": (("function",), ("variable", "function", "class")),
    "defines": (("file",), ("function", "class", "variable")),
}
COMMON = ("id", "type", "name", "qualified_name", "path", "language", "complexity", "loc")


def node_id(kind: Column, qualified: Column, file: Column | None = None) -> Column:
    """type:file:qualified_name; a base of over 200 characters keeps 180 and eight digits of its MD5."""
    base = qualified if file is None else F.concat(file, F.lit(":"), qualified)
    short = F.concat(F.substring(base, 1, 180), F.lit("..."), F.substring(F.md5(base), 1, 8))
    return F.concat(kind, F.lit(":"), F.when(F.length(base) > 200, short).otherwise(base))


def split_lines(text: Column) -> Column:
    """Lines as Python's splitlines gives them: all its line ends, and no empty piece at the end."""
    ends = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
    pieces = F.split(text, ends)
    trimmed = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(trimmed)


def half_up(value: Column, digits: int = 2) -> Column:
    """Rounded as built in; differs from rounding the exact binary value only where its decimal form ends in a five."""
    return F.round(value, digits)


def exact_round(value: Column, digits: int = 2) -> Column:
    """Rounded by the exact binary value, ties to even, through a pandas function: only where such cases matter."""
    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if pd.isna(x) else round(float(x), digits))

    return rounded(value)
