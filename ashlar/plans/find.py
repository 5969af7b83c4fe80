"""The FIND language: text to syntax tree to a plan over nodes and edges.

FIND type [AS alias] [WHERE condition ((AND|OR) condition)*] [LIMIT n] [OFFSET n], the last two in either order.
A condition compares an attribute (=, !=, <>, <, >, <=, >=, LIKE, IN (...)) or names a relation and a target.
Attribute conditions fold from left to right without precedence; relations must all hold. A null attribute fails every
comparison. LIKE is containment without case. LIMIT 0 and OFFSET 0 count as absent. Extensions to the core language:
LIKE, IN, NOT before a relation, and * as a relation's target.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ashlar.schema import COMMON, EDGE_TYPES, NODE_TYPES

RELATIONS = {"CALLING": "calls", "INHERITS": "inherits", "IMPORTS": "imports", "CONTAINS": "contains", "REFERENCES": "references", "DEFINES": "defines"}
KEYWORDS = {"FIND", "AS", "WHERE", "AND", "OR", "NOT", "LIMIT", "OFFSET", "LIKE", "IN", *RELATIONS}
PLURALS = {"functions": "function", "files": "file", "classes": "class", "modules": "module", "variables": "variable"}
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|'(?P<string>[^']*)'|\"(?P<quoted>[^\"]*)\"|(?P<word>[A-Za-z_]\w*)|(?P<op><=|>=|<>|!=|=|<|>|\(|\)|,))")


class FindError(ValueError):
    """A text that isn't in the language, or names what the catalogue lacks."""


@dataclass(frozen=True)
class Attribute:
    name: str
    op: str
    value: object
    joined_by: str = "AND"


@dataclass(frozen=True)
class Relation:
    edge: str
    target: str
    negated: bool = False


@dataclass
class Query:
    kind: str
    alias: str | None = None
    attributes: list[Attribute] = field(default_factory=list)
    relations: list[Relation] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None


def tokens(text: str) -> list[tuple[str, object]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        found = _TOKEN.match(text, at)
        if not found:
            raise FindError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        at, kind, value = found.end(), found.lastgroup, found[found.lastgroup]
        if kind == "number":
            out.append(("number", float(value) if "." in value else int(value)))
        elif kind in ("string", "quoted"):
            out.append(("string", value))
        elif kind == "word" and value.upper() in KEYWORDS:
            out.append((value.upper(), value))
        else:
            out.append((kind if kind == "word" else value, value))
    return out


class _Parser:
    def __init__(self, text: str):
        self.rest = tokens(text)

    def peek(self) -> str:
        return self.rest[0][0] if self.rest else "end"

    def take(self, *kinds: str):
        if self.peek() not in kinds:
            raise FindError(f"expected {' or '.join(kinds)}, found {self.rest[0][1]!r}" if self.rest else f"expected {' or '.join(kinds)} at the end")
        return self.rest.pop(0)[1]

    def query(self) -> Query:
        self.take("FIND")
        kind = self.take("word")
        query = Query(PLURALS.get(kind.lower(), kind.lower()))
        if self.peek() == "AS":
            self.take("AS")
            query.alias = self.take("word")
        if self.peek() == "WHERE":
            self.take("WHERE")
            self.condition(query, "AND")
            while self.peek() in ("AND", "OR"):
                self.condition(query, self.take("AND", "OR").upper())
        while self.peek() in ("LIMIT", "OFFSET"):
            clause, n = self.rest.pop(0)[0].lower(), self.take("number")
            if getattr(query, clause) is not None or not isinstance(n, int):
                raise FindError(f"bad {clause}")
            setattr(query, clause, n)
        if self.rest:
            raise FindError(f"unexpected {self.rest[0][1]!r}")
        return query

    def condition(self, query: Query, joined_by: str) -> None:
        negated = self.peek() == "NOT"
        if negated:
            self.take("NOT")
        if negated or self.peek() in RELATIONS:
            edge = RELATIONS[self.take(*RELATIONS).upper()]
            query.relations.append(Relation(edge, self.take("string"), negated))
            return
        name = self.take("word")
        op = self.take("=", "!=", "<>", "<", ">", "<=", ">=", "LIKE", "IN").upper()
        if op == "IN":
            self.take("(")
            value = [self.take("number", "string", "word")]
            while self.peek() == ",":
                self.take(",")
                value.append(self.take("number", "string", "word"))
            self.take(")")
        else:
            value = self.take("number", "string", "word")
        query.attributes.append(Attribute(name, "!=" if op == "<>" else op, value, joined_by))


def parse(text: str) -> Query:
    return _Parser(text).query()


def validate(query: Query) -> list[str]:
    """Raises on unknown node types, returns warnings about unknown attributes."""
    if query.kind not in NODE_TYPES:
        raise FindError(f"unknown node type {query.kind}")
    for relation in query.relations:
        if relation.edge not in EDGE_TYPES:
            raise FindError(f"unknown edge type {relation.edge}")
    return [f"{query.kind} has no attribute {a.name}" for a in query.attributes if a.name not in (*NODE_TYPES[query.kind], *COMMON)]


def attribute_column(nodes: DataFrame, condition: Attribute) -> Column:
    """The condition as a predicate that is never null."""
    if condition.name in nodes.columns:
        column, numeric = F.col(condition.name), isinstance(nodes.schema[condition.name].dataType, NumericType)
    elif "properties" in nodes.columns:
        column, numeric = F.try_variant_get("properties", f"$.{condition.name}", "string"), False
    else:
        return F.lit(False)
    if condition.op == "LIKE":
        found = F.contains(F.lower(column.cast("string")), F.lit(str(condition.value).lower()))
    elif condition.op == "IN":
        found = F.lit(False)
        for value in condition.value:
            found = found | attribute_column(nodes, Attribute(condition.name, "=", value))
    elif isinstance(condition.value, (int, float)):
        found = _compare(column if numeric else column.try_cast("double"), condition.op, F.lit(condition.value))
    elif numeric:  # a number never equals a text, and isn't ordered with one
        found = column.isNotNull() if condition.op == "!=" else F.lit(False)
    else:
        found = _compare(column, condition.op, F.lit(condition.value))
    return F.coalesce(found, F.lit(False))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def matching(query: Query, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes that the query finds, before paging: one filter, and a semi- or anti-join for each relation."""
    found = nodes.where(F.col("type") == query.kind)
    if query.attributes:
        fold = attribute_column(nodes, query.attributes[0])
        for condition in query.attributes[1:]:
            own = attribute_column(nodes, condition)
            fold = fold & own if condition.joined_by == "AND" else fold | own
        found = found.where(fold)
    for relation in query.relations:
        own = edges.where(F.col("type") == relation.edge)
        if relation.target != "*":
            own = own.where(F.contains("target", F.lit(relation.target)))
        found = found.join(own.select(F.col("source").alias("id")), "id", "left_anti" if relation.negated else "left_semi")
    return found


def page(found: DataFrame, query: Query) -> DataFrame:
    """Offset, then limit, in order of id."""
    if query.offset or query.limit:
        found = found.orderBy("id")
        found = found.offset(query.offset) if query.offset else found
        found = found.limit(query.limit) if query.limit else found
    return found


def find(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    query = parse(text)
    validate(query)
    return page(matching(query, nodes, edges), query)


def total_count(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes there are before paging."""
    return matching(parse(text), nodes, edges).agg(F.count(F.lit(1)).alias("total_count"))
