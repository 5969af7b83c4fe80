"""Declarations in Go and Java sources, from their tokens.

One lexer knows strings, raw strings, text blocks, runes and comments, so that nothing inside them counts, and pairs
brackets; what isn't paired ends with the file. Readers for the two languages go over the tokens of a level and step over
what is nested. Each source is read once, in an Arrow batch, to arrays of structs; the rest is Spark's explode.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"[ \t]*+(?:(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
    r'|(?P<text>"""(?:\\.|[^\\])*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|`[^`]*(?:`|\Z))'
    r"|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>&&|\|\||\.\.\.|->|::|:=|<-|.))",
    re.S,
)
_SPACE, _KINDS = _TOKEN.groupindex["space"], {at: kind for kind, at in _TOKEN.groupindex.items()}
_OPENING = frozenset("([{")
_PAIRS = {")": "(", "]": "[", "}": "{"}
GO_COUNTED = frozenset({"if", "for", "switch", "select", "return", "case", "default", "&&", "||"})
#: A do loop counts by its while.
JAVA_COUNTED = frozenset({"if", "for", "while", "catch", "switch", "case", "default", "return", "throw", "&&", "||"})
#: What annotations say of a class or method. Fixed values.
ANNOTATION_TAGS = {
    "GetMapping": "network", "PostMapping": "network", "PutMapping": "network", "DeleteMapping": "network", "RequestMapping": "network", "PatchMapping": "network",
    "Entity": "db_op", "Table": "db_op", "Repository": "db_op",
    "Service": "service", "Controller": "controller", "RestController": "controller", "Component": "component", "Configuration": "config", "Bean": "config",
}
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "transient", "volatile", "sealed"}
_FN = "name string, owner string, pointer boolean, type_parameters array<string>, parameters array<string>, returns string, modifiers array<string>, annotations array<string>, throws array<string>, tags array<string>, exported boolean, complexity int, line_start int, line_end int"
_FIELD = "struct<name: string, type: string, tag: string, embedded: boolean>"
_TYPE = f"name string, kind string, type_parameters array<string>, bases array<string>, fields array<{_FIELD}>, methods array<string>, annotations array<string>, tags array<string>, exported boolean, line_start int, line_end int"
FACTS = f"package string, imports array<struct<path: string, alias: string>>, functions array<struct<{_FN}>>, types array<struct<{_TYPE}>>"


class Tokens:
    """Tokens of a source without comments; match has the place of each opening bracket's partner."""

    def __init__(self, source: str):
        found = [m for m in _TOKEN.finditer(source) if m.lastindex != _SPACE]
        self.source, self.n = source, len(found)
        self.kinds = [_KINDS[m.lastindex] for m in found]
        self.texts = [m[m.lastindex] for m in found]
        self.starts = [m.start(m.lastindex) for m in found]
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        #: texts, empty for strings
        self.plain = ["" if kind == "text" else text for kind, text in zip(self.kinds, self.texts)] if "text" in self.kinds else self.texts
        self.match, open_, texts = {}, [], self.plain
        for i, text in enumerate(texts):
            if text in _OPENING:
                open_.append(i)
            elif text in _PAIRS:
                at = next((k for k in range(len(open_) - 1, -1, -1) if texts[open_[k]] == _PAIRS[text]), None)
                if at is not None:
                    self.match[open_[at]] = i
                    del open_[at:]
        self.match |= dict.fromkeys(open_, self.n)

    def __len__(self) -> int:
        return self.n

    def at(self, i: int) -> str:
        """The token, empty beyond the end and for strings, which are no names or marks."""
        return self.plain[i] if 0 <= i < self.n else ""

    def named(self, i: int) -> bool:
        return 0 <= i < self.n and self.kinds[i] == "name"

    def line(self, i: int) -> int:
        return bisect_left(self.breaks, self.starts[min(i, self.n - 1)]) + 1

    def text(self, start: int, end: int) -> str:
        """The source from a token up to another, white space as single spaces."""
        return " ".join(self.source[self.starts[start] : self.starts[end - 1] + len(self.texts[end - 1])].split()) if start < min(end, len(self)) else ""

    def after(self, i: int) -> int:
        """Behind the token, or behind its partner if it opens."""
        end = self.match.get(i)
        return i + 1 if end is None else min(self.n, end + 1)

    def angles(self, i: int) -> int:
        """Behind the > that closes the < at i."""
        depth = 0
        while i < len(self):
            depth += (self.at(i) == "<") - (self.at(i) == ">")
            i = self.after(i)
            if not depth:
                return i
        return i

    def parts(self, start: int, end: int, angled: bool = False) -> list[tuple[int, int]]:
        """What commas part between start and end, outside brackets."""
        out, begin, i = [], start, start
        while i < end:
            if self.at(i) == ",":
                out.append((begin, i))
                begin = i + 1
            i = self.angles(i) if angled and self.at(i) == "<" else self.after(i)
        return [(a, b) for a, b in [*out, (begin, end)] if a < b]

    def count(self, start: int, end: int, words: frozenset[str]) -> int:
        """How many of the words there are."""
        return sum(map(words.__contains__, self.plain[start:end]))

    def places(self, word: str, start: int, end: int) -> list[int]:
        return [start + k for k, text in enumerate(self.plain[start:end]) if text == word]


def go_source(source: str) -> dict:
    """Package, imports, functions (owner: the receiver's type) and types of a Go source."""
    t = Tokens(source)
    out: dict = {"package": None, "imports": [], "functions": [], "types": []}
    i = 0
    while i < len(t):
        word = t.at(i)
        if word == "package" and t.named(i + 1):
            out["package"] = out["package"] or t.texts[i + 1]
            i += 2
        elif word == "import":
            start, end = (i + 2, t.match[i + 1]) if t.at(i + 1) == "(" else (i + 1, i + 3 if t.kinds[i + 1 : i + 2] != ["text"] else i + 2)
            for k in range(start, min(end, len(t))):
                if t.kinds[k] == "text":
                    alias = t.texts[k - 1] if k > start - 1 and t.line(k - 1) == t.line(k) and t.at(k - 1) not in ("import", "(", ";", "") else None
                    out["imports"].append({"path": t.texts[k].strip('"`'), "alias": alias})
            i = end
        elif word == "func":
            i = _go_function(t, i, out["functions"])
        elif word == "type":
            if t.at(i + 1) == "(":
                k, end = i + 2, t.match[i + 1]
                while k < end:
                    k = _go_type(t, k, out["types"]) if t.named(k) else t.after(k)
                i = end + 1
            else:
                i = _go_type(t, i + 1, out["types"])
        else:
            i = t.after(i)
    return out


def _go_parameters(t: Tokens, i: int) -> tuple[list[str], int]:
    """Names of the type parameters in the brackets at i, if that's what they are, and the place behind."""
    if t.at(i) != "[" or not t.named(i + 1) or t.match[i] == i + 2 or t.at(i + 2) not in (",", "") and not (t.named(i + 2) or t.at(i + 2) in "~*[("):
        return [], i
    return [t.texts[a] for a, b in t.parts(i + 1, t.match[i])], t.after(i)


def _go_function(t: Tokens, start: int, out: list) -> int:
    i, owner, pointer = start + 1, None, False
    if t.at(i) == "(":
        names = [k for k in range(i + 1, t.match[i]) if t.named(k) and t.at(k - 1) not in ("[", ",")]
        pointer = any(t.at(k) == "*" for k in range(i + 1, t.match[i]))
        owner = t.texts[names[-1]] if names else None
        i = t.after(i)
    if not t.named(i):
        return i
    name, (generic, i) = t.texts[i], _go_parameters(t, i + 1)
    if t.at(i) != "(":
        return i
    parameters = [t.text(a, b) for a, b in t.parts(i + 1, t.match[i])]
    result = i = t.after(i)
    while i < len(t) and t.line(i) == t.line(i - 1) or t.at(i - 1) in (",", "."):
        if t.at(i) == "{" and t.at(i - 1) not in ("struct", "interface"):
            break
        i = t.after(i)
    body = t.at(i) == "{"
    end = t.match.get(i, i - 1) if body else i - 1
    literals = sum(t.at(k + 1) == "(" for k in t.places("func", i, end)) if body else 0
    out.append(_function(name, owner, parameters, t.text(result, i) or None, 1 + literals + (t.count(i, end, GO_COUNTED) if body else 0), t.line(start), t.line(end)) | {"pointer": pointer, "type_parameters": generic, "exported": name[:1].isupper()})
    return end + 1


def _go_type(t: Tokens, start: int, out: list) -> int:
    name, (generic, i) = t.at(start), _go_parameters(t, start + 1)
    i += t.at(i) == "="
    kind = t.at(i)
    if kind not in ("struct", "interface") or t.at(i + 1) != "{":
        while i < len(t) and t.line(i) == t.line(start):
            i = t.after(i)
        return max(i, start + 1)
    begin, end = i + 2, t.match[i + 1]
    fields, methods, bases = [], [], []
    for a, b in _statements(t, begin, end):
        tag = t.texts[b - 1][1:-1] if t.kinds[b - 1] == "text" else None
        stop = b - (tag is not None)
        if kind == "interface":
            if t.named(a) and t.at(a + 1) == "(":
                methods.append(t.texts[a])
            else:
                bases.append(t.text(a, stop))
            continue
        names = [a]
        while t.at(names[-1] + 1) == "," and t.named(names[-1] + 2):
            names.append(names[-1] + 2)
        rest = names[-1] + 1
        alone = t.at(a) == "*" or rest >= stop or t.at(rest) == "." or t.at(rest) == "[" and t.after(rest) >= stop
        if alone:
            bases.append(t.text(a, stop))
            fields.append({"name": t.text(a, stop).lstrip("*").split("[")[0].rpartition(".")[2], "type": t.text(a, stop), "tag": tag, "embedded": True})
        else:
            fields += [{"name": t.texts[n], "type": t.text(rest, stop), "tag": tag, "embedded": False} for n in names]
    out.append(_type(name, kind, bases, t.line(start), t.line(end)) | {"type_parameters": generic, "fields": fields, "methods": methods, "exported": name[:1].isupper()})
    return end + 1


def _statements(t: Tokens, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of tokens of a level that a line's end or a semicolon parts."""
    begin = i = start
    while i < end:
        after = t.after(i)
        if t.at(i) == ";" or after >= end or t.line(after) > t.line(after - 1):
            stop = i if t.at(i) == ";" else after
            if begin < stop:
                yield begin, min(stop, end)
            begin = after
        i = after


def java_source(source: str) -> dict:
    """Package, imports, methods and constructors (owner: their class with its outer ones) and types of a Java source."""
    t = Tokens(source)
    out: dict = {"package": None, "imports": [], "functions": [], "types": []}
    _java_members(t, 0, len(t), [], out)
    return out


def _java_members(t: Tokens, start: int, end: int, outer: list[str], out: dict) -> list[str]:
    """Reads the members between start and end; names of the methods among them."""
    methods, i = [], start
    while i < end:
        begin, modifiers, annotations = i, [], []
        while i < end:  # what stands before a declaration
            if t.at(i) == "@" and t.at(i + 1) != "interface" and t.named(i + 1):
                i += 1
                name = t.texts[i]
                while t.at(i + 1) == "." and t.named(i + 2):
                    i += 2
                    name = t.texts[i]
                annotations.append(name)
                i = t.after(i + 1) if t.at(i + 1) == "(" else i + 1
            elif t.at(i) in _MODIFIERS or t.at(i) == "non" and t.at(i + 2) == "sealed":
                modifiers.append("non-sealed" if t.at(i) == "non" else t.at(i))
                i += 3 if t.at(i) == "non" else 1
            else:
                break
        word = t.at(i)
        if not outer and word in ("package", "import"):
            stop = i
            while stop < end and t.at(stop) != ";":
                stop += 1
            path = "".join(t.texts[k] for k in range(i + 1 + (t.at(i + 1) == "static"), stop))
            if word == "package":
                out["package"] = path
            else:
                out["imports"].append({"path": path, "alias": None})
            i = stop + 1
        elif (word in ("class", "interface", "enum") or word == "@" and t.at(i + 1) == "interface" or word == "record" and t.named(i + 1) and t.at(i + 2) in ("(", "<")) and t.named(i + 1 + (word == "@")):
            i = _java_type(t, i, begin, modifiers, annotations, outer, out)
        elif word == "{":  # an initialiser
            i = t.after(i)
        else:
            i = _java_member(t, i, begin, end, modifiers, annotations, outer, out, methods)
    return methods


def _java_type(t: Tokens, i: int, begin: int, modifiers: list, annotations: list, outer: list[str], out: dict) -> int:
    kind = "annotation" if t.at(i) == "@" else t.at(i)
    i += 1 + (kind == "annotation")
    name, generic, fields, bases = t.texts[i], [], [], []
    i += 1
    if t.at(i) == "<":
        generic = [t.texts[a] for a, b in t.parts(i + 1, t.angles(i) - 1, True)]
        i = t.angles(i)
    if t.at(i) == "(":
        for a, b in t.parts(i + 1, t.match[i], True):
            fields.append({"name": t.texts[b - 1], "type": t.text(a, b - 1), "tag": None, "embedded": False})
        i = t.after(i)
    while i < len(t) and t.at(i) not in ("{", ";"):
        clause, start = t.at(i), i + 1
        i += 1
        while i < len(t) and t.at(i) not in ("{", ";", "extends", "implements", "permits"):
            i = t.angles(i) if t.at(i) == "<" else t.after(i)
        if clause in ("extends", "implements"):
            bases += [t.text(a, b) for a, b in t.parts(start, i, True)]
    end = t.match.get(i, i)
    own = _type(name, kind, bases, t.line(begin), t.line(end)) | {"type_parameters": generic, "fields": fields, "annotations": annotations, "tags": _tags(annotations), "exported": bool({"public", "protected"} & set(modifiers))}
    out["types"].append(own)
    if t.at(i) == "{":
        first = i + 1
        while kind == "enum" and first < end and t.at(first) != ";":  # constants
            first = t.after(first)
        own["methods"] = _java_members(t, first, end, [*outer, name], out)
    return end + 1


def _java_member(t: Tokens, i: int, begin: int, end: int, modifiers: list, annotations: list, outer: list[str], out: dict, methods: list) -> int:
    """A method, a constructor, or a field, which ends with its semicolon."""
    generic = []
    if t.at(i) == "<":
        generic = [t.texts[a] for a, b in t.parts(i + 1, t.angles(i) - 1, True)]
        i = t.angles(i)
    start = i
    while i < end and t.at(i) not in ("(", "=", ";", "{"):
        i = t.angles(i) if t.at(i) == "<" else t.after(i)
    compact = t.at(i) == "{" and outer and t.at(i - 1) == outer[-1] and i - 1 == start  # a record's constructor
    if not outer or not (compact or t.at(i) == "(" and t.named(i - 1)):
        while i < end and t.at(i) != ";":
            i = t.after(i)
        return i + 1
    name, parameters, throws = t.texts[i - 1], [], []
    returns = t.text(start, i - 1) or None
    if not compact:
        parameters = [t.text(a, b) for a, b in t.parts(i + 1, t.match[i], True)]
        i = t.after(i)
    while i < end and t.at(i) not in ("{", ";"):
        if t.at(i) == "throws":
            stop = i + 1
            while stop < end and t.at(stop) not in ("{", ";"):
                stop += 1
            throws, i = [t.text(a, b) for a, b in t.parts(i + 1, stop)], stop
        else:
            i = t.after(i)
    body = t.at(i) == "{"
    stop = t.match[i] if body else i
    counted = 1 + (t.count(i, stop, JAVA_COUNTED) + _conditions(t, i, stop) if body else 0)
    out["functions"].append(_function(name, ".".join(outer), parameters, returns, counted, t.line(begin), t.line(stop)) | {
        "type_parameters": generic, "modifiers": modifiers, "annotations": annotations, "throws": throws, "tags": _tags(annotations), "exported": bool({"public", "protected"} & set(modifiers)),
    })
    methods.append(name)
    return stop + 1


def _conditions(t: Tokens, start: int, end: int) -> int:
    """Conditional expressions: question marks that are no wildcards."""
    return sum(t.at(k + 1) not in (">", ",", "extends", "super") for k in t.places("?", start, end))


def _tags(annotations: list[str]) -> list[str]:
    return sorted({ANNOTATION_TAGS[a] for a in annotations if a in ANNOTATION_TAGS})


def _function(name, owner, parameters, returns, complexity, start, end) -> dict:
    return {"name": name, "owner": owner, "pointer": False, "type_parameters": [], "parameters": parameters, "returns": returns, "modifiers": [], "annotations": [], "throws": [], "tags": [], "exported": False, "complexity": complexity, "line_start": start, "line_end": end}


def _type(name, kind, bases, start, end) -> dict:
    return {"name": name, "kind": kind, "type_parameters": [], "bases": bases, "fields": [], "methods": [], "annotations": [], "tags": [], "exported": False, "line_start": start, "line_end": end}


def declarations(files: DataFrame, *wanted: str) -> DataFrame:
    """files(path, language, content) to a row for each Go and Java file: path, language and of package, imports, functions
    and types the wanted ones, all if none is named.

    Null and empty contents have no package and empty arrays, repeated files have a row each; broken sources give what can be
    read. An empty table gives an empty result; other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    every = StructType.fromDDL(f"path string, language string, {FACTS}")
    schema = StructType([f for f in every if not wanted or f.name in ("path", "language", *wanted)])
    arrow = to_arrow_schema(schema)
    readers = {"go": go_source, "java": java_source}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, languages, contents = (column.to_pylist() for column in batch.columns)
            for at in range(0, len(paths), 1000):
                part = slice(at, at + 1000)
                rows = [{"path": path, "language": language} | readers[language](content or "") for path, language, content in zip(paths[part], languages[part], contents[part])]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.where(F.col("language").isin(*readers)).select("path", "language", "content").mapInArrow(run, schema)


def functions(found: DataFrame) -> DataFrame:
    return found.select("path", "language", F.explode("functions").alias("x")).select("path", "language", "x.*")


def types(found: DataFrame) -> DataFrame:
    return found.select("path", "language", F.explode("types").alias("x")).select("path", "language", "x.*")
