"""Content analysis of files(path, language, content).

Python sources are parsed by the standard library inside an Arrow-batched function, one pass a file for all facts; Go, Java
and shell are read by patterns with built-in functions. Facts come as arrays of structs; explode gives tables.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.schema import split_lines

#: What a call's last name says about a function. Fixed values.
PYTHON_TAGS = {
    "execute": "db_op", "fetchone": "db_op", "fetchall": "db_op", "commit": "db_op", "rollback": "db_op",
    "connect": "network", "socket": "network", "send": "network", "recv": "network", "get": "network", "post": "network",
    "open": "file_io", "read": "file_io", "write": "file_io", "print": "io_op", "input": "io_op",
}
JAVA_TAGS = {
    "execute": "db_op", "executeQuery": "db_op", "executeUpdate": "db_op", "save": "db_op", "delete": "db_op", "findById": "db_op", "persist": "db_op", "merge": "db_op",
    "send": "network", "connect": "network", "openStream": "network", "read": "file_io", "write": "file_io", "readAllBytes": "file_io", "lines": "file_io",
    "println": "io_op", "print": "io_op", "readLine": "io_op",
}
#: Commands that a shell runs itself, and its keywords. Fixed values. echo isn't among them: it is a program too.
SHELL_COMMANDS = [
    "alias", "bg", "bind", "break", "builtin", "caller", "cd", "command", "compgen", "complete", "compopt", "continue", "declare", "dirs",
    "disown", "enable", "eval", "exec", "exit", "export", "fc", "fg", "getopts", "hash", "help", "history", "jobs", "kill",
    "let", "local", "logout", "mapfile", "popd", "printf", "pushd", "pwd", "read", "readarray", "readonly", "return", "set", "shift",
    "shopt", "source", "suspend", "test", "times", "trap", "type", "typeset", "ulimit", "umask", "unalias", "unset", "wait", ".",
    ":",
]
SHELL_KEYWORDS = [
    "if", "then", "else", "elif", "fi", "case", "esac", "for", "select", "while", "until", "do", "done", "in",
    "function", "time", "[[", "]]", "[", "]", "(", ")", "{", "}",
]
SHELL_BUILTINS = SHELL_COMMANDS + SHELL_KEYWORDS
EXTENSIONS = {
    "py": "python", "go": "go", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "sh": "shell", "bash": "shell", "zsh": "shell", "rs": "rust",
}

FUNCTION = "struct<name:string,qualified_name:string,parent_scope:string,line_start:int,line_end:int,complexity:int,cognitive:int,parameters:array<string>,return_type:string,decorators:array<string>,docstring:boolean,is_async:boolean,is_method:boolean,calls:array<string>,only_pass:boolean,body_size:int>"
CLASS = "struct<name:string,line_start:int,line_end:int,bases:array<string>,methods:array<string>,fields:array<struct<name:string,value:string>>>"
FACTS = (
    f"path string, functions array<{FUNCTION}>, classes array<{CLASS}>, imports array<struct<path:string,alias:string,line:int>>, "
    "variables array<struct<name:string,value:string,line:int>>, handlers array<struct<line:int,kind:string,raises:boolean,only_pass:boolean>>, "
    "constants array<struct<kind:string,name:string,value:string,line:int>>, tokens array<struct<kind:string,value:string>>, complexity int, comment_lines int, parsed boolean"
)
_BRANCHES = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.With, ast.AsyncWith)
_NESTING = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.Try, ast.With, ast.AsyncWith)


def complexity(nodes: list[ast.AST], flavour: str = "digest") -> int:
    """Cyclomatic complexity, 1 for straight code.

    digest counts branches, loops, with, handlers, boolean operands and filters of comprehensions; cst counts nodes of a
    concrete tree, so return, match and each case too but no operands; risk leaves out with.
    """
    found = 1
    for node in (n for top in nodes for n in ast.walk(top)):
        if flavour == "cst":
            found += isinstance(node, (*_BRANCHES, ast.ExceptHandler, ast.Return, ast.Match, ast.match_case))
            continue
        found += isinstance(node, _BRANCHES) and not (flavour == "risk" and isinstance(node, (ast.With, ast.AsyncWith)))
        if isinstance(node, ast.Try):
            found += len(node.handlers)
        elif isinstance(node, ast.BoolOp):
            found += len(node.values) - 1
        elif isinstance(node, ast.comprehension):
            found += len(node.ifs)
    return found


def cognitive(node: ast.AST, depth: int = 0) -> int:
    """Control nodes cost one more than the control nodes around them; each boolean operator costs one."""
    total = 0
    for child in ast.iter_child_nodes(node):
        inside = isinstance(child, _NESTING)
        total += (1 + depth) * inside + (len(child.values) - 1 if isinstance(child, ast.BoolOp) else 0) + cognitive(child, depth + inside)
    return total


def _name(node: ast.AST | None) -> str:
    return ast.unparse(node) if node is not None else ""


#: What a node adds to complexity besides handlers, operands and filters, and which nodes nest; by exact class, as parsed.
_BRANCH_SET, _NESTING_SET = frozenset(_BRANCHES), frozenset(_NESTING)
_CONCRETE = _BRANCH_SET | {ast.ExceptHandler, ast.Return, ast.Match, ast.match_case}
_HOLDERS = (ast.stmt, ast.excepthandler, ast.match_case)
#: Nodes below which nothing is counted and no call stands.
_LEAVES = frozenset(c for c in vars(ast).values() if isinstance(c, type) and issubclass(c, (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.alias)))
PYTHON_FACTS = ("functions", "classes", "imports", "variables", "handlers", "constants", "tokens", "complexity", "comment_lines")


def _spread(tops: list[ast.AST], skipped: frozenset = frozenset()) -> list[ast.AST]:
    """All nodes in the order of ast.walk, but the skipped classes."""
    nodes = list(tops)
    for node in nodes:
        for value in node.__dict__.values():
            if value.__class__ is list:
                nodes += [v for v in value if isinstance(v, ast.AST) and v.__class__ not in skipped]
            elif isinstance(value, ast.AST) and value.__class__ not in skipped:
                nodes.append(value)
    return nodes


def _added(node: ast.AST) -> int:
    """What the node adds to the digest's complexity."""
    kind = node.__class__
    if kind in _BRANCH_SET:
        return 1
    if kind is ast.Try:
        return len(node.handlers)
    if kind is ast.BoolOp:
        return len(node.values) - 1
    return len(node.ifs) if kind is ast.comprehension else 0


def _measures(function: ast.AST) -> tuple[int, int, list[str]]:
    """complexity of the body, cognitive, and the last names of the calls, from one walk."""
    nodes, depths, total, thought, calls = [function], [0], 1, 0, []
    for node, depth in zip(nodes, depths):
        kind = node.__class__
        if kind is ast.Call:
            if node.func.__class__ is ast.Attribute:
                calls.append(node.func.attr)
            elif node.func.__class__ is ast.Name:
                calls.append(node.func.id)
        else:
            total += _added(node)
            if kind is ast.BoolOp:
                thought += len(node.values) - 1
            elif kind in _NESTING_SET:
                depth += 1
                thought += depth
        for value in node.__dict__.values():
            if value.__class__ is list:
                for v in value:
                    if isinstance(v, ast.AST) and v.__class__ not in _LEAVES:
                        nodes.append(v)
                        depths.append(depth)
            elif isinstance(value, ast.AST) and value.__class__ not in _LEAVES:
                nodes.append(value)
                depths.append(depth)
    head = [function.args, *function.decorator_list, *([function.returns] if function.returns else []), *function.type_params]
    return total - sum(map(_added, _spread(head, _LEAVES))), thought, calls


def _function(child: ast.AST, scope: list[str], in_class: bool) -> dict:
    arguments, body = child.args, child.body
    total, thought, calls = _measures(child)
    return {
        "name": child.name, "qualified_name": ".".join([*scope, child.name]), "parent_scope": ".".join(scope) or None, "line_start": child.lineno, "line_end": child.end_lineno,
        "complexity": total, "cognitive": thought, "parameters": [a.arg for a in [*arguments.posonlyargs, *arguments.args, *arguments.kwonlyargs]],
        "return_type": _name(child.returns) or None, "decorators": [_name(d) for d in child.decorator_list], "docstring": ast.get_docstring(child) is not None,
        "is_async": isinstance(child, ast.AsyncFunctionDef), "is_method": in_class, "calls": calls,
        "only_pass": len(body) == 1 and isinstance(body[0], ast.Pass), "body_size": len(body),
    }


def _class(child: ast.ClassDef) -> dict:
    fields = [(t.id, s.value) for s in child.body if isinstance(s, (ast.Assign, ast.AnnAssign)) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)]
    methods = [s.name for s in child.body if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return {"name": child.name, "line_start": child.lineno, "line_end": child.end_lineno, "bases": [b.id for b in child.bases if isinstance(b, ast.Name)], "methods": methods, "fields": [{"name": n, "value": _name(v)[:30] or None} for n, v in fields]}


def python_facts(content: str, wanted: Collection[str] = PYTHON_FACTS) -> dict:
    """The wanted facts of one Python source; parsed is false, and everything empty, where it isn't Python."""
    facts: dict = {k: 0 if k in ("complexity", "comment_lines") else [] for k in wanted}
    try:
        tree = ast.parse(content)
        _python_facts(tree, content, facts)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {k: 0 if k in ("complexity", "comment_lines") else [] for k in wanted} | {"parsed": False}
    return facts | {"parsed": True}


def _python_facts(tree: ast.Module, content: str, facts: dict) -> None:
    """Fills in the facts that are asked for by their keys; the others cost nothing."""
    functions, classes = facts.get("functions"), facts.get("classes")

    def walk(node: ast.AST, scope: list[str], in_class: bool) -> None:
        for value in node.__dict__.values():  # definitions are statements, so they stand in lists
            for child in value if value.__class__ is list else ():
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    if functions is not None:
                        functions.append(_function(child, scope, in_class))
                    walk(child, [*scope, child.name], False)
                elif isinstance(child, ast.ClassDef):
                    if classes is not None:
                        classes.append(_class(child))
                    walk(child, [*scope, child.name], True)
                elif isinstance(child, _HOLDERS):
                    walk(child, scope, in_class)

    if functions is not None or classes is not None:
        walk(tree, [], False)
    imports, handlers, constants, tokens = (facts.get(k) for k in ("imports", "handlers", "constants", "tokens"))
    if constants is not None or tokens is not None or "complexity" in facts:
        nodes = _spread([tree])
    else:
        nodes = _statements(tree) if imports is not None or handlers is not None else []
    for node in nodes:
        kind = node.__class__
        if imports is not None and kind is ast.Import:
            imports += [{"path": a.name, "alias": a.asname, "line": node.lineno} for a in node.names]
        elif imports is not None and kind is ast.ImportFrom:
            module = "." * node.level + (node.module or "")
            imports += [{"path": f"{module}.{a.name}" if module.strip(".") else module + a.name, "alias": a.asname, "line": node.lineno} for a in node.names]
        elif handlers is not None and kind is ast.ExceptHandler:
            handlers.append({"line": node.lineno, "kind": _name(node.type) or None, "raises": any(isinstance(s, ast.Raise) for s in node.body), "only_pass": len(node.body) == 1 and isinstance(node.body[0], ast.Pass)})
        elif constants is not None and (kind is ast.Assign or kind is ast.AnnAssign):
            if isinstance(node.value, ast.Constant) and isinstance(node.value.value, (int, float)):
                targets = node.targets if kind is ast.Assign else [node.target]
                constants += [{"kind": "number", "name": t.id, "value": str(node.value.value), "line": node.lineno} for t in targets if isinstance(t, ast.Name)]
        elif constants is not None and kind is ast.Constant and isinstance(node.value, str):
            constants.append({"kind": "string", "name": None, "value": node.value, "line": node.lineno})
        elif constants is not None and kind is ast.Call and isinstance(node.func, ast.Name) and node.func.id == "print":
            constants.append({"kind": "print", "name": None, "value": None, "line": node.lineno})
        if tokens is not None:
            if isinstance(node, (ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
                tokens.append({"kind": "operator", "value": kind.__name__})
            elif kind is ast.Name or kind is ast.Constant:
                tokens.append({"kind": "operand", "value": node.id if kind is ast.Name else repr(node.value)})
    if "variables" in facts:
        for node in tree.body:
            if isinstance(node, (ast.Assign, ast.AnnAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                facts["variables"] += [{"name": t.id, "value": _name(node.value) or None, "line": node.lineno} for t in targets if isinstance(t, ast.Name)]
    if "comment_lines" in facts:
        facts["comment_lines"] = sum(line.lstrip().startswith("#") or " #" in line for line in content.splitlines())
    if "complexity" in facts:
        facts["complexity"] = 1 + sum(map(_added, nodes))


def _statements(tree: ast.Module) -> list[ast.AST]:
    """Statements, handlers and cases in the order of ast.walk."""
    nodes: list[ast.AST] = [tree]
    for node in nodes:
        for value in node.__dict__.values():
            if value.__class__ is list:
                nodes += [v for v in value if isinstance(v, _HOLDERS)]
    return nodes


def extract(files: DataFrame, *wanted: str) -> DataFrame:
    """One row for each Python file: path, the wanted columns of FACTS and parsed; all of FACTS if none is named."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    every = StructType.fromDDL(FACTS)
    names = [f.name for f in every if not wanted or f.name in (*wanted, "path", "parsed")]
    schema = StructType([every[n] for n in names])
    arrow, asked = to_arrow_schema(schema), [n for n in names if n not in ("path", "parsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = (column.to_pylist() for column in batch.columns)
            for at in range(0, len(paths), 1000):
                rows = [{"path": path} | python_facts(content or "", asked) for path, content in zip(paths[at : at + 1000], contents[at : at + 1000])]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.where("language = 'python'").select("path", "content").mapInArrow(run, schema)


def _complexities(tree: ast.Module) -> tuple[int, int, int]:
    """complexity by digest, risk and cst, from one walk."""
    digest, withs, cst = 1, 0, 1
    for node in _spread([tree], _LEAVES):
        digest += _added(node)
        withs += node.__class__ is ast.With or node.__class__ is ast.AsyncWith
        cst += node.__class__ in _CONCRETE
    return digest, digest - withs, cst


def complexities(files: DataFrame) -> DataFrame:
    """A file's cyclomatic complexity by each definition: path, digest, risk, cst; 0 where it isn't Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows.append((path, 0, 0, 0))
                    continue
                rows.append((path, *_complexities(tree)))
            yield pd.DataFrame(rows, columns=["path", "digest", "risk", "cst"])

    return files.select("path", "content").mapInPandas(run, "path string, digest int, risk int, cst int")


def exploded(facts: DataFrame, what: str) -> DataFrame:
    """functions, classes, imports, variables, handlers or constants as rows."""
    return facts.select("path", F.explode(what).alias("x")).select("path", "x.*")


def semantic_tags(functions: DataFrame, tags: dict[str, str] = PYTHON_TAGS) -> DataFrame:
    """functions(path, qualified_name, calls) with the sorted distinct tags of their calls."""
    known = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    found = F.filter(F.transform("calls", lambda c: known[c]), lambda t: t.isNotNull())
    return functions.withColumn("tags", F.array_sort(F.array_distinct(found)))


# Metrics

def file_complexity(functions: DataFrame, threshold: int = 10) -> DataFrame:
    return functions.groupBy("path").agg(F.max("complexity").alias("max_complexity"), F.avg("complexity").alias("avg_complexity"), F.count_if(F.col("complexity") > threshold).alias("over"))


def semantic_metrics(functions: DataFrame) -> DataFrame:
    return functions.groupBy("path").agg(F.sum("complexity").alias("cyclomatic"), F.sum("cognitive").alias("cognitive"), F.max("complexity").alias("max_complexity"), F.avg("complexity").alias("avg_complexity"))


def halstead(tokens: DataFrame) -> DataFrame:
    """tokens(path, kind operator or operand, value). As counted by the original definition here: length adds up the
    distinct ones, vocabulary all; files without either have no row."""
    of = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
    found = tokens.groupBy("path").agg(F.countDistinct(of("operator")).alias("d1"), F.countDistinct(of("operand")).alias("d2"), F.count(of("operator")).alias("t1"), F.count(of("operand")).alias("t2")).where("d1 > 0 AND d2 > 0")
    length, vocabulary = F.col("d1") + F.col("d2"), F.col("t1") + F.col("t2")
    return found.select("path", length.alias("length"), vocabulary.alias("vocabulary"), (length * F.log2(vocabulary)).alias("volume"), ((F.col("t1") / 2) * (F.col("d2") / F.col("t2"))).alias("difficulty"))


def module_digest(functions: DataFrame, classes: DataFrame, files: DataFrame, high: int = 10) -> DataFrame:
    """Per dotted module: classes, functions, mean complexity (one digit), complex functions."""
    module = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    of = files.select("path", F.regexp_replace(module, r"\.__init__$", "").alias("module"))
    fn = functions.join(of, "path").groupBy("module").agg(F.count(F.lit(1)).alias("functions"), F.round(F.avg("complexity"), 1).alias("avg_complexity"), F.count_if(F.col("complexity") >= high).alias("complex"))
    cl = classes.join(of, "path").groupBy("module").agg(F.count(F.lit(1)).alias("classes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return of.select("module").distinct().join(fn, "module", "left").join(cl, "module", "left").select("module", zero("classes"), zero("functions"), F.coalesce("avg_complexity", F.lit(0.0)).alias("avg_complexity"), zero("complex"))


def module_digests(facts: DataFrame, high: int = 10) -> DataFrame:
    """module_digest from functions and classes as extract gives them, so that each source is parsed once."""
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", "."), r"\.__init__$", "")
    total = F.aggregate("functions", F.lit(0).cast("long"), lambda n, f: n + f["complexity"])
    found = facts.select(module.alias("module"), F.size("classes").alias("c"), F.size("functions").alias("f"), total.alias("total"), F.size(F.filter("functions", lambda f: f["complexity"] >= high)).alias("high"))
    sums = found.groupBy("module").agg(*[F.sum(c).alias(name) for c, name in (("c", "classes"), ("f", "functions"), ("total", "total"), ("high", "complex"))])
    mean = F.when(F.col("functions") > 0, F.round(F.col("total") / F.col("functions"), 1)).otherwise(F.lit(0.0))
    return sums.select("module", "classes", "functions", mean.alias("avg_complexity"), "complex")


def tech_stack(imports: DataFrame, own: DataFrame, most: int = 10) -> DataFrame:
    """First names of imports that are neither in the standard library nor own modules, sorted, the first ones."""
    import sys

    first = imports.select(F.substring_index("path", ".", 1).alias("name")).where("name <> ''").distinct()
    return first.where(~F.col("name").isin(*sorted(sys.stdlib_module_names))).join(own.select(F.substring_index("module", ".", 1).alias("name")), "name", "left_anti").orderBy("name").limit(most)


def module_imports(imports: DataFrame) -> DataFrame:
    """imports(file, path) to (module, deps): distinct imports but those whose names begin with sys, os or re."""
    module = F.regexp_replace(F.regexp_replace("file", r"\.py$", ""), "/", ".")
    return imports.where(~F.rlike("path", F.lit("^(sys|os|re)"))).groupBy(module.alias("module")).agg(F.array_sort(F.collect_set("path")).alias("deps"))


def ast_summary(facts: DataFrame) -> DataFrame:
    return facts.select("path", F.size("functions").alias("function_count"), F.size("classes").alias("class_count"), F.size("imports").alias("import_count"), "comment_lines")


# Patterns

def patterns(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, kind, name, confidence): classes of over 20 methods, functions of over 50 lines, Go factories."""
    god = classes.where(F.size("methods") > 20).select("path", F.lit("god_class").alias("kind"), "name", F.lit(1.0).alias("confidence"))
    long = functions.where(F.col("line_end") - F.col("line_start") > 50).select("path", F.lit("long_function").alias("kind"), "name", F.lit(1.0).alias("confidence"))
    factory = functions.where(F.endswith("path", F.lit(".go")) & F.startswith("name", F.lit("New"))).select("path", F.lit("factory").alias("kind"), "name", F.lit(0.8).alias("confidence"))
    return god.unionByName(long).unionByName(factory)


def file_patterns(facts: DataFrame) -> DataFrame:
    """patterns from functions and classes as extract gives them, in one pass over the files."""
    row = lambda kind, confidence: lambda x: F.struct(F.lit(kind).alias("kind"), x["name"].alias("name"), F.lit(confidence).alias("confidence"))
    god = F.transform(F.filter("classes", lambda x: F.size(x["methods"]) > 20), row("god_class", 1.0))
    long = F.transform(F.filter("functions", lambda f: f["line_end"] - f["line_start"] > 50), row("long_function", 1.0))
    factory = F.transform(F.filter("functions", lambda f: F.endswith("path", F.lit(".go")) & F.startswith(f["name"], F.lit("New"))), row("factory", 0.8))
    return facts.select("path", F.explode(F.concat(god, long, factory)).alias("x")).select("path", "x.*")


def threshold_issues(metrics: DataFrame, cycles: DataFrame, depth: DataFrame, most: int = 200, deepest: int = 5) -> DataFrame:
    """(rule_id, severity, path, message) from metrics(path, cyclomatic), cycles(cycle) and depth(depth)."""
    row = lambda df, rule, severity, path, message: df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), path.alias("path"), message.alias("message"))
    none = F.lit(None).cast("string")
    high = row(metrics.where(F.col("cyclomatic") > most), "high-complexity", "warning", F.col("path"), F.concat(F.lit("complexity "), F.col("cyclomatic").cast("string")))
    loops = row(cycles, "dependency-cycle", "error", none, F.concat_ws(" -> ", F.transform("cycle", lambda c: c.cast("string"))))
    deep = row(depth.where(F.col("depth") > deepest), "dependency-depth", "warning", none, F.concat(F.lit("depth "), F.col("depth").cast("string")))
    return high.unionByName(loops).unionByName(deep)


# Go, Java, shell by patterns

def go_facts(files: DataFrame) -> DataFrame:
    """package, imports, functions, structs, interfaces and counts of concurrency and error checks."""
    c = F.col("content")
    single = F.regexp_extract_all(c, F.lit(r'(?m)^import\s+(?:\w+\s+)?"([^"]+)"'), 1)
    block = F.regexp_extract_all(F.regexp_extract(c, r"(?s)import\s*\((.*?)\)", 1), F.lit(r'"([^"]+)"'), 1)
    return files.where("language = 'go'").select(
        "path", F.regexp_extract(c, r"(?m)^package\s+(\w+)", 1).alias("package"), F.concat(single, block).alias("imports"),
        F.regexp_extract_all(c, F.lit(r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)"), 1).alias("functions"), F.regexp_extract_all(c, F.lit(r"(?m)^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), 1).alias("structs"),
        F.regexp_extract_all(c, F.lit(r"(?m)^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"), 1).alias("interfaces"), F.regexp_count(c, F.lit(r"(?m)^\s*go\s+\w")).alias("goroutines"),
        F.regexp_count(c, F.lit(r"<-|\bmake\(chan\b")).alias("channel_ops"), F.regexp_count(c, F.lit(r"if\s+(?:[^\n{;]*;\s*)?err\s*!=\s*nil")).alias("error_checks"),
    )


def go_packages(facts: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter("imports", lambda i: F.contains(i, F.lit(".")))))))
    return facts.groupBy("package").agg(F.count(F.lit(1)).alias("files"), F.sum("error_checks").alias("error_checks"), names.alias("deps"))


def java_facts(files: DataFrame) -> DataFrame:
    c = F.col("content")
    method = r"(?m)^\s*(?:@\w+\s+)*((?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?\s*[{;]"
    return files.where("language = 'java'").select(
        "path", F.regexp_extract(c, r"(?m)^package\s+([\w.]+)\s*;", 1).alias("package"), F.regexp_extract_all(c, F.lit(r"(?m)^import\s+(?:static\s+)?([\w.*]+)\s*;"), 1).alias("imports"),
        F.regexp_extract_all(c, F.lit(r"\b(?:class|record|enum)\s+(\w+)"), 1).alias("classes"), F.regexp_extract_all(c, F.lit(r"\binterface\s+(\w+)"), 1).alias("interfaces"), F.regexp_extract_all(c, F.lit(method), 2).alias("methods"),
        F.regexp_extract_all(c, F.lit(r"@(\w+)"), 1).alias("annotations"), (F.regexp_count(c, F.lit(r"\b(?:if|for|while|case|catch|return|throw)\b|\?")) + 1).alias("complexity"),
    )


def shell_facts(files: DataFrame) -> DataFrame:
    """functions, global variables, sourced files, and programs that aren't builtins, keywords or own functions."""
    c = F.regexp_replace("content", r"(?m)(^|\s)#[^\n]*", "$1")
    own = F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:function\s+)?([\w-]+)\s*\(\)"), 1)
    words = F.regexp_extract_all(c, F.lit(r"(?m)(?:^|[;|&]|\bthen\b|\bdo\b|\belse\b)[ \t]*([A-Za-z_./][\w./-]*)(?=[ \t\n;|&]|$)"), 1)
    programs = F.array_sort(F.array_distinct(F.array_except(F.filter(words, lambda w: ~w.isin(*SHELL_BUILTINS)), own)))
    return files.where("language = 'shell'").select("path", own.alias("functions"), F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:export\s+)?([A-Za-z_]\w*)="), 1)).alias("variables"), F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:source|\.)\s+(\S+)"), 1).alias("imports"), programs.alias("commands"))


# Files

def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(known[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))], F.lit("unknown"))


def is_shell(path: Column, content: Column) -> Column:
    """*.sh, or no extension and a first line that names bash or sh."""
    first = F.split(content, "\n")[0]
    return F.endswith(path, F.lit(".sh")) | (~F.rlike(path, F.lit(r"\.[^/]*$")) & F.rlike(first, F.lit(r"^#!.*\b(bash|sh)\b")))


def line_count(content: Column) -> Column:
    """Null and empty texts have no lines."""
    return F.coalesce(F.when(content.isNotNull(), F.size(split_lines(content))), F.lit(0))


# Compression

def _parsed(content: str) -> ast.Module | None:
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None


def compress(content: str, kind: str, parse: Callable[[str], ast.Module | None] = _parsed) -> str:
    """full is the text itself; skeleton keeps headers and docstrings and prunes bodies; signature keeps top-level headers."""
    tree = None if kind == "full" else parse(content)
    if tree is None:
        return content
    lines = content.splitlines()
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    if kind == "signature":
        return "\n".join(f"{'class' if isinstance(n, ast.ClassDef) else 'def'} {n.name}" for n in tree.body if isinstance(n, (*functions, ast.ClassDef)))
    spans = []
    for node in _statements(tree):
        if isinstance(node, functions):
            body = node.body[1:] if ast.get_docstring(node) is not None else node.body
            if body and body[0].lineno > node.lineno:
                spans.append((body[0].lineno - 1, node.end_lineno, body[0].col_offset))
    out, at = [], 0
    for start, end, indent in merged(spans):
        out += [*lines[at:start], " " * indent + "... # Pruned"]
        at = end
    return "\n".join(out + lines[at:])


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int, int]] = []
    for span in sorted(spans):
        if out and span[0] < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], span[1]), out[-1][2])
        else:
            out.append(span)
    return out


def compressed(files: DataFrame) -> DataFrame:
    """files(path, content, strategy) with the compressed text."""

    @F.pandas_udf("string")
    def apply(content: pd.Series, kind: pd.Series) -> pd.Series:
        parse = lru_cache(1)(_parsed)  # the strategies of a file stand one after the other
        return pd.Series([compress(c or "", k, parse) for c, k in zip(content, kind)])

    return files.select("path", "strategy", apply("content", "strategy").alias("text"))


def digest(facts: DataFrame, most_parameters: int = 5) -> DataFrame:
    """A compact row for each function: parameters beyond the first ones become '...'."""
    parameters = F.when(F.size("parameters") > most_parameters, F.concat(F.slice("parameters", 1, most_parameters), F.array(F.lit("...")))).otherwise(F.col("parameters"))
    return exploded(facts, "functions").select("path", "name", F.col("line_start").alias("line"), F.col("complexity").alias("cx"), parameters.alias("args"), "decorators", F.col("return_type").alias("ret"), "is_async")


def analysis(files: DataFrame) -> dict[str, DataFrame]:
    """One extraction, then complexity, imports and patterns by file."""
    facts = extract(files, "functions", "classes", "imports")
    functions, classes = exploded(facts, "functions"), exploded(facts, "classes")
    imports = facts.select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.path", "i.alias", "i.line")
    return {"complexity": semantic_metrics(functions), "imports": imports, "patterns": patterns(functions.select("path", "name", "line_start", "line_end"), classes)}


def merged_intervals(spans: DataFrame) -> DataFrame:
    """spans(path, start, end) with those that overlap as one: a span begins an island if it starts at or after all ends before."""
    order = Window.partitionBy("path").orderBy("start", "end")
    fresh = F.coalesce((F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("fresh", fresh).withColumn("island", island).groupBy("path", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
