"""Sources: trees of files, coverage reports, version logs, snapshots, configuration."""

from __future__ import annotations

import fnmatch
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.operators.content import is_shell, language_of

#: Folders that no scan enters. Fixed values.
IGNORED = ("__pycache__", "node_modules", "venv", ".venv", "build", "dist", "target", "vendor")
SNAPSHOT = (
    "metadata struct<version:string,timestamp:timestamp,project_name:string,file_count:int,total_size:long,git_commit:string,tool_version:string,config_hash:string>, "
    "files array<struct<path:string,language:string,content:string,size:long,hash:string,lines:int,metrics:struct<lines_of_code:int,num_functions:int,num_types:int,language_specific:map<string,map<string,double>>>,"
    "risk:struct<risk_score:double,level:string,factors:array<string>,sub_scores:map<string,double>>,"
    "issues:array<struct<id:string,rule_id:string,severity:string,message:string,location:struct<file_path:string,line:int,column:int>,symbol:string,tags:array<string>>>>>, "
    "dependencies struct<internal:array<map<string,string>>,external:array<string>,edges:array<struct<src:string,dst:string>>>"
)


SNIFFED = 65_536


def glob_pattern(glob: str) -> str:
    """A glob as a pattern over whole paths."""
    return fnmatch.translate(glob).replace("(?s:", "(?s)(?:").replace("\\z", "\\Z").removesuffix("\\Z") + "$"


def _ignore_lines(text: str) -> list[tuple[str, bool]]:
    """(pattern over relative paths, whether it ignores) for each line of a .gitignore but comments, in order."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] != "#":
            glob = line.removeprefix("!")
            body = glob_pattern(glob.strip("/").replace("**/", "")).removesuffix("$").removeprefix("(?s)")
            out.append((("^" if glob.startswith("/") else "(^|/)") + body + "(/|$)", glob == line))
    return out


def ignore_patterns(text: str) -> list[str]:
    """The lines of a .gitignore that ignore, as patterns over relative paths."""
    return [pattern for pattern, ignores in _ignore_lines(text) if ignores]


def ignored(path: Column, gitignore: str) -> Column:
    """Whether the last line that matches path ignores it; lines with ! bring paths back."""
    out = F.lit(False)
    for pattern, ignores in _ignore_lines(gitignore):
        out = F.when(F.rlike(path, F.lit(pattern)), F.lit(ignores)).otherwise(out)
    return out


def read_tree(spark: SparkSession, root: str, excludes: list[str] = (), gitignore: str = "") -> DataFrame:
    """Files below root as (path, language, content, size), relative paths; listed and read by the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    path = F.substring_index("path", base, -1)
    files = raw.select(path.alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"))
    for glob in excludes:
        files = files.where(~F.rlike("path", F.lit(glob_pattern(glob))))
    if gitignore:
        files = files.where(~ignored(F.col("path"), gitignore))
    return files.select("path", language_of(F.col("path")).alias("language"), "content", "size")


def visible(path: Column) -> Column:
    """Not hidden, nor in an ignored folder."""
    return ~F.rlike(path, F.lit(r"(^|/)\.")) & ~F.rlike(path, F.lit(rf"(^|/)({'|'.join(map(lambda d: d.replace('.', '[.]'), IGNORED))})/"))


def sources(files: DataFrame, language: str) -> DataFrame:
    """The files of one language that a scan looks at; shell ones without an extension are told by their first line."""
    own = is_shell(F.col("path"), F.col("content")) if language == "shell" else F.col("language") == language
    return files.where(own & visible(F.col("path"))).withColumn("language", F.lit(language))


def languages(files: DataFrame) -> DataFrame:
    return files.where("language IN ('python', 'go', 'java', 'shell')").select("language").distinct()


# Coverage: (path, rate, ord)

def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """The last class of a file counts."""
    rows = spark.read.format("xml").option("rowTag", "class").load(path).select(F.col("_filename").alias("path"), F.col("`_line-rate`").cast("double").alias("rate"), F.monotonically_increasing_id().alias("ord"))
    return rows.groupBy("path").agg(F.max_by("rate", "ord").alias("rate"), F.max("ord").alias("ord"))


def jacoco(spark: SparkSession, path: str) -> DataFrame:
    schema = "_name string, sourcefile array<struct<_name:string,counter:array<struct<_type:string,_missed:long,_covered:long>>>>"
    files = spark.read.format("xml").option("rowTag", "package").schema(schema).load(path).select(F.col("_name").alias("package"), F.explode("sourcefile").alias("f"))
    line = F.filter("f.counter", lambda c: c["_type"] == "LINE")[0]
    total = line["_covered"] + line["_missed"]
    return files.select(F.concat_ws("/", "package", "f._name").alias("path"), F.when(total > 0, line["_covered"] / total).otherwise(1.0).alias("rate"), F.monotonically_increasing_id().alias("ord"))


def go_profile(spark: SparkSession, path: str) -> DataFrame:
    parts = r"^(.+):\d+\.\d+,\d+\.\d+ (\d+) (\d+)$"
    n = lambda k: F.regexp_extract("value", parts, k)
    rows = spark.read.text(path).where(F.rlike("value", F.lit(parts))).select(n(1).alias("path"), n(2).cast("long").alias("statements"), n(3).cast("long").alias("times"))
    covered = F.sum(F.when(F.col("times") > 0, F.col("statements")).otherwise(0))
    return rows.groupBy("path").agg((covered / F.greatest(F.sum("statements"), F.lit(1))).alias("rate")).withColumn("ord", F.lit(0))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """By the report's first SNIFFED bytes: a Go profile, JaCoCo or Cobertura. The executors cut them off."""
    first = spark.read.format("binaryFile").load(path).orderBy("path").select(F.expr(f"substring(content, 1, {SNIFFED})")).first()
    head = bytes(first[0]).decode("utf-8", "replace") if first else ""
    if head.startswith("mode:"):
        return go_profile(spark, path)
    return jacoco(spark, path) if "<report" in head else cobertura(spark, path)


# Version logs

def git_log(entries: DataFrame) -> DataFrame:
    """entries(value), a commit each: 'commit<TAB>epoch<TAB>author' and then its paths, a line each; to (path, author, ts)."""
    lines = F.split("value", "\n")
    head = F.split(lines[0], "\t")
    rows = entries.where(F.contains("value", F.lit("\t"))).select(F.timestamp_seconds(head[1].cast("long")).alias("ts"), head[2].alias("author"), F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("path"))
    return rows.where(F.trim("path") != "").select("path", "author", "ts")


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """A log written with an empty line between commits."""
    return git_log(spark.read.text(path, lineSep="\n\n"))


def recent(commits: DataFrame, now: str, days: int) -> DataFrame:
    return commits.where(F.col("ts") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {days} DAYS"))


# Snapshots

def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """JSON by Spark; a YAML document by the driver."""
    if path.endswith((".yaml", ".yml")):
        import json

        import yaml

        document = json.dumps(yaml.safe_load(Path(path).read_text()), default=str)
        return spark.createDataFrame([(document,)], "value string").select(F.from_json("value", SNAPSHOT).alias("s")).select("s.*")
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)


def snapshot_tables(snapshot: DataFrame) -> dict[str, DataFrame]:
    """A snapshot's documents as files, issues and deps; an issue without an id is rule:path:line."""
    base = snapshot.select(F.col("metadata.project_name").alias("project"), F.col("metadata.version").alias("version"), F.posexplode("files").alias("ord", "f"))
    files = base.select("project", "version", F.col("f.path").alias("path"), F.col("f.language").alias("language"), F.col("f.hash").alias("hash"), F.col("f.lines").alias("lines"), F.col("f.metrics.lines_of_code").alias("loc"), F.col("f.risk.risk_score").alias("score"), F.col("f.risk.level").alias("level"), "ord")
    issue = base.select("project", "version", F.col("f.path").alias("path"), F.col("ord").alias("file_ord"), F.posexplode("f.issues").alias("ord", "i"))
    known = F.coalesce("i.id", F.concat_ws(":", "i.rule_id", "path", F.col("i.location.line").cast("string")))
    issues = issue.select("project", "version", "path", known.alias("id"), F.col("i.rule_id").alias("rule_id"), F.col("i.severity").alias("severity"), F.col("i.message").alias("message"), F.col("i.location.line").alias("line"), (F.col("file_ord").cast("long") * 2**20 + F.col("ord")).alias("ord"))
    deps = snapshot.select(F.explode("dependencies.edges").alias("e")).select("e.src", "e.dst")
    return {"files": files, "issues": issues, "deps": deps}


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    """A version's rows: only its folder is read; none if there is no such version."""
    return spark.read.parquet(root).where(F.col("version") == version)


# Configuration

def merged(*layers: dict) -> dict:
    """Later layers win; maps merge, lists and values replace."""
    out: dict = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def read_config(defaults: dict, *paths: str) -> dict:
    import yaml

    return merged(defaults, *(yaml.safe_load(Path(p).read_text()) for p in paths if Path(p).exists()))


def get_dotted(config: dict, key: str, default=None):
    for part in key.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def set_dotted(config: dict, key: str, value) -> dict:
    head, _, rest = key.partition(".")
    own = config.get(head)
    return config | {head: set_dotted(own if isinstance(own, dict) else {}, rest, value) if rest else value}
