"""Incremental maintenance: file events to coalesced changes to graph deltas, as a streaming query.

Events of a path that follow one another within the interval are one change (a session); a delete among them wins, else
several are a modification. Each micro-batch is applied to the buckets of the stored graph that it touches, under its
own name, so that a repeated batch changes nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ashlar.operators.graph import Graph, add_edges, add_nodes, delete_nodes, reach
from ashlar.sources.readers import visible
from ashlar.sources.store import GraphStore

EVENT = "path string, change_type string, ts timestamp"
WATCHED = ("py", "go", "java", "js", "ts", "jsx", "tsx")


def watched(path: Column, extensions=WATCHED) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions) & visible(path)


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of events from JSON files; what doesn't fit a batch waits for the next, nothing is dropped."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def change_type(kinds: Column, n: Column) -> Column:
    """Of a session's kinds (an array, in any order) and their number."""
    return F.when(F.array_contains(kinds, "delete"), "delete").when(n > 1, "modify").otherwise(kinds[0])


def coalesced(events: DataFrame, interval_us: int = 1_000_000) -> DataFrame:
    """events(path, change_type, ts), a table, to (path, change, events, first, last). A gap of exactly the interval parts
    sessions."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    order = Window.partitionBy("path").orderBy("ts")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)
    marked = events.withColumn("fresh", F.coalesce((gap >= interval_us).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return _changes(numbered.groupBy("path", "session"))


def coalesced_stream(events: DataFrame, interval_us: int = 1_000_000, late: str = "10 seconds") -> DataFrame:
    """The same over a stream: a session comes out once the watermark has passed it, after the last data in a batch without
    any; such batches are switched on here, as ashlar.streaming.expiry leaves them off in its session. Session windows join
    gaps that equal the interval, so the window is a microsecond shorter."""
    events.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    window = F.session_window("ts", f"{interval_us - 1} microseconds")
    return _changes(events.withWatermark("ts", late).groupBy("path", window.alias("session")))


def _changes(grouped) -> DataFrame:
    found = grouped.agg(F.collect_set("change_type").alias("kinds"), F.count(F.lit(1)).alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return found.select("path", change_type(F.col("kinds"), F.col("events")).alias("change"), "events", "first", "last")


def apply_changes(graph: Graph, changes: DataFrame, built: Graph, keep_shared: bool = False) -> Graph:
    """changes(path, change): a deleted file takes along the nodes within one step of it (only those it contains, if
    keep_shared); any other change replaces what the file contains by its part of built."""
    file_of = F.concat(F.lit("file:"), "path").alias("id")
    gone = changes.where("change = 'delete'").select(file_of)
    step = graph.edges.where("type = 'contains'") if keep_shared else graph.edges
    graph = delete_nodes(graph, reach(step, gone, 1).select("id"))
    touched = changes.where("change <> 'delete'").select(file_of)
    old = reach(graph.edges.where("type = 'contains'"), touched, 1).where("depth > 0").select("id")
    fresh = reach(built.edges, touched, 1).select("id")
    graph = delete_nodes(graph, old.join(fresh, "id", "left_anti"))
    graph = add_nodes(graph, built.nodes.join(fresh, "id", "left_semi"))
    own = built.edges.join(fresh.withColumnRenamed("id", "source"), "source", "left_semi").select(*built.edges.columns)
    return add_edges(graph, own)


def maintain(events: DataFrame, store: str, build: Callable[[DataFrame], Graph], checkpoint: str, interval_us: int = 1_000_000):
    """Starts the query: each batch's changes go to the buckets of the GraphStore at store that they touch; a batch that
    comes again changes nothing. build makes a graph of the paths(path) it gets."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.groupBy("path").agg(F.max_by("change", "last").alias("change")).persist()
        built = build(batch.where("change <> 'delete'").select("path"))
        GraphStore(batch.sparkSession, store).change(batch, built, batch=f"{stream}-{number}")
        batch.unpersist()

    return coalesced_stream(events.where(watched(F.col("path"))), interval_us).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")


def newest(spark: SparkSession, store: str) -> int:
    """The last complete generation: both of its folders hold the marker that a finished write leaves."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = []
    for status in fs.listStatus(root):
        found = re.fullmatch(r"g=(\d+)", status.getPath().getName())
        if found and all(fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), f"{part}/_SUCCESS")) for part in ("nodes", "edges")):
            done.append(int(found[1]))
    return max(done)


def forced(paths: DataFrame, existing: DataFrame, ts: str) -> DataFrame:
    """An event for each path: a modification if the file exists, else a delete."""
    there = existing.select("path").distinct().withColumn("there", F.lit(True))
    return paths.join(there, "path", "left").select("path", F.when(F.col("there"), "modify").otherwise("delete").alias("change_type"), F.to_timestamp(F.lit(ts)).alias("ts"))


def statistics(changes: DataFrame) -> DataFrame:
    """One row over coalesced changes: events and changes processed, deletes among them, mean session length in seconds."""
    length = (F.unix_micros("last") - F.unix_micros("first")) / 1e6
    return changes.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.count(F.lit(1)).alias("changes"), F.count_if(F.col("change") == "delete").alias("deletes"), F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_seconds"))


def unexpired(rows: DataFrame, now: str, seconds: int = 3600) -> DataFrame:
    """rows(updated_at, ...) whose time to live hasn't run out."""
    return rows.where(F.col("updated_at") + F.expr(f"INTERVAL {seconds} SECONDS") > F.to_timestamp(F.lit(now)))
