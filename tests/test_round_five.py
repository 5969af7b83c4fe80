"""Streams beside one that expires, stores without a change, large buckets, and token counts by slices."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from ashlar.functions import tokens
from ashlar.operators.graph import Graph
from ashlar.sources import store as s
from ashlar.streaming import updates as up

NODE, EDGE = "id string, type string, name string", "source string, target string, type string"


def test_sessions_come_out_beside_a_stream_that_expires(spark, tmp_path):
    """expiry switches batches without data off for its session, which last sessions wait for."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    (tmp_path / "e").mkdir()
    rows = [("a.py", "create", "2024-01-01T00:00:00"), ("z.py", "create", "2024-01-01T01:00:00")]
    (tmp_path / "e" / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "change_type", "ts"), row))) for row in rows))
    out = str(tmp_path / "out")
    up.coalesced_stream(up.read_events(spark, str(tmp_path / "e"))).writeStream.option("checkpointLocation", str(tmp_path / "c")).option("path", out).format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [r.path for r in spark.read.parquet(out).collect()] == ["a.py"]


def graph(spark, n):
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("function").alias("type"), F.lit("x").alias("name"))
    edges = spark.range(n).select(F.lit("n0").alias("source"), F.concat(F.lit("n"), "id").alias("target"), F.lit("calls").alias("type"))
    return Graph(nodes, edges)


def test_a_batch_without_rows_changes_nothing(spark, tmp_path):
    """It emptied the first bucket of nodes before."""
    store = s.GraphStore(spark, str(tmp_path / "s"), 2)
    store.save(graph(spark, 20))
    none = graph(spark, 0)
    store.save(none)
    store.change(spark.createDataFrame([], "path string, change string"), none)
    assert store.graph.nodes.count() == 20 and store.graph.edges.count() == 20


def test_large_buckets_are_dealt_out(spark, tmp_path, monkeypatch):
    """A node with all edges was one task's work, and clearing read and joined every row."""
    monkeypatch.setattr(s, "FILE_ROWS", 100)
    store = s.GraphStore(spark, str(tmp_path / "s"), 2)
    store.save(graph(spark, 1000))
    sizes = [r["n"] for r in store.part("out").groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 1000 and len(sizes) > 2 and max(sizes) < 700
    assert store.graph.nodes.count() == store.graph.nodes.distinct().count() == 1000
    store.save(graph(spark, 5))
    assert store.graph.nodes.count() == store.graph.edges.count() == 1000
    read = []
    monkeypatch.setattr(s.GraphStore, "at", lambda *a: read.append(a))
    store.clear()
    assert not read and store.graph.nodes.isEmpty() and store.graph.edges.isEmpty() and store.part("into").isEmpty()
    monkeypatch.undo()
    store.save(graph(spark, 3))
    assert store.graph.edges.count() == 3


def test_tokens_are_counted_by_slices_of_bytes():
    texts = pa.array(["ab", None, "", "abcd", "é" * 5, "x"])
    found = [x.to_pylist() for x in tokens.slices(texts, 6)]
    assert found == [["ab", None, "", "abcd"], ["é" * 5], ["x"]]
    assert list(tokens.slices(pa.array([], pa.string()))) == []
