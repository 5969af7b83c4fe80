"""The bucketed graph store against the plain operators over whole graphs: rows, files touched, batches that come again."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ashlar.operators import graph as g
from ashlar.sources.store import GraphStore
from ashlar.streaming import updates as up

NODE, EDGE = "id string, type string, name string", "source string, target string, type string"


def graph_of(spark, nodes, edges):
    return g.Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def content(graph):
    node = lambda r: tuple(r.asDict().get(c) for c in ("id", "type", "name"))
    return sorted(map(node, graph.nodes.collect()), key=repr), sorted((r.source, r.target, r.type) for r in graph.edges.collect())


def files(path):
    """Data files of the store by bucket."""
    return {(part, bucket, name) for part in ("nodes", "out", "into") for bucket, _, names in os.walk(f"{path}/{part}") for name in names if name.endswith(".parquet")}


def buckets(changed):
    return {(part, bucket.rpartition("bucket=")[2]) for part, bucket, _ in changed}


@pytest.fixture
def random_graph(spark):
    rng = random.Random(1)
    nodes = [(f"n{i}", rng.choice(["file", "function"]), str(i)) for i in range(60)]
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice(["calls", "contains"])) for _ in range(150)]
    return graph_of(spark, nodes, edges)


def test_same_as_the_plain_operators(spark, tmp_path, random_graph):
    store = GraphStore(spark, str(tmp_path / "s"), 8)
    store.save(random_graph)
    plain = g.add_edges(g.Graph(random_graph.nodes, random_graph.edges.limit(0)), random_graph.edges)
    assert content(store.graph) == content(plain)
    more = graph_of(spark, [("n1", "function", "new"), ("x", "file", None), ("x", "file", None), (None, "file", "none")], [("x", "n1", "calls"), ("x", "gone", "calls"), ("n2", "x", "calls"), ("n2", "x", "calls")])
    store.save(more)
    plain = g.add_edges(g.add_nodes(plain, more.nodes.where("id IS NOT NULL")), more.edges)
    assert content(store.graph) == content(plain)
    ids = spark.createDataFrame([("n3",), ("n2",), ("nowhere",)], "id string")
    store.delete_nodes(ids)
    plain = g.delete_nodes(plain, ids)
    assert content(store.graph) == content(plain)
    some = plain.edges.limit(3).collect()
    keys = spark.createDataFrame([(some[0].source, some[0].target, "*"), (some[1].source, some[1].target, some[1].type), ("n1", "n2", "none")], EDGE)
    store.delete_edges(keys)
    plain = g.delete_edges(plain, keys)
    assert content(store.graph) == content(plain)
    new = graph_of(spark, [(f"n{i}", "function", "v2") for i in range(20, 50)] + [("y", "file", "y")], [("y", "n21", "calls"), ("n22", "y", "calls")])
    delta = g.diff(plain, new)
    store.apply(delta, new)
    assert content(store.graph) == content(g.apply_delta(plain, delta, new)) == content(new)
    # The index by target has the same edges.
    assert sorted((r.source, r.target, r.type) for r in store.part("into").collect()) == content(store.graph)[1]
    store.clear()
    assert content(store.graph) == ([], [])


def test_a_change_touches_its_buckets_only(spark, tmp_path, random_graph):
    path = str(tmp_path / "s")
    store = GraphStore(spark, path, 32)
    store.save(random_graph)
    before = files(path)
    store.save_nodes(spark.createDataFrame([("n7", "function", "changed")], NODE))
    after = files(path)
    own = spark.range(1).select(store.bucket_of(F.lit("n7"))).first()[0]
    assert buckets(before ^ after) == {("nodes", str(own))}
    store.delete_nodes(spark.createDataFrame([("n9",)], "id string"))
    touched = buckets(after ^ files(path))
    assert 0 < len(touched) < 60 and len([x for x in touched if x[0] == "nodes"]) == 1
    ends = [(r.source, r.target) for r in random_graph.edges.where("source = 'n9' OR target = 'n9'").collect()]
    bucket = {i: spark.range(1).select(store.bucket_of(F.lit(i))).first()[0] for pair in ends for i in pair}
    assert touched == {("nodes", str(bucket["n9"]))} | {("out", str(bucket[s])) for s, _ in ends} | {("into", str(bucket[t])) for _, t in ends}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, random_graph):
    path = str(tmp_path / "s")
    store = GraphStore(spark, path, 8)
    assert store.save(random_graph, 1) is True
    before, rows = files(path), content(store.graph)
    other = graph_of(spark, [("z", "file", "z")], [])
    assert store.save(other, 1) is False and GraphStore(spark, path, 8).save(other, 1) is False
    assert files(path) == before and content(store.graph) == rows and store.numbers() == [1]


def test_a_batch_that_broke_off_is_put_in_place_as_it_was_staged(spark, tmp_path, random_graph):
    path = str(tmp_path / "s")
    store = GraphStore(spark, path, 8)
    store.save(random_graph)
    want = content(g.add_nodes(store.graph, spark.createDataFrame([("n1", "file", "second")], NODE)))
    # Staged, and in place in part: the marker is missing.
    change = graph_of(spark, [("n1", "file", "second")], [])
    store._stage(f"{path}/batches/2", change.nodes, None, None, None)
    store._mark("batches/2", "staged")
    assert store.numbers() == [1]
    assert GraphStore(spark, path, 8).save(graph_of(spark, [("n1", "file", "recomputed otherwise")], []), 2) is True
    assert content(GraphStore(spark, path, 8).graph) == want
    # Broken off while it was staged: computed anew.
    store._stage(f"{path}/batches/3", change.nodes, None, None, None)
    assert store.save_nodes(spark.createDataFrame([("n2", "file", "third")], NODE)) and content(store.graph)[0] != want[0]


def test_changes_are_those_of_the_whole_graph(spark, tmp_path, random_graph):
    nodes = [(f"file:f{i}", "file", None) for i in range(6)] + [(f"function:f{i}:{k}", "function", "old") for i in range(6) for k in range(4)] + [("module:m", "module", None)]
    edges = [(f"file:f{i}", f"function:f{i}:{k}", "contains") for i in range(6) for k in range(4)] + [(f"file:f{i}", "module:m", "imports") for i in range(6)] + [("function:f1:1", "function:f2:2", "calls"), ("function:f5:0", "function:f1:3", "calls")]
    whole = graph_of(spark, nodes, edges)
    changes = spark.createDataFrame([("f0", "delete"), ("f1", "modify"), ("f9", "create"), ("f3", "modify")], "path string, change string")
    built = graph_of(spark, [("file:f1", "file", None), ("function:f1:1", "function", "new"), ("file:f9", "file", None), ("function:f9:0", "function", "new")], [("file:f1", "function:f1:1", "contains"), ("file:f9", "function:f9:0", "contains"), ("function:f9:0", "function:f2:0", "calls")])
    for keep in (True, False):
        store = GraphStore(spark, str(tmp_path / f"s{keep}"), 8)
        store.save(whole)
        store.change(changes, built, keep)
        assert content(store.graph) == content(up.apply_changes(whole, changes, built, keep))


def test_pushdown(spark, tmp_path, random_graph, capfd):
    store = GraphStore(spark, str(tmp_path / "s"), 8)
    store.save(random_graph)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    own = spark.range(1).select(store.bucket_of(F.lit("n5"))).first()[0]
    found = plan(store.lookup("n5"))
    assert f"bucket#" in found and f"= {own})" in found.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(id,n5)" in found
    assert len(store.lookup("n5").inputFiles()) and store.lookup("n5").count() == 1 and store.lookup("none").count() == 0
    assert "EqualTo(type,function)" in plan(store.query_nodes("function")) and "EqualTo(source,n5)" in plan(store.edges("n5"))
    with pytest.raises(KeyError):
        store.node("none")


def test_an_empty_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"), 4)
    none = graph_of(spark, [], [])
    store.save(none)
    assert content(store.graph) == ([], []) and store.numbers() == [1]
    store.save(graph_of(spark, [("a", "file", None)], [("a", "a", "calls")]))
    assert content(store.graph) == ([("a", "file", None)], [("a", "a", "calls")])
