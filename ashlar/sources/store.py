"""A graph store over Parquet folders that writes what changed.

Nodes lie in buckets by a hash of their id, edges in buckets by a hash of their source, and once more, as keys only, by a
hash of their target, so that a node's edges at either end are found without a scan. A change reads and rewrites the
buckets it touches: their new content is staged as a batch of its own and then replaces the old one by dynamic partition
overwrite. Inside a bucket rows are sorted by type and id, with a Bloom filter on ids, so that scans of a type and look-ups
skip row groups.

A batch has a number. Once it is staged whole it can be put in place any number of times with the same result, and one that
is in place is known by its marker, so a batch that comes again, after a failure or from a stream, changes nothing. One
writer at a time; a reader that needs all parts of one batch together reads between batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.operators import graph as g

BUCKETS = 64
#: Rows that one task sorts and writes, about; a larger bucket is several files.
FILE_ROWS = 500_000
_PARTS = {"nodes": "id", "out": "source", "into": "target"}


class GraphStore:
    """Every touched bucket keeps one row without key, so that it is replaced even where nothing is left in it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """buckets holds for a new store; one that is there keeps its own number."""
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schemas: dict = {}
        layout, fs = self._fs("layout")
        if fs.exists(layout):
            self.buckets = int(fs.listStatus(layout)[0].getPath().getName())

    # Folders

    def _fs(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, *parts: str) -> bool:
        path, fs = self._fs(*parts)
        return fs.exists(path)

    def numbers(self) -> list[int]:
        """Numbered batches that are in place; others have names."""
        path, fs = self._fs("batches")
        if not fs.exists(path):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and self._there("batches", n, "done"))

    # Reading

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def part(self, name: str) -> DataFrame | None:
        """A part with its buckets, None before anything was written."""
        if not self._there(name):
            return None
        path = f"{self.path}/{name}"
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.option("mergeSchema", "true").parquet(path).schema
        return self.spark.read.schema(self.schemas[name]).parquet(path).where(F.col(_PARTS[name]).isNotNull())

    @property
    def graph(self) -> g.Graph:
        return g.Graph(self.part("nodes").drop("bucket"), self.part("out").drop("bucket"))

    def at(self, name: str, keys: DataFrame) -> DataFrame | None:
        """The rows of a part whose key is in keys(key); only their buckets are read."""
        found = self.part(name)
        if found is None:
            return None
        own = self._touched([keys])
        return found.where(F.col("bucket").isin(own)).join(keys.select(F.col("key").alias(_PARTS[name])), _PARTS[name], "left_semi").drop("bucket")

    def _touched(self, keys: list[DataFrame]) -> list[int]:
        """Buckets of the keys; the number of buckets bounds what comes to the driver."""
        found: set[int] = set()
        for some in keys:
            found |= {r[0] for r in some.where("key IS NOT NULL").select(self.bucket_of(F.col("key")).alias("b")).distinct().collect()}
        return sorted(found)

    def subgraph(self, root: str, depth: int = 3) -> g.Graph:
        return g.subgraph(self.graph, root, depth)

    def query_nodes(self, kind: str | None = None, filters: dict | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        return g.query_nodes(self.graph.nodes, kind, filters, limit, offset)

    def lookup(self, id: str) -> DataFrame:
        """The row of a node, if there is one, from its bucket."""
        return self.part("nodes").where((F.col("bucket") == self.bucket_of(F.lit(id))) & (F.col("id") == id)).drop("bucket")

    def node(self, id: str) -> DataFrame:
        """Its row; raises if there is none."""
        found = self.lookup(id)
        if found.isEmpty():
            raise KeyError(id)
        return found

    def has_node(self, id: str) -> bool:
        return not self.lookup(id).isEmpty()

    def edges(self, source: str, target: str | None = None, kind: str | None = None) -> DataFrame:
        own = self.part("out").where((F.col("bucket") == self.bucket_of(F.lit(source))) & (F.col("source") == source)).drop("bucket")
        return g.edges_from(own, source, target, kind)

    # Writing

    def write(self, nodes: DataFrame | None = None, gone: DataFrame | None = None, edges: DataFrame | None = None, without: DataFrame | None = None, batch: int | str | None = None, everything: bool = False) -> bool:
        """One batch: everything, or without(source, target, type; type * is any) go, gone(id) go with their edges, nodes come (the new row
        wins), then edges that are new and whose ends are there. False if a batch of this number is in place already."""
        number = batch if batch is not None else max(self.numbers(), default=0) + 1
        home = f"batches/{number}"
        if self._there(home, "done"):
            return False
        staged = [p for p in _PARTS if self._there(home, p)]
        if not self._there("layout"):
            self._mark("layout", str(self.buckets))
        if not (self._there(home, "staged") and staged):
            held = [None if df is None else df.persist() for df in (nodes, gone, edges, without)]  # each is read for its buckets and its rows
            staged = self._stage_empty(f"{self.path}/{home}") if everything else self._stage(f"{self.path}/{home}", *held)
            self._mark(home, "staged")
            for df in held:
                if df is not None:
                    df.unpersist()
        for name in staged:
            self.schemas.pop(name, None)
            rows = self._dealt(self.spark.read.parquet(f"{self.path}/{home}/{name}"), name).sortWithinPartitions("bucket", "type", _PARTS[name])
            writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{_PARTS[name]}", "true")
            writer.partitionBy("bucket").parquet(f"{self.path}/{name}")
        self._mark(home, "done")
        for name in staged:
            path, fs = self._fs(home, name)
            fs.delete(path, True)
        return True

    def _dealt(self, rows: DataFrame, name: str) -> DataFrame:
        """rows by bucket; where there are many, a bucket's rows by a hash of their whole key too, so that what a task sorts
        doesn't grow with the store, nor with the edges of one node."""
        most = max(1, -(-rows.count() // FILE_ROWS))
        slices = -(-most // self.buckets)
        if slices == 1 and most == 1:
            return rows.repartition("bucket")
        keys = ["id"] if name == "nodes" else g.EDGE_KEY
        return rows.repartition(slices * self.buckets, "bucket", F.pmod(F.hash(*keys), F.lit(slices)))

    def _mark(self, *parts: str) -> None:
        path, fs = self._fs(*parts)
        fs.create(path, True).close()

    def _stage(self, home: str, nodes, gone, edges, without) -> list[str]:
        key = lambda df, column: df.select(F.col(column).alias("key"))
        keyed = lambda df: df.select(*g.EDGE_KEY)
        staged = []
        old, ids = self.part("nodes"), [key(df, "id") for df in (nodes, gone) if df is not None]
        if nodes is not None:
            nodes = nodes.where("id IS NOT NULL").dropDuplicates(["id"])
        if ids:
            touched = self._touched(ids)
            kept = old.where(F.col("bucket").isin(touched)).drop("bucket") if old is not None else None
            if kept is not None:
                for df in (gone, nodes):
                    kept = kept if df is None else kept.join(df.select("id"), "id", "left_anti")
            new = kept if nodes is None else nodes if kept is None else kept.unionByName(nodes, allowMissingColumns=True)
            if new is not None and (touched or old is None):  # a batch without nodes leaves all buckets as they are
                self._put(home, "nodes", new, touched)
                staged.append("nodes")
        out, into = self.part("out"), self.part("into")
        # Edges that go: those named, and those at nodes that go, found by either end.
        lost = None
        if out is not None:
            every = without.where("type = '*'").select("source", "target") if without is not None else None
            found = [self.at("out", key(without, "source")).join(every, ["source", "target"], "left_semi"), self.at("out", key(without, "source")).join(without.select(*g.EDGE_KEY), g.EDGE_KEY, "left_semi")] if without is not None else []
            if gone is not None:
                found += [self.at("out", key(gone, "id")), self.at("into", key(gone, "id"))]
            for df in found:
                lost = keyed(df) if lost is None else lost.unionByName(keyed(df))
            lost = None if lost is None else lost.distinct()
        if edges is not None:
            edges = edges.dropDuplicates(g.EDGE_KEY)
            there = self.spark.read.parquet(f"{home}/nodes").select("id") if "nodes" in staged else None
            for end in ("source", "target"):
                known = key(edges, end)
                ends = self.at("nodes", known)
                own = None if ends is None else ends.select("id")
                if own is not None and there is not None:  # the batch's own buckets hold what is there after it
                    own = own.where(~self.bucket_of(F.col("id")).isin(self._touched(ids)))
                ids_there = there if own is None else own if there is None else own.unionByName(there)
                if ids_there is None:
                    edges = edges.limit(0)
                else:
                    edges = edges.join(ids_there.where("id IS NOT NULL").select(F.col("id").alias(end)).distinct(), end, "left_semi")
        for name, part, end in (("out", out, "source"), ("into", into, "target")):
            keys = [key(df, end) for df in (lost, edges) if df is not None]
            if not keys:
                continue
            touched = self._touched(keys)
            if not touched and part is not None:
                continue
            kept = part.where(F.col("bucket").isin(touched)).drop("bucket") if part is not None else None
            if kept is not None and lost is not None:
                kept = kept.join(lost, g.EDGE_KEY, "left_anti")
            new = None if edges is None else edges if name == "out" else keyed(edges)
            if new is not None and kept is not None:
                new = kept.unionByName(new.join(keyed(kept), g.EDGE_KEY, "left_anti"), allowMissingColumns=True)
            self._put(home, name, new if new is not None else kept, touched)
            staged.append(name)
        return staged

    def _stage_empty(self, home: str) -> list[str]:
        """The buckets of all parts without their rows."""
        staged = [name for name in _PARTS if self._there(name)]
        for name in staged:
            self._put(home, name, self.part(name).drop("bucket").where("false"), list(range(self.buckets)))
        return staged

    def _put(self, home: str, name: str, rows: DataFrame, touched: list[int]) -> None:
        rows = rows.withColumn("bucket", self.bucket_of(F.col(_PARTS[name])))
        empty = self.spark.createDataFrame([(b,) for b in touched] or [(0,)], "bucket int")
        rows.unionByName(empty, allowMissingColumns=True).write.mode("overwrite").parquet(f"{home}/{name}")

    def save(self, graph: g.Graph, batch: int | str | None = None) -> bool:
        """Nodes by id, the new row wins; edges as a set, dangling ones left out."""
        return self.write(nodes=graph.nodes, edges=graph.edges, batch=batch)

    def save_nodes(self, nodes: DataFrame) -> bool:
        return self.write(nodes=nodes)

    def save_edges(self, edges: DataFrame) -> bool:
        return self.write(edges=edges)

    def delete_nodes(self, ids: DataFrame) -> bool:
        return self.write(gone=ids)

    def delete_edges(self, keys: DataFrame) -> bool:
        return self.write(without=keys)

    def apply(self, delta: DataFrame, new: g.Graph, batch: int | str | None = None) -> bool:
        """A delta of ashlar.operators.graph.diff; new holds the rows to add."""
        ids = delta.where("op IN ('add_node', 'update_node')").select("id")
        return self.write(
            nodes=new.nodes.join(ids, "id", "left_semi"), gone=delta.where("op = 'delete_node'").select("id"),
            edges=new.edges.join(delta.where("op = 'add_edge'").select(*g.EDGE_KEY), g.EDGE_KEY, "left_semi"), without=delta.where("op = 'delete_edge'").select(*g.EDGE_KEY), batch=batch,
        )

    def change(self, changes: DataFrame, built: g.Graph, keep_shared: bool = False, batch: int | str | None = None) -> bool:
        """changes(path, change) and the graph built of the changed paths: what ashlar.streaming.updates.apply_changes does to
        a whole graph, from the files' buckets."""
        file_of = F.concat(F.lit("file:"), "path").alias("key")
        gone, touched = changes.where("change = 'delete'").select(file_of), changes.where("change <> 'delete'").select(file_of)
        fresh = g.reach(built.edges, touched.select(F.col("key").alias("id")), 1).select("id")
        lost = gone.select(F.col("key").alias("id"))
        if self.part("out") is not None:
            step, own = self.at("out", gone), self.at("out", touched).where("type = 'contains'")
            step = step.where("type = 'contains'") if keep_shared else step
            lost = lost.union(step.select("target")).union(own.select("target").distinct().join(fresh.withColumnRenamed("id", "target"), "target", "left_anti"))
        edges = built.edges.join(fresh.withColumnRenamed("id", "source"), "source", "left_semi").select(*built.edges.columns)
        return self.write(nodes=built.nodes.join(fresh, "id", "left_semi"), gone=lost.distinct(), edges=edges, batch=batch)

    def clear(self) -> None:
        """All nodes and edges go, as one batch: every bucket that is there becomes empty, for which no row is read."""
        if self._there("nodes"):
            self.write(everything=True)
