"""Exact deduplication by a streaming query with keyed state on disk. DataFrame operations only.

A first pass over the texts writes a narrow table: digest, identifier, locator (file key and place in the file).
A streaming aggregation reads it; its state, in RocksDB and without expiry, keeps for each digest the row that stays
(smallest identifier, its locator) and the number of rows seen. Each batch writes the groups it changed, the last batch
that names a group has its final values. So new files only cost their own rows.

A hit is a row whose digest another row has too. Only hits' texts are read again, by bitmaps of their places, and compared
byte for byte: within a digest the least and the greatest text must be one. Partial aggregation sends one text for each
digest and task, however many copies it has. Rows of a digest with different texts are grouped anew by digest and text, so
that even colliding digests give right groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ashlar.llm.common import BROADCAST_KEYS, FILE, ROW, SPACE, located, materialise, only_rows, shared_path, table, without_rows

#: State on disk; small stores don't reserve room ahead, and a batch uploads what it changed, a file for each store.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


def normalised(text: Column | str = "text") -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _smallest() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", FILE, ROW)).alias("keep")


def stream_groups(rows: DataFrame, out: str, checkpoint: str, files_per_batch: int | None = None, partitions: int | None = None) -> DataFrame:
    """Runs the stateful query over the Parquet files of rows(digest, doc_id, key) that checkpoint has not seen yet.

    Returns the groups (digest, keep, n) after all batches written below out, earlier calls included. The state has so
    many partitions from a checkpoint's first run on; a quarter of those of a shuffle unless told, as a group takes a
    hundred bytes or so where a text takes thousands.
    """
    spark = rows.sparkSession
    state = _STATE | {"spark.sql.shuffle.partitions": str(partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))}
    folders = {f.rpartition("/")[0] for f in rows.inputFiles()}
    own = spark.newSession()  # the state's settings hold for this query alone
    for key, value in dict(spark.conf.getAll).items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in state.items():
        own.conf.set(key, value)
    reader = own.readStream.schema(rows.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    for folder in sorted(folders):
        seen = reader.parquet(folder).groupBy("digest").agg(_smallest(), F.count(F.lit(1)).alias("n"))
        write = lambda groups, batch: groups.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        run = seen.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
        run.trigger(availableNow=True).start().awaitTermination()
    shape = rows.groupBy("digest").agg(_smallest(), F.count(F.lit(1)).alias("n")).schema
    if not folders:
        return spark.createDataFrame([], shape)
    changed = spark.read.schema(StructType([*shape, StructField("batch", IntegerType())])).option("basePath", out).parquet(out)
    latest = changed.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("last"))
    return latest.select("digest", "last.keep", "last.n")


def groups_of(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """A row for each row of docs(doc_id, text): its key, doc_id, digest, keep_id, group_size, kept.

    Of rows with equal normalised texts the one with the smallest doc_id stays; rows that repeat even the doc_id are told
    apart by their place, so one stays. Null texts are empty, a null doc_id comes last. An empty table gives an empty
    result; other columns are not looked at.
    """
    spark, docs = docs.sparkSession, located(docs)
    rows = materialise(_texts(docs, digest).drop("whole"), "digests")
    groups = materialise(stream_groups(rows, shared_path(spark, "groups"), shared_path(spark, "state"), files_per_batch), "latest")
    hits = rows.join(groups.where("n > 1").select("digest"), "digest", "left_semi")
    same = only_rows(docs, hits, keys=BROADCAST_KEYS)
    bounds = _texts(same, digest).groupBy("digest").agg(F.min("whole").alias("first"), F.max("whole").alias("last"))
    colliding = materialise(bounds.where("first <> last").select("digest"), "colliding")
    found = rows.join(groups, "digest")
    if not colliding.isEmpty():
        mixed = materialise(_texts(only_rows(docs, rows.join(colliding, "digest", "left_semi"), keys=BROADCAST_KEYS), digest), "mixed")
        anew = mixed.groupBy("digest", "whole").agg(_smallest(), F.count(F.lit(1)).alias("n"))
        anew = mixed.join(anew, ["digest", "whole"]).select(FILE, ROW, F.col("keep").alias("own_keep"), F.col("n").alias("own_n"))
        found = found.join(anew, [FILE, ROW], "left").withColumn("n", F.coalesce("own_n", "n")).withColumn("keep", F.coalesce("own_keep", "keep"))
    stays = (F.col("keep")[FILE] == F.col(FILE)) & (F.col("keep")[ROW] == F.col(ROW))
    return found.select(FILE, ROW, "doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"))


def _texts(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    whole = docs.select(FILE, ROW, F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("whole"))
    return whole.withColumn("digest", digest(F.col("whole")))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs with one row of each group of equal texts, that with the smallest doc_id; the columns stay as they are.

    Null texts are empty texts and equal to them; rows that repeat even the doc_id leave one; null doc_ids come last. An
    empty table gives an empty one.
    """
    rows = located(docs)
    gone = groups_of(rows, digest).where("NOT kept").select(FILE, ROW)
    return without_rows(rows, gone, keys=BROADCAST_KEYS).select(*docs.columns)


def op8_exact_dedup(spark, sf_dir):
    found = groups_of(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH whole AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM whole WINDOW same AS (PARTITION BY text_sha256)
"""
QUERIES, ORACLES = {"op8_exact_dedup": op8_exact_dedup}, {"op8_exact_dedup": ORACLE}
