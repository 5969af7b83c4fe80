"""What the training-data operators share: words, row keys, tables in the shared folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word and a run of white space, as Java and Python patterns.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Columns that name a row of a scan; the prefix keeps them apart from columns of the input.
FILE, ROW = "__lode_file", "__lode_row"
#: What is said of a row, one bit a row, goes out in blocks of BLOCK_ROWS rows of a file (4 KB a bit) and in waves of files
#: with at most BROADCAST_KEYS rows (64 MB a bit).
BLOCK, NUMBER = "__lode_block", "__lode_number"
BLOCK_ROWS = 32_768
BROADCAST_KEYS = 16_384 * BLOCK_ROWS
#: Arrow batches are this large at most, unless the session has a bound of its own: texts may be long, and Spark and Python
#: both hold a batch.
BATCH_BYTES, _BATCH = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}
_made: list[str] = []
_kept: dict = {}


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with a bound on the bytes of Arrow batches."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def kept(name: str, make: Callable):
    """What a Python worker keeps for its next tasks: one object at a time, so that an operator's model or tokenizer goes
    when the next operator's comes."""
    if name not in _kept:
        _kept.clear()
        gc.collect()
        _kept[name] = make()
    return _kept[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only a local master may go without; it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.setdefault("root", f"file://{tempfile.mkdtemp(prefix='ashlar-')}")
    _made.append(f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def clean(spark: SparkSession) -> None:
    """Deletes the tables and states that this process has written to the shared folder. For when results are written:
    DataFrames that still read them fail afterwards."""
    paths, jvm = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = paths.Path(_made.pop())
        path.getFileSystem(jvm).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there, and a lost executor loses nothing."""
    spark = bounded(df.sparkSession)
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def located(docs: DataFrame) -> DataFrame:
    """docs with a key for each row: a hash of its file's path, and its place in the file.

    Rows of a Parquet scan have such a key already; other input is first written to the shared folder. Rows with a key keep
    it, so a caller that needs it twice asks once.
    """
    if FILE in docs.columns:
        return docs
    try:
        keyed = docs.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        keyed.schema  # noqa: B018
    except AnalysisException:
        docs = materialise(docs, "rows")
        keyed = docs.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    return keyed


def numbered(docs: DataFrame, numbers: DataFrame, then: Callable[[DataFrame], DataFrame], planes: int = 1, keys: int = BROADCAST_KEYS) -> DataFrame:
    """then(docs with NUMBER), for located docs: NUMBER is what numbers(FILE, ROW, NUMBER) says of a row, 0 for other rows.

    Numbers have planes bits. They are gathered as bitmaps of BLOCK_ROWS rows of a file, which are joined to the scan by
    broadcast, so that texts aren't shuffled at any size. Where bitmaps hold more than keys rows, files are taken in waves,
    and a wave's rows are written before the next one is sent out: each file is read once, and what is sent at a time
    stays bounded.
    """
    spark = docs.sparkSession
    block = F.shiftright(F.col(ROW), 15).alias(BLOCK)
    bit = lambda plane: F.when(F.shiftright(NUMBER, plane).bitwiseAND(1) == 1, F.col(ROW) % BLOCK_ROWS)
    keyed = numbers.select(FILE, ROW, block, F.col(NUMBER).cast("long").alias(NUMBER)).repartition(FILE, BLOCK)
    maps = keyed.groupBy(FILE, BLOCK).agg(*[F.bitmap_construct_agg(bit(p)).alias(f"__lode_map{p}") for p in range(planes)])
    # Some hundred thousandth of the texts' size, so in few files.
    maps = materialise(maps.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)), "bitmaps")
    waves, of_wave = 1, lambda n: F.pmod(F.col(FILE), F.lit(n))
    files, largest = maps.agg(F.count_distinct(FILE), F.count(F.lit(1))).first()
    while largest > max(1, keys // BLOCK_ROWS) and waves < 2 * files:
        waves *= 2
        largest = maps.groupBy(of_wave(waves)).count().agg(F.max("count")).first()[0]

    def one(n: int) -> DataFrame:
        own, some = (docs, maps) if waves == 1 else (docs.where(of_wave(waves) == n), maps.where(of_wave(waves) == n))
        byte = lambda p: F.conv(F.hex(F.expr(f"substring(__lode_map{p}, CAST({ROW} % {BLOCK_ROWS} DIV 8 + 1 AS INT), 1)")), 16, 10).cast("int")
        place = (F.col(ROW) % 8).cast("int")
        of = lambda p: F.coalesce(F.call_function("shiftright", byte(p), place).bitwiseAND(1), F.lit(0)) * (1 << p)
        value = of(0)
        for p in range(1, planes):
            value = value + of(p)
        joined = own.withColumn(BLOCK, block).join(F.broadcast(some), [FILE, BLOCK], "left")
        return then(joined.withColumn(NUMBER, value).drop(BLOCK, *[f"__lode_map{p}" for p in range(planes)]))

    if waves == 1:
        return one(0)
    out = shared_path(spark, "waves")
    for n in range(waves):
        one(n).write.mode("append").parquet(out)
    return spark.read.schema(one(0).schema).parquet(out)


def without_rows(docs: DataFrame, gone: DataFrame, keys: int = BROADCAST_KEYS) -> DataFrame:
    """located docs without the rows whose keys gone lists; no rows are shuffled but the keys."""
    return numbered(docs, gone.select(FILE, ROW, F.lit(1).alias(NUMBER)), lambda found: found.where(F.col(NUMBER) == 0).drop(NUMBER), keys=keys)


def only_rows(docs: DataFrame, wanted: DataFrame, keys: int = BROADCAST_KEYS) -> DataFrame:
    """located docs that wanted lists; no rows are shuffled but the keys."""
    return numbered(docs, wanted.select(FILE, ROW, F.lit(1).alias(NUMBER)), lambda found: found.where(F.col(NUMBER) == 1).drop(NUMBER), keys=keys)


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_chars: int, settle: Callable = F.max) -> DataFrame:
    """A bounded sample to learn from: a table (doc_id, text, label) of at most most documents and most_chars characters.

    Null labels, texts and identifiers teach nothing, nor do held-out documents (CRC-32 of the identifier divisible by 5).
    The rest are taken in order of a hash. Of an identifier's rows the least text counts, of its labels what settle takes.
    Nothing comes to the driver.
    """
    teach = labels.where(f"{label} IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
    chosen = teach.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(settle(label).cast("long").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = materialise(chosen, "chosen")  # at most most rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    texts = materialise(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "learned")
    before = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most most numbers
    fits = texts.select("doc_id", F.length("text").alias("n"), before.alias("chars")).where(F.col("chars") <= most_chars)
    return materialise(texts.join(F.broadcast(fits.select("doc_id")), "doc_id").select("doc_id", "text", "label"), "sample")


def examples(docs: DataFrame, labels: DataFrame, label: str, most: int, most_chars: int, settle: Callable = F.max) -> list[tuple[int, str, int]]:
    """The rows of sample, in order, in the driver."""
    return sorted((r.doc_id, r.text, r.label) for r in sample(docs, labels, label, most, most_chars, settle).collect())
