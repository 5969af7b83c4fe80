"""Mixing sources to target weights, by systematic sampling. DataFrame operations only.

Each document's expected copies are its source's rate, target / size. Within a source the documents stand in order of a
size class, then of a hash; along that order the expected copies add up, and a document is emitted once for each whole
number that the sum, moved by the source's random offset, crosses. The order makes each class of sizes give its share,
so that the words taken come near the target and not only the documents.

The running sum never gathers a source in one task. Rows are sorted by ranges of their whole order into cells, which Spark
cuts by samples of the rows themselves: no key, however often it repeats, makes a cell large. Counts by (source, cell) are
small and summed first, and only the rows of one cell are ranked together. Rows with the same order (repeated or null
doc_ids) go by a hash of their text, then by their place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.llm.common import FILE, NUMBER, ROW, WORD, located, materialise, numbered, table

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def size_class(size: Column) -> Column:
    """Sizes with the same leading six bits: a class is at most a 32nd of its sizes wide."""
    shift = F.greatest(F.length(F.bin(size)) - 6, F.lit(0))
    return (shift * 64 + F.floor(size / F.pow(F.lit(2.0), shift))).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """totals(skey, source, source_size) with target and rate.

    Sources in order of their code points, null last, weigh as weights says, again and again. They share share times all
    sizes by weight; a source's target stops at most times its size and the rest is shared anew. In order of size per
    weight, the sources that stop are the first ones: the level of the others follows from running sums. One row per
    source, in one task: meant for millions of sources at most.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.array(*[F.lit(float(w)) for w in weights])
    return (
        totals.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(nth, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("ratio", most * F.col("source_size") / F.col("weight"))
        .withColumn("full_before", F.coalesce(F.sum("source_size").over(fill), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
        .withColumn("level", (share * F.sum("source_size").over(everything) - most * F.col("full_before")) / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), most * F.col("source_size")).otherwise(F.col("level") * F.col("weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("skey", "source_size", "target", "rate")
    )


def copies(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """A row for each row of docs(doc_id, text, source): its key, doc_id, size, source_size, target, copies, taken.

    Nulls: a null text has size 0, a null source is a source of its own, a null doc_id is ordered first. Rows that repeat
    are sampled one by one. Sizes 0 take nothing. An empty table gives an empty result. Other columns are not looked at.
    """
    sized = (
        located(docs)
        .select(
            FILE, ROW, F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("own"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        )
        .withColumn("skey", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")))
        .withColumn("class", size_class(F.col("size")))
        .withColumn("draw", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    )
    order = ("skey", "class", "draw", "doc_id", "own", FILE, ROW)
    rows = materialise(materialise(sized, "sizes").repartitionByRange(*order).withColumn("cell", F.spark_partition_id()), "cells")
    rates = targets(rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), **shares)
    before = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    starts = (
        rows.groupBy("skey", "cell").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(rates, "skey")
        .select("skey", "cell", "from", "source_size", "target", "rate")
    )
    place = F.col("from") + F.row_number().over(Window.partitionBy("skey", "cell").orderBy(*order[1:]))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "skey")), 1, 6), 16, 10).cast("double") / 16777216.0
    crossed = lambda k: F.floor(F.col("rate") * k + offset)
    return (
        rows.join(starts, ["skey", "cell"])
        .withColumn("place", place)
        .withColumn("copies", (crossed(F.col("place")) - crossed(F.col("place") - 1)).cast("long"))
        .select(FILE, ROW, "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns stay as they are.

    Nulls, repeated rows and empty tables are as in copies. The numbers of copies go to the rows as bits; texts aren't
    shuffled.
    """
    rows = located(docs)
    taken = copies(rows, seed, **shares).where("copies > 0").select(FILE, ROW, F.col("copies").alias(NUMBER))
    # A row is taken at most ceil(most) times.
    planes = math.ceil(shares.get("most", MOST)).bit_length()
    repeat = lambda found: found.where(F.col(NUMBER) > 0).withColumn(NUMBER, F.explode(F.sequence(F.lit(1), F.col(NUMBER))))
    return numbered(rows, taken, repeat, planes).select(*docs.columns)


def op2_mixing(spark, sf_dir):
    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey, md5('mix' || doc_id::VARCHAR) AS draw
  FROM documents),
totals AS (SELECT skey, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey, source),
weighted AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals)),
ratios AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM weighted),
filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)) /
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS own_level
  FROM ratios WINDOW before AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT *, (SELECT own_level FROM filled WHERE own_level < ratio ORDER BY ratio, place LIMIT 1) AS level FROM filled),
rates AS (
  SELECT skey, source_size, CASE WHEN level IS NULL OR ratio <= level THEN 2.0::DOUBLE * source_size ELSE level * weight END AS target,
         ('0x' || substr(md5('mix' || skey), 1, 6))::INTEGER / 16777216.0::DOUBLE AS start
  FROM levelled),
classed AS (SELECT *, greatest(length(bin(size)) - 6, 0) AS shift FROM sized),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY shift * 64 + (size >> shift), draw, doc_id) AS place FROM classed)
SELECT doc_id, size, source_size, target,
       (floor(coalesce(target / nullif(source_size, 0), 0) * place + start) - floor(coalesce(target / nullif(source_size, 0), 0) * (place - 1) + start))::BIGINT * size AS taken
FROM placed JOIN rates USING (skey)
"""
QUERIES, ORACLES = {"op2_mixing": op2_mixing}, {"op2_mixing": ORACLE}
