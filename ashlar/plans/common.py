"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder that spark.checkpoint.dir names, so that rounds don't pile up and lost executors lose nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='ashlar-')}"
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """df checkpointed, and how many of its rows meet the condition, from the same job."""
    seen = Observation()
    df = checkpointed(df.observe(seen, F.count_if(condition).alias("n")))
    return df, seen.get["n"]


def scratch(spark, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ashlar-')}"
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str, rows: int = 5000) -> DataFrame:
    """df dealt out by key for work that is heavy for its bytes: a partition for so many rows, one for each core at least.

    A scan's tasks follow bytes and row groups, so a few MB of small rows are one task, however long each row takes; the
    number is given, as adaptive execution would join small partitions again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), key)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """df as a table in the shared folder, and its number of rows. Unlike a checkpoint it keeps no constraints: those of one
    that a plan reads twice may name columns that its second copy lacks, on which a union of the two fails."""
    seen, folder = Observation(), scratch(df.sparkSession, label)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), seen.get["n"]
