"""State with a time to live: what a stream last wrote under a key, forgotten when nothing is written for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SECONDS = 3600
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, value string, ts timestamp, writes long, fresh boolean"


class Latest(StatefulProcessor):
    """Of a key the last value and how often it was written; each write starts the time to live anew, and after it the state
    is gone: Spark drops it from the store."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.state = handle.getValueState("latest", "value string, ts timestamp, writes long", self.seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.state.exists()
        value, ts, writes = (None, None, 0) if fresh else self.state.get()
        for some in rows:
            writes += len(some)
            last = some.sort_values(["ts", "value"], na_position="first").iloc[-1]
            if ts is None or not pd.isna(last.ts) and last.ts >= pd.Timestamp(ts):
                value, ts = last.value, None if pd.isna(last.ts) else last.ts.to_pydatetime()
        value = None if pd.isna(value) else value
        self.state.update((value, ts, int(writes)))
        yield pd.DataFrame({"key": [key[0]], "value": [value], "ts": [pd.Timestamp(ts) if ts is not None else pd.NaT], "writes": [writes], "fresh": [fresh]})

    def close(self) -> None:
        pass


def latest(events: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """A stream events(key, value, ts) to a row for each key and micro-batch: the last value by ts, how often the key was
    written since its state began, and whether it began just now (it never was there, or had expired).

    State lives in RocksDB on the executors and in the query's checkpoint; its time is that of processing. Rows without key
    are left out. Of equal times the greatest value counts, a null time is before any other. Batches without data, which
    such a stream would run for ever, are switched off: expired state is dropped when the next data comes.
    """
    events.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = events.where("key IS NOT NULL").select("key", "value", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("key").transformWithStateInPandas(Latest(seconds), OUT, "Append", "ProcessingTime")
