"""State of a stream that expires."""

import json
import time

from ashlar.streaming import expiry

EVENT = "key string, value string, ts timestamp"


def test_state_expires_and_writes_refresh_it(spark, tmp_path):
    """Three processing times: b isn't written at the second one and has expired at the third, a has not."""
    folder, out = tmp_path / "e", str(tmp_path / "out")
    folder.mkdir()

    def batch(number, *rows):
        (folder / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("key", "value", "ts"), row))) for row in rows))
        stream = expiry.latest(spark.readStream.schema(EVENT).json(str(folder)), 30)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).option("path", out).format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        found = {(r.key, r.value, r.writes, r.fresh) for r in spark.read.parquet(out).collect()}
        new = found - seen
        seen.update(found)
        return new

    seen, began = set(), time.time()
    first = batch(1, ("a", "1", "2024-01-01T00:00:00"), ("b", "1", "2024-01-01T00:00:00"), ("a", "0", "2023-01-01T00:00:00"), (None, "x", "2024-01-01T00:00:00"))
    assert first == {("a", "1", 2, True), ("b", "1", 1, True)}
    written = time.time()
    time.sleep(max(0, began + 20 - time.time()))
    assert batch(2, ("a", "2", "2024-01-02T00:00:00")) == {("a", "2", 3, False)}
    refreshed = time.time()
    time.sleep(max(0, written + 31 - time.time()))
    late = time.time() - refreshed
    third = batch(3, ("a", "3", "2024-01-01T12:00:00"), ("b", "3", None))
    if late < 15:  # else a's time has run out, too, on a machine this slow
        assert ("a", "2", 4, False) in third  # an older time doesn't replace the value
    assert ("b", "3", 1, True) in third
