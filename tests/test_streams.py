import time

import pytest
from pyspark.sql import functions as F

from flowframe.plans.spec import FlowSpec
from flowframe.streaming import flows


def run(spark, stream, name, mode="append", rows=None):
    """The stream's table once it ends, or has so many rows where timers keep it going."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    until = time.time() + 120
    while not q.awaitTermination(1) and time.time() < until:
        if rows is not None and spark.table(name).count() >= rows:
            break
    q.stop()
    return spark.table(name)


@pytest.fixture
def batches(spark, tmp_path):
    def make(rows, schema):
        for k, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))

    return make


def test_stream_is_routed(spark, batches):
    spec = FlowSpec("s", "shuffle", (("k", "BIGINT"),), (1, 2))
    got = run(spark, flows.shuffle(batches([[(1,), (2,)], [(3,)]], "k long"), spec), "routed").collect()
    assert {(r.k, r.target_id) for r in got} == {(1, 2), (2, 1), (3, 2)}


def test_rows_come_in_order_with_losses(spark, batches):
    stream = batches([[(1, 0, 10), (1, 2, 12), (1, 1, 11), (1, 1, 99)], [(1, 5, 15), (1, 6, 16), (1, 0, 99)]], "key long, seq long, v long")
    got = run(spark, flows.in_order(stream, "key", "seq", "v", limit=2, timeout_ms=600_000), "ordered_rows", rows=7).collect()
    assert sorted((r.seq, r.value, r.status) for r in got if r.value is not None) == [(0, 10, "OK"), (1, 11, "OK"), (2, 12, "OK"), (5, 15, "OK"), (6, 16, "OK")]
    assert sorted(r.seq for r in got if r.status == "LOST") == [3, 4]


def test_closing_releases_what_waits(spark, batches):
    stream = batches([[(1, 0, 10, False), (1, 2, 12, False), (1, 5, None, True)], [(1, 3, 13, False), (1, 7, None, True), (2, 1, 1, False)]], "key long, seq long, v long, end boolean")
    got = run(spark, flows.in_order(stream, "key", "seq", "v", last="end", sources=2, timeout_ms=600_000), "closed_rows", rows=8).collect()
    own = sorted((r.seq, r.value, r.status) for r in got if r.key == 1)
    assert own == [(0, 10, "OK"), (1, None, "LOST"), (2, 12, "OK"), (3, 13, "OK"), (4, None, "LOST"), (5, None, "CLOSED"), (6, None, "LOST"), (7, None, "CLOSED")]
    assert not [r for r in got if r.key == 2]  # still open, and its first number may come


def test_silence_gives_a_number_up(spark, batches):
    stream = batches([[(1, 0, 10), (1, 2, 12)]], "key long, seq long, v long")
    q = flows.in_order(stream, "key", "seq", "v", timeout_ms=1_000).writeStream.format("memory").queryName("silent").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("silent").count() < 3:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted((r.seq, r.status) for r in spark.table("silent").collect()) == [(0, "OK"), (1, "LOST"), (2, "OK")]


def test_keyed_store(spark, batches):
    stream = batches([[(1, "WRITE", 7, 5), (2, "READ", 7, 0)], [(3, "WRITE", 7, 6), (4, "READ", 7, 0), (5, "READ", 8, 0)]], "slot long, op string, key long, value long")
    got = {r.slot: r.result for r in run(spark, flows.kv_reads(stream), "kv").collect()}
    assert set(got) == {2, 4, 5} and got[5] is None and got[4] == 6 and got[2] in (5, 6)


def test_event_time_windows(spark, batches):
    stream = batches([[("2024-01-01 00:00:01", 1.0), ("2024-01-01 00:00:04", 2.0)], [("2024-01-01 00:01:00", 9.0)]], "t string, x double").withColumn("ts", F.to_timestamp("t"))
    got = run(spark, flows.combine(stream, "sum", ["x"], "ts", "10 seconds", "5 seconds"), "win", "update").collect()
    assert any(r.x == 3.0 and r.tuples_consumed == 2 for r in got)
