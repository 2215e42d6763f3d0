"""Streams with timers: restarts, repeated deliveries, ties, nulls and what is left in state."""

import pytest
from pyspark.sql import Row

from tidemill.streaming import sinks, timers


def feed(spark, rows, schema, place):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)


def start(spark, build, schema, place, out):
    """One start of a stream over the files that have come since the last, on one checkpoint."""
    stream = build(spark.readStream.schema(schema).parquet(place))
    with timers.timer_store(spark):
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{out}/rows").collect()), key=str)


def test_a_restart_changes_nothing(spark, tmp_path):
    """Silence over a restart, a tie, a null key, two keys; the state knows what was seen before."""
    schema, place, build = "key string, t long", str(tmp_path / "in"), lambda s: timers.silence_alerts(s, 600)
    feed(spark, [("a", 0), ("a", 0), ("a", 100), ("b", 90), (None, 95)], schema, place)
    assert start(spark, build, schema, place, str(tmp_path)) == []
    feed(spark, [("a", 1000), ("a", 900)], schema, place)
    first = start(spark, build, schema, place, str(tmp_path))
    assert first == [("a", 700, "silent"), ("a", 900, "back"), ("b", 690, "silent")]
    feed(spark, [("b", 2000), (None, 99_999)], schema, place)
    assert start(spark, build, schema, place, str(tmp_path)) == sorted([*first, ("a", 1600, "silent"), ("b", 2000, "back"), ("b", 2600, "silent")], key=str)


def test_hours(spark, tmp_path):
    """Ready at the very deadline, late, missing, a kind twice, and one that comes after it was decided."""
    schema, place, build = "end long, kind string, known long", str(tmp_path / "in"), lambda s: timers.readiness(s, 2)
    feed(spark, [(1000, "x", 1100), (1000, "x", 1200), (1000, "y", 1600), (1000, "y", 1650), (2000, "x", 2000), (3000, "x", 3001)], schema, place)
    feed(spark, [(2000, "y", 2601), (None, None, 500_000)], schema, place)
    assert start(spark, build, schema, place, str(tmp_path)) == [(1000, "ready", 1600), (2000, "late", 2600), (3000, "missing", 24_600)]


def test_orders(spark, tmp_path):
    """A bar at the order's time, one at the deadline, one too late, none; two orders of one key."""
    schema, place, build = "key long, t long, id long", str(tmp_path / "in"), lambda s: timers.pending_orders(s, 100)
    feed(spark, [(1, 10, None), (1, 10, 1), (2, 10, 2), (2, 50, 3), (3, 10, 4), (4, 20, 5)], schema, place)
    feed(spark, [(2, 110, None), (3, 111, None), (None, 9999, None)], schema, place)
    assert start(spark, build, schema, place, str(tmp_path)) == [(1, 0, "OPEN"), (2, 100, "OPEN"), (3, 60, "OPEN"), (4, 100, "CANCELLED"), (5, 100, "CANCELLED")]


def test_a_batch_delivered_twice(spark, tmp_path):
    """Values and revisions of one batch, written again after a failure: one effect, in both tables."""
    batch = spark.createDataFrame([("a", 1, 2.0, "accepted"), ("a", 2, 3.0, "revision")], "key string, id long, value double, route string")
    for _ in range(2):
        sinks.write_routes(str(tmp_path), batch, 0)
    sinks.write_routes(str(tmp_path), batch.where("id = 1"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/rows").select("batch", "route", "id").collect()) == [(0, "accepted", 1), (0, "revision", 2), (1, "accepted", 1)]


def test_first_value_over_starts(spark, tmp_path):
    schema, place = "key string, t long, id long, value double", str(tmp_path / "in")
    feed(spark, [("a", 5, 2, 1.0), ("a", 5, 1, 2.0), ("b", 1, 3, None), (None, 1, 4, 1.0)], schema, place)
    assert start(spark, timers.first_accepted, schema, place, str(tmp_path)) == [("a", 1, 2.0, "accepted"), ("a", 2, 1.0, "revision")]
    feed(spark, [("a", 9, 5, 2.0), ("a", 9, 6, 7.0)], schema, place)
    assert start(spark, timers.first_accepted, schema, place, str(tmp_path))[-1] == ("a", 6, 7.0, "revision")


@pytest.mark.parametrize("size", [7, 1000])
def test_files_in_order(spark, size):
    rows = spark.range(60).selectExpr("id AS t", "id % 3 AS k").repartition(5)
    place = sinks.table_in_order(rows, "t", size, "files")
    batches = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(place)
    stream.writeStream.foreachBatch(lambda b, _: batches.append([r.t for r in b.collect()])).trigger(availableNow=True).start().awaitTermination()
    assert [min(b) for b in batches] == list(range(0, 60, size)) and sorted(sum(batches, [])) == list(range(60))


def test_many_rows_of_a_key_are_no_rows_of_python(spark, tmp_path):
    """A source's beats come as arrays, and orders met within a batch leave no call of the state behind."""
    schema, place, build = "key string, t long", str(tmp_path / "in"), lambda s: timers.silence_alerts(s, 600)
    feed(spark, [("a", t) for t in [*range(3000), *range(4000, 6000)] * 3] + [("a", None)], schema, place)
    assert start(spark, build, schema, place, str(tmp_path)) == [("a", 3599, "silent"), ("a", 4000, "back")]

    class State(dict):
        def iterator(self):
            return iter(list(self.items()))

        def updateValue(self, k, v):
            calls.append(("put", k))
            self[k] = v

        def removeKey(self, k):
            calls.append(("drop", k))
            del self[k]

    calls, own = [], timers._Pending(100)
    own.open, own._arm = State({(1,): (0,)}), lambda t: calls.append(("arm", t))
    rows = [Row(key=5, t=10, id=2), Row(key=5, t=20, id=3), Row(key=5, t=30, id=None), Row(key=5, t=40, id=4)]
    assert [tuple(r) for r in own.handleInputRows((5,), iter(rows), None)] == [(1, 30, "OPEN"), (2, 20, "OPEN"), (3, 10, "OPEN")]
    assert calls == [("drop", (1,)), ("put", (4,)), ("arm", 140)]
