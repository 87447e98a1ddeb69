"""Keyed state and timers: a stream over files that arrive one after another, and again after a restart, has the rows of its table twin."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.series import ring
from ledgerloom.streaming import states

DAY = datetime.timedelta(days=1)


def day(n, hour=0):
    return datetime.datetime(2024, 1, 1, hour) + n * DAY


@pytest.fixture(autouse=True)
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def streamed(spark, folder, batches, schema, make, mode="append"):
    """The rows of a stream whose files arrive in two goes, with a new query from the same checkpoint for the second."""
    out, source = str(folder / "out"), str(folder / "in")
    cut = max(1, len(batches) // 2)
    for part in (batches[:cut], batches[cut:]):
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        write = lambda batch, _: batch.write.mode("append").parquet(out)
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_findings_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng, schema = random.Random(3), "key string, run_at timestamp, urgency int"
    runs = [[(f"k{k}", day(n), rng.randint(0, 3)) for k in range(9) if rng.random() < 0.6] + [("k0", day(n), 3)] for n in range(7)]
    batches = [runs[0], runs[1] + runs[2], runs[3], runs[4] + runs[5], runs[6]]
    got = streamed(spark, tmp_path, batches, schema, lambda s: states.finding_stream(s, DAY))
    log = states.finding_log(spark.createDataFrame([r for b in runs for r in b], schema), DAY)
    assert rows_of(got) == rows_of(log)
    assert {r.state for r in log.collect()} == {"new", "escalated", "ongoing", "resolved"}
    again = log.filter("state = 'new'").groupBy("key").count().filter("count > 1").count()
    assert again  # what was resolved is forgotten and new again


def test_findings_by_hand(spark):
    rows = [("a", day(0), 2), ("a", day(1), 1), ("a", day(1), 3), ("a", day(2), 3), ("b", day(0), 0), ("b", day(2), 0), ("c", day(2), 1)]
    got = {(r.key, (r.run_at - day(0)).days): (r.state, r.urgency, (r.first_seen - day(0)).days) for r in states.finding_log(spark.createDataFrame(rows, "key string, run_at timestamp, urgency int"), DAY).collect()}
    assert got == {
        ("a", 0): ("new", 2, 0), ("a", 1): ("escalated", 1, 0), ("a", 2): ("ongoing", 3, 0), ("b", 0): ("new", 0, 0), ("b", 1): ("resolved", 0, 0), ("b", 2): ("new", 0, 2), ("c", 2): ("new", 1, 2),
    }


def test_failures_in_a_row(spark, tmp_path):
    rng, schema = random.Random(5), "source string, run_at timestamp, failed boolean"
    batches = [[(f"s{k}", day(n, h), rng.random() < 0.7) for k in range(5) for h in (0, 12)] for n in range(4)]
    got = streamed(spark, tmp_path, batches, schema, states.failure_stream)
    log = states.failure_log(spark.createDataFrame([r for b in batches for r in b], schema))
    assert rows_of(got) == rows_of(log) and max(r.failures for r in log.collect()) >= 3
    assert all(r.action == (r.failures >= 3) for r in log.collect())


def test_ring_of_changes(spark, tmp_path):
    rng, schema = random.Random(6), "key string, at timestamp, n long, value string"
    n, batches = 0, []
    for d in range(5):
        rows = []
        for _ in range(30):
            n += 1
            rows.append((f"k{rng.randint(0, 2)}", day(d), n, rng.choice("xyz") if rng.random() < 0.9 else None))
        batches.append(rows)
    got = streamed(spark, tmp_path, batches, schema, lambda s: states.ring_stream(s, 4), "update")
    last = {}
    for r in sorted(got.collect(), key=lambda r: r.n):
        last[r.key] = r.history
    table = spark.createDataFrame([r for b in batches for r in b], schema)
    assert last == {r.key: r.history for r in ring(table, "key", ["at", "n"], "value", 4).collect()}


def test_alarms_ring_when_only_time_passes(spark, tmp_path):
    schema = "key string, at timestamp, n long, due timestamp, flagged boolean"
    rows = [
        [("soon", day(0), 1, day(60), True), ("prose", day(0), 2, day(60), False), ("past", day(0), 3, day(-5), True), ("past prose", day(0), 4, day(-5), False), ("moved", day(0), 5, day(50), True)],
        [("other", day(16), 6, None, None)],  # no row of a key, yet it is time for SOON
        [("moved", day(30), 7, None, True)],  # acknowledged: nothing more comes
        [("other", day(59), 8, None, None)],
        [("other", day(70), 9, None, None)],
        [("late twin", day(70), 10, day(71), True), ("late twin", day(100), 11, day(300), True)],  # overdue in the same batch
    ]
    with_alarms = lambda d: d.select("key", "at", "n", states.horizon_alarms(F.col("at"), F.col("due"), F.col("flagged")).alias("alarms"))
    got = streamed(spark, tmp_path, rows, schema, lambda s: states.alarm_stream(with_alarms(s)))
    table = with_alarms(spark.createDataFrame([r for b in rows for r in b], schema))
    log = states.alarm_log(table, F.lit(day(100)))
    assert rows_of(got) == rows_of(log)
    found = {(r.key, r.level): (r.at - day(0)).days for r in log.collect()}
    assert found == {
        ("soon", "SOON"): 15, ("soon", "ACTION"): 61, ("prose", "SOON"): 15, ("past", "ACTION"): 0, ("moved", "SOON"): 5, ("late twin", "SOON"): 70, ("late twin", "ACTION"): 72,
    }


def test_stamps_grow_old(spark, tmp_path):
    schema = "key string, at timestamp, n long, stamp timestamp"
    rows = [[("page", day(0), 1, day(-80)), ("none", day(0), 2, None), ("old", day(0), 3, day(-91)), ("fresh", day(0), 4, day(0, 5))], [("renewed", day(5), 5, day(-60)), ("page", day(9), 6, day(9))], [("renewed", day(20), 7, day(20)), ("tick", day(60), 8, day(60))], [("tick", day(92), 9, day(92))]]
    with_alarms = lambda d: d.select("key", "at", "n", states.stamp_alarms(F.col("at"), F.col("stamp"), 90).alias("alarms"))
    got = streamed(spark, tmp_path, rows, schema, lambda s: states.alarm_stream(with_alarms(s)))
    log = states.alarm_log(with_alarms(spark.createDataFrame([r for b in rows for r in b], schema)), F.lit(day(92)))
    assert rows_of(got) == rows_of(log)
    assert {(r.key, (r.at - day(0)).days) for r in log.filter("level = 'ACTION'").collect()} == {("none", 0), ("old", 0), ("fresh", 91)}


def test_alarms_of_many_keys_share_state_and_timers(spark, tmp_path):
    rng, schema = random.Random(8), "key string, at timestamp, n long, due timestamp, flagged boolean"
    n, batches = 0, []
    for d in range(0, 120, 20):
        rows = []
        for k in [None, *(f"k{k}" for k in range(90))]:
            for _ in range(rng.randint(0, 3)):
                n += 1
                at = day(d + rng.randint(1, 19)) + datetime.timedelta(microseconds=rng.randint(0, 3))
                rows.append((k, at, n, rng.choice([None, at + rng.randint(-20, 99) * DAY]), rng.random() < 0.6))
        batches.append([*rows, ("tick", day(d + 20), n, None, None)])
    with_alarms = lambda d: d.select("key", "at", "n", states.horizon_alarms(F.col("at"), F.col("due"), F.col("flagged")).alias("alarms"))
    got = streamed(spark, tmp_path, batches, schema, lambda s: states.alarm_stream(with_alarms(s), buckets=4))
    log = states.alarm_log(with_alarms(spark.createDataFrame([r for b in batches for r in b], schema)), F.lit(day(120)))
    assert rows_of(got) == rows_of(log) and got.filter("key IS NULL").count()

    source, timers = str(tmp_path / "in"), []
    stream = states.alarm_stream(with_alarms(spark.readStream.schema(schema).parquet(source)), buckets=4)
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "again")).trigger(availableNow=True).start()
    query.awaitTermination()
    for progress in query.recentProgress:
        timers += [op.customMetrics["numRegisteredTimers"] for op in progress.stateOperators]
    assert 0 < max(timers) <= 4  # one of a bucket, not one of each alarm


def test_alarms_far_away(spark, tmp_path):
    schema = "key string, at timestamp, n long, stamp timestamp"
    far = datetime.datetime(2261, 12, 1)
    rows = [[("page", day(0), 1, datetime.datetime(2290, 1, 1)), ("none", day(0), 2, None)], [("tick", far, 3, None)]]
    with_alarms = lambda d: d.select("key", "at", "n", states.stamp_alarms(F.col("at"), F.col("stamp"), 90).alias("alarms"))
    got = streamed(spark, tmp_path, rows, schema, lambda s: states.alarm_stream(with_alarms(s)))
    log = states.alarm_log(with_alarms(spark.createDataFrame([r for b in rows for r in b], schema)), F.lit(far))
    assert rows_of(got) == rows_of(log)
