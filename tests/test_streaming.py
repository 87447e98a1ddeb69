"""Ledgers in batches, and the same as streams over files that arrive one after another."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import ledger


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def _arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def at(minute, day=1):
    return datetime.datetime(2024, 1, day, 10 + minute // 60, minute % 60)


def _run(stream, name, tmp_path, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()


def test_items_seen_before_do_not_come_again(spark, tmp_path):
    schema, folder = "id string, ts timestamp", str(tmp_path / "in")
    for batch in ([("a", at(0)), ("a", at(1)), ("b", at(2))], [("b", at(3)), ("c", at(4))]):
        _arrive(spark, folder, batch, schema)
    _run(ledger.new_items(_stream(spark, folder, schema), "id", "ts", "1 hour"), "fresh", tmp_path)
    assert sorted(r.id for r in spark.table("fresh").collect()) == ["a", "b", "c"]


def test_window_counts_leave_out_late_rows(spark, tmp_path):
    schema, folder = "k string, ts timestamp", str(tmp_path / "in")
    _arrive(spark, folder, [("x", at(1)), ("x", at(5)), ("y", at(7))], schema)
    _arrive(spark, folder, [("x", at(50))], schema)
    _arrive(spark, folder, [("x", at(51))], schema)
    _arrive(spark, folder, [("x", at(2)), ("x", at(52))], schema)  # the first came after its window was sent
    _arrive(spark, folder, [("x", at(0, 2))], schema)
    _run(ledger.window_counts(_stream(spark, folder, schema), "ts", "k", "10 minutes", None, "15 minutes"), "counts", tmp_path)
    got = {(r.k, r.window.start.minute): r.n for r in spark.table("counts").collect()}
    assert got[("x", 0)] == 2 and got[("y", 0)] == 1 and got[("x", 50)] == 3


def test_the_ledger_is_written_after_the_output_only(spark, tmp_path):
    schema, folder = "id string", str(tmp_path / "in")
    _arrive(spark, folder, [("a",), ("b",)], schema)
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    broken = lambda batch: (_ for _ in ()).throw(RuntimeError("no space"))
    keep = lambda path: (lambda batch: batch.write.mode("append").parquet(path))
    with pytest.raises(Exception):
        ledger.commit_each_batch(_stream(spark, folder, schema), str(tmp_path / "c"), broken, keep(seen)).awaitTermination()
    assert ledger.load_ledger(spark, seen, schema).count() == 0
    ledger.commit_each_batch(_stream(spark, folder, schema), str(tmp_path / "c"), keep(out), keep(seen)).awaitTermination()
    assert ledger.load_ledger(spark, seen, schema).count() == 2 and spark.read.parquet(out).count() == 2
    ledger.commit_each_batch(_stream(spark, folder, schema), str(tmp_path / "c"), keep(out), keep(seen)).awaitTermination()
    assert spark.read.parquet(out).count() == 2  # nothing new, nothing twice


def test_findings_that_go_are_forgotten(spark):
    schema = "key string, urgency int, first_seen string, last_seen string"
    first = ledger.next_ledger(spark.createDataFrame([], schema), spark.createDataFrame([("a", 2), ("b", 1)], "key string, urgency int"), "key", "urgency", "d1")
    second = ledger.next_ledger(first, spark.createDataFrame([("a", 0)], "key string, urgency int"), "key", "urgency", "d2")
    assert [tuple(r) for r in second.collect()] == [("a", 0, "d1", "d2")]
    third = ledger.next_ledger(second, spark.createDataFrame([("b", 1)], "key string, urgency int"), "key", "urgency", "d3")
    assert [tuple(r) for r in third.collect()] == [("b", 1, "d3", "d3")]
    states = ledger.finding_states(first, second, "key", "urgency")
    assert {r.key: r.state for r in states.collect()} == {"a": "escalated", "b": "resolved"}


def test_failures_in_a_row_call_for_action_at_three(spark):
    counts = spark.createDataFrame([("s", 2), ("t", 2), ("u", 0)], "source string, failures int")
    run = spark.createDataFrame([("s", True), ("t", False), ("u", True), ("new", True)], "source string, failed boolean")
    got = {r.source: (r.failures, r.action) for r in ledger.failure_counts(counts, run, "source", "failed").collect()}
    assert got == {"s": (3, True), "t": (0, False), "u": (1, False), "new": (1, False)}


def test_snapshot_keeps_what_is_young(spark):
    schema = "url string, day string, v int"
    prior = spark.createDataFrame([("a", "2024-01-20", 1), ("old", "2023-12-01", 1), ("b", "2024-01-21", 1)], schema)
    fresh = spark.createDataFrame([("a", "2024-01-22", 2), ("", "2024-01-22", 2), ("c", "soon", 2)], schema)
    assert sorted(tuple(r) for r in ledger.snapshot(prior, fresh, "url", "day", "2024-01-25").collect()) == [("a", "2024-01-22", 2), ("b", "2024-01-21", 1)]
