"""The store under dying writers, two writers at once, readers in between, and changes made from itself."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import sinks
from ledgerloom.sources.store import Store, StoreChanged


class Killed(BaseException):
    """Ends a writer where it stands: no handler of errors runs."""


def killed_at(step):
    def die(now):
        if now == step:
            raise Killed(step)

    return die


def ids(frame):
    return sorted(r.id for r in frame.collect())


@pytest.fixture
def folder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.commit({"a": spark.range(3), "b": spark.range(5)}, note="first").version == 1
    return store.folder


@pytest.mark.parametrize("step", ["write", "check", "publish", "done"])
def test_a_writer_killed_before_any_step_leaves_the_old_or_the_new_state(spark, folder, step):
    with pytest.raises(Killed):
        Store(spark, folder, killed_at(step)).commit({"a": spark.range(10, 12), "b": spark.range(20, 23)})
    store = Store(spark, folder)
    new = step == "done"
    assert store.state().version == 1 + new
    assert (ids(store.read("a")), ids(store.read("b"))) == (([10, 11], [20, 21, 22]) if new else ([0, 1, 2], [0, 1, 2, 3, 4]))
    # The next writer is not in its way, and what it left is swept.
    assert store.commit({"a": spark.range(1)}).committed
    assert len(store.sweep(0)) == (0 if new or step == "write" else 1)
    assert ids(store.read("a")) == [0] and len(ids(store.read("b"))) == (3 if new else 5)


def test_a_job_that_fails_midway_leaves_nothing(spark, folder):
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="bad row"):
        Store(spark, folder).commit({"a": spark.range(9), "b": broken})
    store = Store(spark, folder)
    assert store.state().version == 1 and len(ids(store.read("a"))) == 3 and store.sweep(0) == []


def test_a_merge_of_the_store_with_itself(spark, tmp_path):
    path = str(tmp_path / "g")
    clean = lambda rows: rows.groupBy("id").count().filter("count > 1")
    assert sinks.write_gated(spark.range(3), path, clean, dry_run=False) == []
    store = Store(spark, path)
    merged = store.read("rows").unionByName(spark.range(3, 5))
    assert sinks.write_gated(merged, path, clean) == [] and ids(store.read("rows")) == [0, 1, 2]  # a dry run
    assert sinks.write_gated(merged, path, clean, dry_run=False) == [] and ids(store.read("rows")) == [0, 1, 2, 3, 4]
    twice = store.read("rows").unionByName(spark.range(1))
    assert [r.id for r in sinks.write_gated(twice, path, clean, dry_run=False)] == [0] and ids(store.read("rows")) == [0, 1, 2, 3, 4]
    assert ids(merged) == [0, 1, 2, 3, 4]  # made from the first state, which is still there


def test_readers_keep_the_state_they_opened(spark, folder):
    store = Store(spark, folder)
    opened = store.tables()
    store.commit({"a": spark.range(50, 51), "b": spark.range(60, 61)})
    assert ids(opened["a"]) == [0, 1, 2] and ids(opened["b"]) == [0, 1, 2, 3, 4]
    assert ids(store.read("a")) == [50] and ids(store.read("a", 1)) == [0, 1, 2]


def test_of_two_writers_one_commits(spark, folder):
    meet, results = threading.Barrier(2), []

    def write(n):
        store = Store(spark, folder, lambda step: meet.wait(60) if step == "publish" else None)
        try:
            results.append(store.commit({"a": spark.range(n, n + 1)}).version)
        except StoreChanged:
            results.append("changed")

    threads = [threading.Thread(target=write, args=(n,)) for n in (100, 200)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(map(str, results)) == ["2", "changed"]
    store = Store(spark, folder)
    assert store.state().version == 2 and ids(store.read("a"))[0] in (100, 200) and store.sweep(0) == []
    with pytest.raises(StoreChanged):
        store.commit({"a": spark.range(1)}, base=1)


def test_dry_run_counts_changes_and_restore_goes_back(spark, folder):
    store = Store(spark, folder)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k int, v string")
    store.commit({"c": rows((1, "x"), (2, "y"), (3, "z"))}, note="three")
    new = rows((1, "x"), (2, "changed"), (4, "added"))
    outcome = store.commit({"c": new}, key={"c": ["k"]}, dry_run=True)
    assert not outcome.committed and outcome.changes == {"c": {"added": 1, "removed": 1, "changed": 1}}
    assert store.state().version == 2 and store.state().rows == {"a": 3, "b": 5, "c": 3}
    assert store.commit({"c": new}, key={"c": ["k"]}).changes == outcome.changes
    assert store.restore(2).version == 4 and sorted(tuple(r) for r in store.read("c").collect()) == [(1, "x"), (2, "y"), (3, "z")]
    assert store.state().note == "version 2 again" and store.state(2).note == "three"
    with pytest.raises(ValueError):
        store.read("none")
    with pytest.raises(ValueError):
        store.state(9)


def test_old_states_are_forgotten_and_swept(spark, folder):
    store = Store(spark, folder)
    for n in range(3):
        store.commit({"a": spark.range(n)})
    assert store.forget(2) == [1, 2] and store.versions() == [3, 4]
    assert len(store.sweep(0)) == 1  # the second state's table; the first's folder still has table b
    assert ids(store.read("a")) == [0, 1] and len(ids(store.read("b"))) == 5 and store.sweep(0) == []


def test_empty_tables_are_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.state().version == 0 and store.versions() == [] and store.sweep() == []
    store.commit({"e": spark.range(0)})
    assert store.read("e").columns == ["id"] and store.read("e").count() == 0
