"""Keyed state and event-time timers in streams, each beside the batch operator that gives the same rows.

A run is a check of all sources at one time; its rows carry that time. A key that a run doesn't see has no row there, so nothing
but time can tell: timers at the next run's time fire for it once the watermark has come that far. A key's rows are worked on in
event time, and what its timers owed by then comes first, so the rows that come out don't depend on how the input is cut into
batches, nor on restarts.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Alarms of a row: what it calls for at its own time, and what at later times.
ALARMS = "array<struct<at:timestamp,level:string>>"


def _millis(at: datetime.datetime) -> int:
    return round(at.timestamp() * 1000)


def _moment(millis: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(millis / 1000)


_Finding = Row("key", "run_at", "state", "urgency", "first_seen")
_Failure = Row("source", "run_at", "failures", "action")
_History = Row("key", "at", "n", "history")
_Alarm = Row("key", "at", "level")


class _Findings(StatefulProcessor):
    """Value state by key: urgency and first time of a finding that stands, and the time of its last run."""

    def __init__(self, every_ms: int) -> None:
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", "urgency int, first long, last long")

    def _clear(self) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        by_run: dict[int, int] = {}
        for row in rows:
            at = _millis(row.run_at)
            by_run[at] = min(by_run.get(at, row.urgency), row.urgency)
        old = self.standing.get() if self.standing.exists() else None
        for at in sorted(by_run):
            urgency = by_run[at]
            if old is not None and at > old[2] + self.every_ms:  # a run between did not see it
                yield _Finding(key[0], _moment(old[2] + self.every_ms), "resolved", old[0], _moment(old[1]))
                old = None
            state = "new" if old is None else "escalated" if urgency < old[0] else "ongoing"
            first = at if old is None else old[1]
            yield _Finding(key[0], _moment(at), state, urgency, _moment(first))
            old = (urgency, first, at)
        self.standing.update(tuple(old))
        self._clear()
        self.handle.registerTimer(old[2] + self.every_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        urgency, first, last = self.standing.get()
        self.standing.clear()
        yield _Finding(key[0], _moment(last + self.every_ms), "resolved", urgency, _moment(first))

    def close(self) -> None:
        pass


FINDINGS = "key string, run_at timestamp, state string, urgency int, first_seen timestamp"


def finding_stream(observed: DataFrame, every: datetime.timedelta, late: str = "0 seconds") -> DataFrame:
    """The findings of a stream of observations (key, run_at, urgency) in regular runs (T5): a row for each key and run that sees it,
    new, escalated (more urgent, a lower number, than in the run before) or ongoing, and one, resolved, for the first run that does not.

    The rows of a run come in a batch or are no more than `late` behind; the last run's missing keys come with the next run.
    """
    marked = observed.withWatermark("run_at", late)
    return marked.groupBy("key").transformWithState(statefulProcessor=_Findings(round(every.total_seconds() * 1000)), outputStructType=FINDINGS, outputMode="Append", timeMode="EventTime")


def finding_log(observed: DataFrame, every: datetime.timedelta) -> DataFrame:
    """The same rows from a table of observations; the last run's missing keys are resolved, as in a stream that has gone on."""
    by = Window.partitionBy("key").orderBy("run_at")
    step = F.make_dt_interval(secs=F.lit(every.total_seconds()))
    seen = observed.groupBy("key", "run_at").agg(F.min("urgency").alias("urgency"))
    near = F.lag("run_at").over(by).isNotNull() & (F.col("run_at") <= F.lag("run_at").over(by) + step)
    stood = seen.withColumn("stands", near).withColumn("before", F.when(near, F.lag("urgency").over(by))).withColumn("next", F.lead("run_at").over(by))
    state = F.when(F.col("before").isNull(), "new").when(F.col("urgency") < F.col("before"), "escalated").otherwise("ongoing")
    first = F.last(F.when(~F.col("stands"), F.col("run_at")), True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = stood.withColumn("state", state).withColumn("first_seen", first)
    newest = seen.agg(F.max("run_at").alias("newest"))
    gone = rows.filter(F.col("next").isNull() | (F.col("next") > F.col("run_at") + step)).join(F.broadcast(newest)).filter(F.col("run_at") + step <= F.col("newest"))
    out = ["key", "run_at", "state", "urgency", "first_seen"]
    return rows.select(*out).unionByName(gone.withColumn("run_at", F.col("run_at") + step).withColumn("state", F.lit("resolved")).select(*out))


class _Failures(StatefulProcessor):
    """Value state by source: failures in a row."""

    def __init__(self, escalate_at: int) -> None:
        self.escalate_at = escalate_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        for row in sorted(rows, key=lambda r: r.run_at):
            n = n + 1 if row.failed else 0
            yield _Failure(key[0], row.run_at, n, n >= self.escalate_at)
        self.count.update((n,))

    def close(self) -> None:
        pass


FAILURES = "source string, run_at timestamp, failures int, action boolean"


def failure_stream(runs: DataFrame, escalate_at: int = 3) -> DataFrame:
    """Failures in a row by source after each of its runs (source, run_at, failed), and whether they call for action (T6). A source's
    runs come in order; within a batch they are put in order."""
    return runs.groupBy("source").transformWithState(statefulProcessor=_Failures(escalate_at), outputStructType=FAILURES, outputMode="Append", timeMode="None")


def failure_log(runs: DataFrame, escalate_at: int = 3) -> DataFrame:
    """The same rows from a table of runs."""
    from ledgerloom.operators.series import streaks

    counted = streaks(runs, "source", ["run_at"], F.col("failed"))
    return counted.select("source", "run_at", F.col("streak").cast("int").alias("failures"), (F.col("streak") >= escalate_at).alias("action"))


class _Ring(StatefulProcessor):
    """List state by key: the last values that differ from the one before."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [v[0] for v in self.values.get()] if self.values.exists() else []
        newest = None
        for row in sorted(rows, key=lambda r: (r.at, r.n)):
            newest = row
            if not held or held[-1] != row.value:
                held = [*held, row.value][-self.size :]
        self.values.put([(v,) for v in held])
        yield _History(key[0], newest.at, newest.n, held)

    def close(self) -> None:
        pass


RING = "key string, at timestamp, n long, history array<string>"


def ring_stream(values: DataFrame, size: int = 12) -> DataFrame:
    """The last `size` values of each key that differ from the one before (T8), after each batch that has rows of it: key, at and n of the
    newest row, history. Rows (key, at, n, value) come in the order of at and n; `series.ring` has the same of a table."""
    return values.groupBy("key").transformWithState(statefulProcessor=_Ring(size), outputStructType=RING, outputMode="Update", timeMode="None")


class _Alarms(StatefulProcessor):
    """List state by bucket of keys: alarms to come of the newest row of each key, in microseconds, with a timer at the first of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.coming = handle.getListState("coming", "key string, at long, level string")

    def _keep(self, pending: list[tuple[str | None, int, str]], watermark: int) -> None:
        """Holds the alarms and sets the timer; one that the watermark has passed is due in this very batch."""
        if pending:
            self.coming.put(pending)
            self.handle.registerTimer(max(-(-min(at for _, at, _ in pending) // 1000), watermark))
        else:
            self.coming.clear()

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        pending: dict[str | None, list[tuple[int, str]]] = {}
        for of, at, level in self.coming.get():
            pending.setdefault(of, []).append((at, level))
        read, rung = [], []
        for frame in rows:
            read.extend(zip(frame["micros"].tolist(), frame["n"].tolist(), frame["key"].tolist(), frame["dues"], frame["levels"]))
        for now, _, of, dues, levels in sorted(read, key=lambda r: r[:2]):
            for at, level in pending.pop(of, ()):  # due before this row, though the watermark had not told yet
                if at < now:
                    rung.append((of, at, level))
            coming = []
            for at, level in sorted(zip(map(int, dues), levels)):
                if at <= now:
                    rung.append((of, now, level))
                else:
                    coming.append((at, level))
            if coming:
                pending[of] = coming
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self._keep([(of, at, level) for of, alarms in pending.items() for at, level in alarms], timerValues.getCurrentWatermarkInMs())
        yield from _rung(rung)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        watermark = timerValues.getCurrentWatermarkInMs()
        pending = list(self.coming.get())
        self._keep([a for a in pending if a[1] > watermark * 1000], watermark)
        yield from _rung([a for a in pending if a[1] <= watermark * 1000])

    def close(self) -> None:
        pass


def _rung(alarms: list[tuple[str | None, int, str]]) -> Iterator:
    import pandas as pd

    if alarms:
        yield pd.DataFrame(alarms, columns=["key", "at", "level"])


ALARM = "key string, at long, level string"


def alarm_stream(rows: DataFrame, late: str = "0 seconds", buckets: int = 4096) -> DataFrame:
    """Alarms (key, at, level) of a stream of rows (key, at, n, alarms): those of a row that are due at its own time at once, the others
    when the watermark passes them, also if the key gets no new row. A key's newer row, by at and n, takes the place of the older with
    its alarms (T9, T10).

    State, timers and batches of rows between Spark and Python are those of a bucket of keys, as each costs more than the work on a
    key's few rows. A task holds one bucket's rows of a batch and its alarms to come at a time; `buckets` stays as it is for a checkpoint.
    Rows are read as pandas frames, so a row's own time after 2262-04-11 is an error; its alarms may be later.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    first = lambda c: F.coalesce(c, F.lit(-(2**63)))
    part = lambda of, kind: F.coalesce(F.transform("alarms", of), F.array().cast(kind)).alias
    dues, levels = part(lambda a: F.unix_micros(a["at"]), "array<long>")("dues"), part(lambda a: a["level"], "array<string>")("levels")
    flat = rows.withWatermark("at", late).select(bucket.alias("bucket"), "key", "at", first(F.unix_micros("at")).alias("micros"), first(F.col("n").cast("long")).alias("n"), dues, levels)
    found = flat.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Alarms(), outputStructType=ALARM, outputMode="Append", timeMode="EventTime")
    return found.select("key", F.timestamp_micros("at").alias("at"), "level")


def alarm_log(rows: DataFrame, until: Column) -> DataFrame:
    """The same alarms from a table of rows, as far as `until`, which a stream's watermark would have reached."""
    order = Window.partitionBy("key").orderBy("at", "n")
    each = rows.select("key", "at", F.lead("at").over(order).alias("next"), "alarms").select("key", "at", "next", F.inline("alarms").alias("due", "level"))
    alive = (F.col("due") <= F.col("at")) | ((F.col("next").isNull() | (F.col("due") < F.col("next"))) & (F.col("due") <= until))
    return each.filter(alive).select("key", F.greatest("due", "at").alias("at"), "level")


def horizon_alarms(at: Column, due: Column, flagged: Column, days: int = 45) -> Column:
    """A date's alarms (T9): SOON from `days` before it, and ACTION from the day after it if it is flagged. Dates in prose, which are not
    flagged, are not heard of once they are past; a null date, as of one that was acknowledged, has none."""
    day = F.make_dt_interval(F.lit(1))
    late, near = due + day, due - F.make_dt_interval(F.lit(days))
    soon, action = F.struct(near.alias("at"), F.lit("SOON").alias("level")), F.struct(late.alias("at"), F.lit("ACTION").alias("level"))
    alarms = F.when(due.isNull(), F.array()).when(at >= late, F.when(flagged, F.array(action)).otherwise(F.array())).when(flagged, F.array(soon, action)).otherwise(F.array(soon))
    return alarms.cast(ALARMS)


def stamp_alarms(at: Column, stamp: Column, days: int) -> Column:
    """A page's alarms by its stamp (T10): ACTION once it is older than `days`, at once if it has none, else OK now."""
    old = F.date_trunc("day", stamp) + F.make_dt_interval(F.lit(days + 1))
    action, fine = F.struct(old.alias("at"), F.lit("ACTION").alias("level")), F.struct(at.alias("at"), F.lit("OK").alias("level"))
    missing = F.struct(at.alias("at"), F.lit("ACTION").alias("level"))
    return F.when(stamp.isNull(), F.array(missing)).when(at >= old, F.array(action)).otherwise(F.array(fine, action)).cast(ALARMS)
