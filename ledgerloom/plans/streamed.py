"""Queries whose rows come from keyed state and timers: as tables, and the same by streams over the files."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.registry import Registry
from ledgerloom.session import shared_place, table
from ledgerloom.streaming import states

DAY = datetime.timedelta(days=1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stream(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a table in the shared folder and reads it."""
    folder, name = f"{shared_place(spark)}/stream-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        write = lambda batch, _: batch.write.mode("append").parquet(f"{folder}/rows")
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def source(spark: SparkSession, sf: str, name: str, streaming: bool) -> DataFrame:
    """A table, or the same as a stream; a pattern, as a stream takes a single file by one only."""
    rows = table(spark, sf, name)
    return spark.readStream.schema(rows.schema).parquet(f"{sf}/{name}.parque?") if streaming else rows


def as_both(reg: Registry, name: str, sql: str, make: Callable[[DataFrame], DataFrame], log: Callable, stream: Callable, of: str, show: Callable[[DataFrame], DataFrame]) -> None:
    """Registers an operator as `name`_log over the table and as `name`_stream over its files, with one SQL."""
    reg.add(f"{name}_log", sql)(lambda spark, sf: show(log(make(source(spark, sf, of, False)))))
    reg.add(f"{name}_stream", sql)(lambda spark, sf: show(run_stream(spark, stream(make(source(spark, sf, of, True))))))


def observations(events: DataFrame) -> DataFrame:
    urgency = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return events.select(F.col("user_id").cast("string").alias("key"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("run_at"), urgency.alias("urgency"))


def runs(events: DataFrame) -> DataFrame:
    """Runs of a source at times of their own: an event's number is added to its time, so no two are at once."""
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id"))
    return events.select(F.col("user_id").cast("string").alias("source"), at.alias("run_at"), (F.col("event_type") != "click").alias("failed"))


def deadlines(orders: DataFrame) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey")
    due = F.when(k % 7 != 0, at + F.make_dt_interval((k % 120 - 20).cast("int")))
    return orders.select(F.col("o_custkey").cast("string").alias("key"), at.alias("at"), k.alias("n"), states.horizon_alarms(at, due, k % 3 != 0).alias("alarms"))


def stamps(orders: DataFrame) -> DataFrame:
    at, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    stamp = F.when(k % 9 != 0, at - F.make_dt_interval((k % 130).cast("int")))
    return orders.select(F.col("o_custkey").cast("string").alias("key"), at.alias("at"), k.alias("n"), states.stamp_alarms(at, stamp, 90).alias("alarms"))


def alarm_sql(alarms: str) -> str:
    """Alarms of order rows (at, k, and a list of level and time), each until the customer's next order takes its place."""
    return f"""
        WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderdate::TIMESTAMP AS seen, lead(o_orderdate::TIMESTAMP) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders),
        a AS (SELECT *, unnest({alarms}) AS x FROM o)
        SELECT o_custkey::VARCHAR AS key, strftime(greatest(x.due, seen), '%Y-%m-%d') AS day, x.level AS level FROM a
        WHERE x.due <= seen OR ((next IS NULL OR x.due < next) AND x.due <= (SELECT max(o_orderdate)::TIMESTAMP FROM orders))"""


def register(reg: Registry) -> None:
    in_days = lambda rows: rows.select("key", F.date_format("run_at", "yyyy-MM-dd").alias("day"), "state", "urgency", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))
    as_both(
        reg, "t5_finding", """
        WITH s AS (SELECT user_id, ts::DATE AS d, min(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END)::INT AS u FROM events GROUP BY 1, 2),
        n AS (SELECT *, lag(d) OVER w AS pd, lag(u) OVER w AS pu, lead(d) OVER w AS nd FROM s WINDOW w AS (PARTITION BY user_id ORDER BY d)),
        m AS (SELECT *, pd IS NOT NULL AND d = pd + 1 AS stands FROM n),
        f AS (SELECT *, max(CASE WHEN NOT stands THEN d END) OVER (PARTITION BY user_id ORDER BY d) AS first FROM m)
        SELECT user_id::VARCHAR AS key, d::VARCHAR AS day, CASE WHEN NOT stands THEN 'new' WHEN u < pu THEN 'escalated' ELSE 'ongoing' END AS state, u AS urgency, first::VARCHAR AS first_seen FROM f
        UNION ALL SELECT user_id::VARCHAR, (d + 1)::VARCHAR, 'resolved', u, first::VARCHAR FROM f WHERE (nd IS NULL OR nd > d + 1) AND d + 1 <= (SELECT max(d) FROM s)""",
        observations, lambda rows: states.finding_log(rows, DAY), lambda rows: states.finding_stream(rows, DAY), "events", in_days,
    )

    as_both(
        reg, "t6_failure", """
        WITH r AS (SELECT user_id, event_id, ts + to_microseconds(event_id) AS moment, event_type <> 'click' AS failed FROM events),
        g AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY moment) AS run FROM r)
        SELECT user_id::VARCHAR AS source, epoch_us(moment)::BIGINT AS micros, sum(failed::INT) OVER (PARTITION BY user_id, run ORDER BY moment)::INT AS failures, sum(failed::INT) OVER (PARTITION BY user_id, run ORDER BY moment) >= 3 AS action FROM g""",
        runs, states.failure_log, states.failure_stream, "events", lambda rows: rows.select("source", F.unix_micros("run_at").alias("micros"), "failures", "action"),
    )

    alarms = lambda rows: rows.select("key", F.date_format("at", "yyyy-MM-dd").alias("day"), "level")
    def log(rows):  # as far as a stream's watermark would come
        newest = rows.agg(F.max("at").alias("newest"))
        found = states.alarm_log(rows, F.lit("2100-01-01").cast("timestamp")).join(F.broadcast(newest)).filter(F.col("at") <= F.col("newest"))  # one row
        return found.select("key", "at", "level")

    due = "seen + to_days((k % 120 - 20)::INT)"
    as_both(
        reg, "t9_alarm", alarm_sql(f"""CASE WHEN k % 7 = 0 THEN [] WHEN k % 120 - 20 < 0 THEN CASE WHEN k % 3 <> 0 THEN [{{'due': {due} + INTERVAL 1 DAY, 'level': 'ACTION'}}] ELSE [] END
          WHEN k % 3 <> 0 THEN [{{'due': {due} - INTERVAL 45 DAY, 'level': 'SOON'}}, {{'due': {due} + INTERVAL 1 DAY, 'level': 'ACTION'}}] ELSE [{{'due': {due} - INTERVAL 45 DAY, 'level': 'SOON'}}] END"""),
        deadlines, log, states.alarm_stream, "orders", alarms,
    )
    as_both(
        reg, "t10_alarm", alarm_sql("""CASE WHEN k % 9 = 0 THEN [{'due': seen, 'level': 'ACTION'}] WHEN k % 130 >= 91 THEN [{'due': seen, 'level': 'ACTION'}]
          ELSE [{'due': seen, 'level': 'OK'}, {'due': seen + to_days((91 - k % 130)::INT), 'level': 'ACTION'}] END"""),
        stamps, log, states.alarm_stream, "orders", alarms,
    )

    @reg.add("t8_ring_stream", reg.sql["t8_ring"])
    def t8(spark, sf):
        values = source(spark, sf, "events", True).select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("n"), F.col("event_type").alias("value"))
        sent = run_stream(spark, states.ring_stream(values, 12), "update")
        newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), F.desc("n")))
        return sent.withColumn("k", newest).filter("k = 1").select(F.col("key").cast("bigint").alias("user_id"), "history")
