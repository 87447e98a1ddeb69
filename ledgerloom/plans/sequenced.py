"""Queries over sequences, orders and sets (W*, O*, U*, T*, x_*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import ranking, series
from ledgerloom.operators.ordered import numbered
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table

MONTHLY = "m AS (SELECT o_orderstatus AS s, strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2)"


def monthly(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("s"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def register(reg: Registry) -> None:
    @reg.add("w1_lag_delta", f"WITH {MONTHLY} SELECT *, n - lag(n) OVER (PARTITION BY s ORDER BY month) AS delta FROM m")
    def w1(spark, sf):
        return series.lag_delta(monthly(spark, sf), "s", "month", "n")

    @reg.add("w2_state", f"""
        WITH {MONTHLY}, d AS (SELECT *, n - lag(n) OVER (PARTITION BY s ORDER BY month) AS delta FROM m)
        SELECT s, month, CASE WHEN delta IS NULL THEN 'start' WHEN abs(delta) <= 5 THEN 'stall' WHEN delta > 0 THEN 'advance' ELSE 'retro' END AS state FROM d""")
    def w2(spark, sf):
        d = series.lag_delta(monthly(spark, sf), "s", "month", "n")
        return d.select("s", "month", series.movement_state(F.col("n"), F.col("delta"), 5).alias("state"))

    @reg.add("w3_neighbour_flag", f"""
        WITH {MONTHLY}, x AS (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b FROM m WINDOW w AS (PARTITION BY s ORDER BY month)),
        y AS (SELECT s, month, n, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0) + coalesce(b, 0))::DOUBLE / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END AS neighbours FROM x)
        SELECT *, coalesce(n < 0.8::DOUBLE * neighbours, false) AS is_low FROM y""")
    def w3(spark, sf):
        return series.neighbour_mean(monthly(spark, sf), "s", "month", "n", 0.8)

    @reg.add("w4_islands", """
        WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id % 3 AS g, count_if(event_type = 'error') > count_if(event_type = 'signup') AS up FROM events GROUP BY 1, 2),
        r AS (SELECT *, sum((NOT up)::INT) OVER (PARTITION BY g ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM d)
        SELECT g, min(day) AS first, max(day) AS last, count(*)::BIGINT AS rows FROM r WHERE up GROUP BY g, run""")
    def w4(spark, sf):
        kind = F.col("event_type")
        d = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 3).alias("g")).agg((F.count_if(kind == "error") > F.count_if(kind == "signup")).alias("up"))
        return series.islands(d, ["g"], "day", F.col("up"))

    @reg.add("w5_transition", """
        WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS v FROM events GROUP BY 1, 2),
        s AS (SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN v < 3 THEN NULL WHEN v > 30 THEN 'CURRENT' ELSE CAST(day AS VARCHAR) END AS c FROM d),
        l AS (SELECT *, lag(c) OVER w AS p, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day))
        SELECT user_id, day, CASE WHEN p IS NULL AND c IS NULL THEN 'still unavailable' WHEN p IS NULL THEN 'reopened' WHEN c IS NULL THEN 'went unavailable' WHEN p = 'CURRENT' AND c = 'CURRENT' THEN 'still current'
          WHEN c = 'CURRENT' THEN 'became current' WHEN p = 'CURRENT' THEN 'left current' WHEN p = c THEN 'unchanged' WHEN p < c THEN 'advanced' ELSE 'retrogressed' END AS change FROM l WHERE k > 1""")
    def w5(spark, sf):
        d = table(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("value").alias("v"))
        d = d.withColumn("c", F.when(F.col("v") < 3, None).when(F.col("v") > 30, "CURRENT").otherwise(F.col("day")))
        w = Window.partitionBy("user_id").orderBy("day")
        return d.withColumn("p", F.lag("c").over(w)).withColumn("k", F.row_number().over(w)).filter("k > 1").select("user_id", "day", series.transition(F.col("p"), F.col("c")).alias("change"))

    @reg.add("w6_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
    def w6(spark, sf):
        return ranking.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 25)

    @reg.add("w7_argmax_score", """
        WITH s AS (SELECT user_id, event_id, event_type, round(CASE event_type WHEN 'error' THEN 0.5 WHEN 'purchase' THEN 0.4 ELSE 0 END + 0.25 * least(value / 40, 1), 6) AS score FROM events)
        SELECT user_id, event_id, event_type, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS k FROM s) WHERE k = 1""")
    def w7(spark, sf):
        score = F.when(F.col("event_type") == "error", 0.5).when(F.col("event_type") == "purchase", 0.4).otherwise(0.0) + 0.25 * F.least(F.col("value") / 40, F.lit(1.0))
        return series.best_of_group(table(spark, sf, "events").select("user_id", "event_id", "event_type", F.round(score, 6).alias("score")), "user_id", "score", ["event_id"])

    @reg.add("w8_prefer_upper", """
        SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
    def w8(spark, sf):
        best = F.min_by("o_orderkey", F.struct((F.col("o_orderpriority") != "1-URGENT").alias("n"), "o_orderdate", "o_orderkey"))
        return table(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"))

    @reg.add("w10_first_occurrence", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
    def w10(spark, sf):
        return table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))

    @reg.add("w11_span_to_next", """
        SELECT event_id, least(coalesce(date_diff('second', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 86400), 86400)::BIGINT AS span FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)""")
    def w11(spark, sf):
        e = table(spark, sf, "events").select("event_id", "user_id", F.date_trunc("second", "ts").cast("timestamp").alias("ts"))
        after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return e.select("event_id", F.least(F.coalesce(F.unix_timestamp(after) - F.unix_timestamp("ts"), F.lit(86400)), F.lit(86400)).cast("long").alias("span"))

    @reg.add("w12_running_total", "WITH d AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2) SELECT *, sum(q) OVER (PARTITION BY l_suppkey ORDER BY month ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM d")
    def w12(spark, sf):
        d = table(spark, sf, "lineitem").groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum("l_quantity").cast("long").alias("q"))
        return d.withColumn("running", F.sum("q").over(Window.partitionBy("l_suppkey").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    @reg.add("w14_streak", """
        WITH r AS (SELECT event_id, user_id, ts, event_type = 'error' AS hit, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
        SELECT event_id, user_id, sum(hit::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM r""")
    def w14(spark, sf):
        e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
        return series.streaks(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "streak")

    @reg.add("w15_capped_topn")
    def w15(spark, sf):
        e = table(spark, sf, "events")
        labels = F.array_compact(F.array(F.when(F.col("value") > 20, "high"), F.when(F.col("user_id") % 2 == 0, "even"), F.lit("all")))
        items = e.select(F.date_format("ts", "yyyy-MM-dd").alias("snapshot"), "event_id", F.col("user_id").cast("string").alias("sub"), labels.alias("labels"))
        return series.capped_top(items, "snapshot", [F.col("event_id")], "sub", "labels", 60, 2, 15).select("snapshot", "place", "event_id", "sub")

    @reg.add("w16_recency_buckets", """
        WITH b AS (SELECT event_id, CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') <= 7 THEN 'recent' ELSE 'older' END AS bucket, row_number() OVER (PARTITION BY date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') <= 7 ORDER BY ts DESC, event_id) AS k FROM events)
        SELECT event_id, bucket, k::INT AS k FROM b WHERE k <= CASE bucket WHEN 'recent' THEN 10 ELSE 20 END""")
    def w16(spark, sf):
        bucket = F.when(F.datediff(F.lit("2024-01-30").cast("date"), "ts") <= 7, "recent").otherwise("older")
        b = table(spark, sf, "events").select("event_id", "ts", bucket.alias("bucket"))
        top = [b.filter(F.col("bucket") == name).orderBy(F.desc("ts"), "event_id").limit(n) for name, n in (("recent", 10), ("older", 20))]
        return top[0].unionByName(top[1]).withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("ts"), "event_id"))).select("event_id", "bucket", "k")

    @reg.add("w17_segments", """
        WITH d AS (SELECT user_id % 5 AS g, day(ts)::INT AS d, count_if(event_type = 'purchase') > 0 AS dated FROM events GROUP BY 1, 2), r AS (SELECT *, sum((NOT dated)::INT) OVER (PARTITION BY g ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM d)
        SELECT g, min(d) AS first, CASE WHEN count(*) >= 2 THEN 'segment' ELSE 'point' END AS kind FROM r WHERE dated GROUP BY g, run""")
    def w17(spark, sf):
        d = table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("g"), F.dayofmonth("ts").alias("d")).agg((F.count_if(F.col("event_type") == "purchase") > 0).alias("dated"))
        return series.islands(d, ["g"], "d", F.col("dated")).select("g", "first", F.when(F.col("rows") >= 2, "segment").otherwise("point").alias("kind"))

    @reg.add("o2_rank", """
        SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 9 END, value DESC, event_id)::INT AS place FROM events ORDER BY place LIMIT 100""")
    def o2(spark, sf):
        order = [ranking.rank_of("event_type", ["error", "purchase", "signup"], 9), F.desc("value"), F.col("event_id")]
        top = table(spark, sf, "events").select("event_id", "event_type", "value").orderBy(*order).limit(100)
        return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("event_id", "place")

    @reg.add("o3_blanks_last", """
        SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_type = 'view' THEN NULL ELSE value END DESC NULLS LAST, event_id)::BIGINT AS place FROM events""")
    def o3(spark, sf):
        e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("v"))
        return numbered(e, [F.desc_nulls_last("v"), "event_id"]).select("event_id", "place")

    @reg.add("o4_most_common", "SELECT p_name, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10")
    def o4(spark, sf):
        return table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(10)

    @reg.add("o6_slot_pick", """
        WITH c AS (SELECT user_id, event_id, (json_extract(props, '$.k')::INT % 8) AS want FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY user_id, want ORDER BY event_id) AS k FROM c WHERE want BETWEEN 1 AND 3),
        first AS (SELECT user_id, event_id, want AS slot FROM d WHERE k = 1), holes AS (SELECT user_id, slot, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS i FROM (SELECT DISTINCT user_id, unnest([1, 2, 3]) AS slot FROM events) h ANTI JOIN first USING (user_id, slot)),
        rest AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM c ANTI JOIN first USING (event_id))
        SELECT * FROM first UNION ALL SELECT user_id, event_id, slot FROM rest JOIN holes USING (user_id, i)""")
    def o6(spark, sf):
        e = table(spark, sf, "events").select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("int") % 8).alias("want"))
        return ranking.slots(e, "user_id", "want", ["event_id"], 3).select("user_id", "event_id", "slot")

    @reg.add("o7_stratified", """
        WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7:' || doc_id), doc_id) AS round, count(*) OVER (PARTITION BY lang, source) AS size FROM documents)
        SELECT doc_id, lang, source, round::INT AS round FROM (SELECT * FROM r ORDER BY round, size DESC, lang, source LIMIT 120)""")
    def o7(spark, sf):
        return ranking.stratified(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 120, 7)

    @reg.add("o9_rotation", """
        WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, ((i - 33 * 7 % n + n) % n)::INT AS turn FROM s WHERE (i - 33 * 7 % n + n) % n < 7""")
    def o9(spark, sf):
        return ranking.rotation(table(spark, sf, "supplier").select("s_suppkey"), ["s_suppkey"], 33, 7)

    shifted = "u AS (SELECT event_id, user_id, event_type, 0 AS gen FROM events UNION ALL SELECT event_id // 2, user_id, 'halved', 1 FROM events)"

    def copies(spark, sf):
        """All events, and all again under half their numbers."""
        e = table(spark, sf, "events").select("event_id", "user_id", "event_type").withColumn("gen", F.lit(0))
        return e.unionByName(e.withColumn("event_id", F.floor(F.col("event_id") / 2)).withColumn("event_type", F.lit("halved")).withColumn("gen", F.lit(1)))

    @reg.add("u1_union_all", f"WITH {shifted} SELECT gen, count(*)::BIGINT AS n FROM u GROUP BY 1")
    def u1(spark, sf):
        return copies(spark, sf).groupBy("gen").agg(F.count("*").alias("n"))

    @reg.add("u2_first_wins", f"WITH {shifted} SELECT event_id, arg_min(event_type, gen) AS event_type FROM u GROUP BY 1")
    def u2(spark, sf):
        return copies(spark, sf).groupBy("event_id").agg(F.min_by("event_type", "gen").alias("event_type"))

    @reg.add("u3_last_wins", f"WITH {shifted} SELECT event_id, arg_max(event_type, gen) AS event_type FROM u GROUP BY 1")
    def u3(spark, sf):
        return copies(spark, sf).groupBy("event_id").agg(F.max_by("event_type", "gen").alias("event_type"))

    whole = "u AS (SELECT event_id, user_id, event_type, 0 AS gen FROM events UNION ALL SELECT event_id + 500, user_id, 'shifted', 1 FROM events)"

    def shifted_copies(spark, sf):
        e = table(spark, sf, "events").select("event_id", "user_id", "event_type").withColumn("gen", F.lit(0))
        return e.unionByName(e.withColumn("event_id", F.col("event_id") + 500).withColumn("event_type", F.lit("shifted")).withColumn("gen", F.lit(1)))

    @reg.add("u1_union_all_shifted", f"WITH {whole} SELECT gen, count(*)::BIGINT AS n FROM u GROUP BY 1")
    def u1_shifted(spark, sf):
        return shifted_copies(spark, sf).groupBy("gen").agg(F.count("*").alias("n"))

    @reg.add("u2_first_wins_shifted", f"WITH {whole} SELECT event_id, arg_min(event_type, gen) AS event_type FROM u GROUP BY 1")
    def u2_shifted(spark, sf):
        return shifted_copies(spark, sf).groupBy("event_id").agg(F.min_by("event_type", "gen").alias("event_type"))

    @reg.add("u3_last_wins_shifted", f"WITH {whole} SELECT event_id, arg_max(event_type, gen) AS event_type FROM u GROUP BY 1")
    def u3_shifted(spark, sf):
        return shifted_copies(spark, sf).groupBy("event_id").agg(F.max_by("event_type", "gen").alias("event_type"))

    @reg.add("u5_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
    def u5(spark, sf):
        o = table(spark, sf, "orders")
        side = lambda s: o.filter(F.col("o_orderstatus") == s).select("o_custkey")
        return side("F").intersect(side("P"))

    @reg.add("u6_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
    def u6(spark, sf):
        return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")))

    @reg.add("u7_stable_distinct", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
    def u7(spark, sf):
        return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))

    @reg.add("u8_seen_union", "SELECT user_id FROM events WHERE day(ts) <= 10 UNION SELECT user_id FROM events WHERE event_type = 'error'")
    def u8(spark, sf):
        e = table(spark, sf, "events")
        return e.filter("day(ts) <= 10").select("user_id").union(e.filter("event_type = 'error'").select("user_id")).distinct()

    @reg.add("t1_late_drop", """
        SELECT CASE WHEN ts IS NULL THEN 'no_date' WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-02-20') > 45 THEN 'stale' ELSE 'kept' END AS fate, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS ts FROM events) GROUP BY 1""")
    def t1(spark, sf):
        ts = F.when(F.col("event_id") % 97 != 0, F.col("ts"))
        fate = F.when(ts.isNull(), "no_date").when(F.datediff(F.lit("2024-02-20").cast("date"), ts) > 45, "stale").otherwise("kept")
        return table(spark, sf, "events").groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))

    @reg.add("t4_rolling_window", """
        WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
        SELECT CAST(d.day AS VARCHAR) AS day, sum(n)::BIGINT AS n FROM d JOIN e ON e.day BETWEEN d.day - 20 AND d.day GROUP BY 1""")
    def t4(spark, sf):
        daily = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
        w = Window.orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-20, 0)  # one row a day
        return daily.select(F.col("day").cast("string").alias("day"), F.sum("n").over(w).alias("n"))

    @reg.add("t5_state_machine", """
        WITH f AS (SELECT user_id, day(ts) AS d, min(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END) AS urgency FROM events GROUP BY 1, 2), p AS (SELECT * FROM f WHERE d = 14), c AS (SELECT * FROM f WHERE d = 15)
        SELECT coalesce(c.user_id, p.user_id) AS user_id, CASE WHEN c.user_id IS NULL THEN 'resolved' WHEN p.user_id IS NULL THEN 'new' WHEN c.urgency < p.urgency THEN 'escalated' ELSE 'ongoing' END AS state FROM p FULL JOIN c ON p.user_id = c.user_id""")
    def t5(spark, sf):
        from ledgerloom.streaming.ledger import finding_states

        urgency = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
        f = table(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(F.min(urgency).alias("urgency"))
        return finding_states(f.filter("d = 14"), f.filter("d = 15"), "user_id", "urgency")

    @reg.add("t7_baseline", """
        WITH b AS (SELECT user_id, count(*)::BIGINT AS n, max(event_id) AS newest FROM events WHERE day(ts) <= 15 GROUP BY 1), c AS (SELECT user_id, count(*)::BIGINT AS n, max(event_id) AS newest FROM events GROUP BY 1)
        SELECT c.user_id, c.n - coalesce(b.n, 0) AS added, c.newest IS DISTINCT FROM b.newest AS changed FROM c LEFT JOIN b USING (user_id)""")
    def t7(spark, sf):
        e = table(spark, sf, "events")
        early = F.dayofmonth("ts") <= 15
        both = e.groupBy("user_id").agg(F.count_if(~early).alias("added"), F.max("event_id").alias("c"), F.max(F.when(early, F.col("event_id"))).alias("b"))
        return both.select("user_id", "added", (~F.col("c").eqNullSafe(F.col("b"))).alias("changed"))

    @reg.add("t8_ring", """
        WITH c AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS p, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM c WHERE k = 1 OR event_type <> p)
        SELECT user_id, list(event_type ORDER BY r DESC) AS history FROM d WHERE r <= 12 GROUP BY 1""")
    def t8(spark, sf):
        return series.ring(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", 12)

    @reg.add("t9_horizon", """
        SELECT o_orderkey, CASE WHEN date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) < 0 AND o_orderstatus = 'P' THEN 'ACTION' WHEN date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 45 THEN 'SOON' ELSE 'NONE' END AS alert FROM orders""")
    def t9(spark, sf):
        ahead = F.datediff("o_orderdate", F.lit("1998-06-01"))
        return table(spark, sf, "orders").select("o_orderkey", F.when((ahead < 0) & (F.col("o_orderstatus") == "P"), "ACTION").when(ahead.between(0, 45), "SOON").otherwise("NONE").alias("alert"))

    @reg.add("x_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
    def x_tumbling(spark, sf):
        e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")

    @reg.add("x_session", """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
    def x_session(spark, sf):
        e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
