"""Queries of the aggregation family (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import aggregates as agg
from ledgerloom.plans.registry import Registry
from ledgerloom.session import held, table

TOKENS = "[^a-z]+"


def tokens(spark, sf):
    """doc_id, token: ASCII words of English documents."""
    d = table(spark, sf, "documents").filter("lang = 'en'")
    return d.select("doc_id", F.explode(F.split(F.lower("text"), TOKENS)).alias("token")).filter(F.length("token") >= 3)


TOKENS_SQL = "tokens AS (SELECT * FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents WHERE lang = 'en') WHERE length(token) >= 3)"


def register(reg: Registry) -> None:
    @reg.add("a1_share", """
        SELECT k AS source, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM (SELECT coalesce(nullif(trim(source), ''), '(blank)') AS k, count(*)::BIGINT AS n FROM documents GROUP BY 1)""")
    def a1(spark, sf):
        return agg.counts_with_share(table(spark, sf, "documents"), "source")

    @reg.add("a2_count_if", """
        SELECT l_returnflag, count_if(l_quantity > 25)::BIGINT AS big, count_if(l_discount >= 0.05)::BIGINT AS discounted, count_if(l_tax = 0)::BIGINT AS untaxed FROM lineitem GROUP BY 1""")
    def a2(spark, sf):
        return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("big"), F.count_if(F.col("l_discount") >= 0.05).alias("discounted"), F.count_if(F.col("l_tax") == 0).alias("untaxed"))

    @reg.add("a3_filtered_subset", """
        SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R')::BIGINT AS returned, round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 4) AS mean_returned, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
    def a3(spark, sf):
        r = F.col("l_returnflag") == "R"
        return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count_if(r).alias("returned"), F.round(F.avg(F.when(r, F.col("l_extendedprice"))), 4).alias("mean_returned"), F.count("*").alias("n"))

    @reg.add("a4_having_rates", """
        SELECT s_nationkey, count(*)::BIGINT AS n, avg((l_returnflag = 'R')::INT) AS returned, avg((l_discount > 0.05)::INT) AS discounted FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(*) >= 100""")
    def a4(spark, sf):
        j = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return agg.rates(j, "s_nationkey", {"returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") > 0.05}, 100)

    @reg.add("a5_crosstab", """
        SELECT year(o_orderdate)::INT AS year, count_if(o_orderstatus = 'F')::BIGINT AS "F", count_if(o_orderstatus = 'O')::BIGINT AS "O", count_if(o_orderstatus = 'P')::BIGINT AS "P", count(*)::BIGINT AS total FROM orders GROUP BY 1""")
    def a5(spark, sf):
        per = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
        return per.withColumn("total", F.col("F") + F.col("O") + F.col("P"))

    @reg.add("a6_dual_grain", f"""
        WITH {TOKENS_SQL}, g AS (SELECT token, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS occurrences FROM tokens GROUP BY 1)
        SELECT token, docs, occurrences FROM g WHERE docs >= 20 UNION ALL SELECT '(below floor)', count(*)::BIGINT, sum(occurrences)::BIGINT FROM g WHERE docs < 20""")
    def a6(spark, sf):
        g = agg.dual_grain(tokens(spark, sf), "doc_id", "token")
        rest = g.filter("docs < 20").agg(F.count("*").alias("docs"), F.sum("occurrences").alias("occurrences"))
        return g.filter("docs >= 20").unionByName(rest.select(F.lit("(below floor)").alias("token"), "docs", "occurrences"))

    @reg.add("a7_ratios", """
        WITH w AS (SELECT doc_id, u.w, u.i, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents WHERE lang = 'en'), unnest(ws) WITH ORDINALITY u(w, i))
        SELECT lower(w) AS token, count(*)::BIGINT AS n, round(avg((w = upper(w))::INT), 6) AS caps, round(avg(((i - 1) / n::DOUBLE < 0.15 OR (i - 1) / n::DOUBLE > 0.75)::INT), 6) AS edge FROM w GROUP BY 1 HAVING count(*) >= 200""")
    def a7(spark, sf):
        d = table(spark, sf, "documents").filter("lang = 'en'").select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("ws"))
        w = d.select(F.size("ws").alias("n"), F.posexplode("ws").alias("i", "w"))
        at = F.col("i") / F.col("n")
        return w.groupBy(F.lower("w").alias("token")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("w") == F.upper("w")).cast("int")), 6).alias("caps"), F.round(F.avg(((at < 0.15) | (at > 0.75)).cast("int")), 6).alias("edge")).filter("n >= 200")

    @reg.add("a8_lift", f"""
        WITH {TOKENS_SQL}, d AS (SELECT DISTINCT doc_id, token FROM tokens), base AS (SELECT avg(toxic) AS b FROM labels)
        SELECT token, count(*)::BIGINT AS docs, round(avg(toxic), 6) AS rate, round(CASE WHEN any_value(b) > 0 THEN avg(toxic) / any_value(b) ELSE 0 END, 6) AS lift FROM d JOIN labels USING (doc_id) CROSS JOIN base GROUP BY 1 HAVING count(*) >= 10""")
    def a8(spark, sf):
        return agg.lift(tokens(spark, sf), "doc_id", "token", table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", 10)

    @reg.add("a9_cooccurrence", f"""
        WITH {TOKENS_SQL}, d AS (SELECT DISTINCT doc_id, token FROM tokens)
        SELECT token, count(*)::BIGINT AS docs, round(avg(1 - quality), 6) AS deny_rate FROM d JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 10""")
    def a9(spark, sf):
        d = tokens(spark, sf).distinct().join(table(spark, sf, "labels"), "doc_id")
        return d.groupBy("token").agg(F.count("*").alias("docs"), F.round(F.avg(1 - F.col("quality")), 6).alias("deny_rate")).filter("docs >= 10")

    @reg.add("a11_quorum", """
        WITH v AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS source, nullif(o_orderstatus, 'P') AS value FROM orders)
        SELECT o_custkey, month, CASE WHEN count(DISTINCT coalesce(value, '-')) = 1 THEN max(value) END AS value,
          CASE WHEN count(DISTINCT coalesce(value, '-')) > 1 THEN 'low' WHEN count(DISTINCT source) > 1 THEN 'high' ELSE 'medium' END AS confidence, count(DISTINCT source)::BIGINT AS sources FROM v GROUP BY 1, 2""")
    def a11(spark, sf):
        v = table(spark, sf, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("value"))
        return agg.quorum(v, ["o_custkey", "month"], "value", "source")

    @reg.add("a12_fiscal_median", """
        WITH d AS (SELECT 'FY' || year(o_orderdate + INTERVAL 3 MONTH) || 'Q' || quarter(o_orderdate + INTERVAL 3 MONTH) AS quarter, date_diff('day', o_orderdate, l_shipdate) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
        SELECT quarter, count(*)::BIGINT AS n, round_even(quantile_cont(days, 0.5) FILTER (days >= 0), 0)::BIGINT AS median FROM d GROUP BY 1 HAVING count(*) FILTER (days >= 0) > 0""")
    def a12(spark, sf):
        from ledgerloom.functions.dates import fiscal_quarter

        j = table(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
        return agg.exact_median(j.select(fiscal_quarter(F.to_date("o_orderdate")).alias("quarter"), F.datediff("l_shipdate", "o_orderdate").alias("days")), ["quarter"], "days")

    @reg.add("a13_status_other", """
        SELECT o_orderpriority, count_if(o_orderstatus = 'F')::BIGINT AS final, count_if(o_orderstatus = 'O')::BIGINT AS open, count_if(o_orderstatus NOT IN ('F', 'O'))::BIGINT AS other FROM orders GROUP BY 1""")
    def a13(spark, sf):
        s = F.col("o_orderstatus")
        return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("final"), F.count_if(s == "O").alias("open"), F.count_if(~s.isin("F", "O")).alias("other"))

    @reg.add("a14_grouping_sets", """
        SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""")
    def a14(spark, sf):
        o = table(spark, sf, "orders")
        s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
        return o.groupingSets([[s, p], [s], []], s, p).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))

    @reg.add("a15_suppressed_band", """
        WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2), b AS (SELECT c_mktsegment, coalesce(sum(n) FILTER (n >= 11), 0)::BIGINT AS known, count_if(n < 11)::BIGINT AS suppressed FROM c GROUP BY 1)
        SELECT c_mktsegment, known, suppressed, known + suppressed AS low, known + 10 * suppressed AS high, 9 * suppressed < greatest(50.0, 0.01 * (known + 10 * suppressed)) AS is_point FROM b""")
    def a15(spark, sf):
        c = table(spark, sf, "customer").filter("c_acctbal > 5000").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
        return agg.suppressed_band(c, "c_mktsegment", "n")

    @reg.add("a16_argmax_group", """
        WITH y AS (SELECT c_nationkey, year(o_orderdate)::INT AS y, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
        SELECT c_nationkey, y AS peak_year, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, y) AS k FROM y) WHERE k = 1""")
    def a16(spark, sf):
        j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        y = j.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
        best = F.max_by(F.struct("y", "n"), F.struct("n", (-F.col("y")).alias("early")))
        return y.groupBy("c_nationkey").agg(best.alias("b")).select("c_nationkey", F.col("b.y").alias("peak_year"), "b.n")

    @reg.add("a17_multilabel_counts", """
        WITH l AS (SELECT list_filter(['short', 'english', 'shouting', 'listing'], lambda x: CASE x WHEN 'short' THEN n_chars < 500 WHEN 'english' THEN lang = 'en' WHEN 'shouting' THEN contains(text, '!!') ELSE contains(text, '|') END) AS ls FROM documents)
        SELECT u AS label, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN len(ls) = 0 THEN ['general'] ELSE ls END) AS u FROM l) GROUP BY 1""")
    def a17(spark, sf):
        tests = {"short": F.col("n_chars") < 500, "english": F.col("lang") == "en", "shouting": F.contains("text", F.lit("!!")), "listing": F.contains("text", F.lit("|"))}
        labels = F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))
        return table(spark, sf, "documents").select(F.explode(F.when(F.size(labels) == 0, F.array(F.lit("general"))).otherwise(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))

    @reg.add("a18_all_or_null_sum", """
        WITH k AS (SELECT user_id, CASE WHEN event_type = 'error' AND event_id % 11 = 0 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events)
        SELECT user_id, CASE WHEN count(k) = count(*) THEN sum(k)::BIGINT END AS total FROM k GROUP BY 1""")
    def a18(spark, sf):
        k = F.when((F.col("event_type") == "error") & (F.col("event_id") % 11 == 0), None).otherwise(F.get_json_object("props", "$.k").cast("long"))
        return agg.all_or_null_sum(table(spark, sf, "events"), "user_id", k)

    @reg.add("a19_weighted_risk", """
        SELECT l_orderkey, sum(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END)::BIGINT AS risk FROM lineitem GROUP BY 1""")
    def a19(spark, sf):
        weight = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0) + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
        return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(weight).alias("risk"))

    @reg.add("a20_pace_quantiles", """
        WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2), d AS (SELECT o_orderpriority, n - lag(n) OVER (PARTITION BY o_orderpriority ORDER BY month) AS delta FROM m)
        SELECT o_orderpriority, round(quantile_cont(delta, 0.25), 6) AS p25, round(quantile_cont(delta, 0.5), 6) AS p50, round(quantile_cont(delta, 0.75), 6) AS p75, count_if(delta < 0)::BIGINT AS retro, count(delta) >= 24 AS usable FROM d GROUP BY 1""")
    def a20(spark, sf):
        from ledgerloom.operators.series import lag_delta

        m = table(spark, sf, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
        deltas = held(lag_delta(m, "o_orderpriority", "month", "n"))
        found = agg.exact_quantiles(deltas, ["o_orderpriority"], "delta", [0.25, 0.5, 0.75])
        at = lambda q: F.round(F.max(F.when(F.col("share") == q, F.col("quantile"))), 6)
        wide = found.groupBy("o_orderpriority").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
        rest = deltas.groupBy("o_orderpriority").agg(F.count_if(F.col("delta") < 0).alias("retro"), (F.count("delta") >= 24).alias("usable"))
        return rest.join(wide, "o_orderpriority", "left").select("o_orderpriority", "p25", "p50", "p75", "retro", "usable")

    @reg.add("a20_quantiles_of_all", """
        SELECT unnest([0.0, 0.1, 0.5, 0.75, 0.999, 1.0])::DOUBLE AS share, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.5, 0.75, 0.999, 1.0])), 6) AS quantile FROM lineitem""")
    def a20_all(spark, sf):
        return agg.exact_quantiles(table(spark, sf, "lineitem"), [], "l_extendedprice", [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]).withColumn("quantile", F.round("quantile", 6))  # one group of all rows

    @reg.add("a21_kpis", """
        WITH m AS (SELECT mode(o_orderpriority) AS x FROM (SELECT o_orderpriority FROM orders ORDER BY o_orderpriority)), t AS (SELECT o_orderpriority AS top, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)
        SELECT round((SELECT count(*) FROM orders)::DOUBLE / (SELECT count(*) FROM orders WHERE o_orderstatus = 'P'))::BIGINT AS one_in, top, round(n / (SELECT count(*) FROM orders)::DOUBLE, 6) AS share FROM t""")
    def a21(spark, sf):
        o = table(spark, sf, "orders")
        per = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
        best = F.min_by(F.struct("o_orderpriority", "n"), F.struct((-F.col("n")).alias("m"), "o_orderpriority"))
        k = per.agg(F.sum("n").alias("all"), F.sum("p").alias("p"), best.alias("b"))
        return k.select(F.round(F.col("all") / F.col("p")).cast("long").alias("one_in"), F.col("b.o_orderpriority").alias("top"), F.round(F.col("b.n") / F.col("all"), 6).alias("share"))

    @reg.add("a24_fingerprint", """
        WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT user_id, substr(sha1(string_agg(event_type || '=' || n, '|' ORDER BY event_type || '=' || n)), 1, 16) AS fingerprint FROM g GROUP BY 1""")
    def a24(spark, sf):
        return agg.fingerprint(table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "user_id", ["event_type", "n"])

    @reg.add("a25_bounds", "SELECT event_type, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last, max(event_id) AS newest FROM events GROUP BY 1")
    def a25(spark, sf):
        day = lambda c: F.date_format(c, "yyyy-MM-dd")
        return table(spark, sf, "events").groupBy("event_type").agg(day(F.min("ts")).alias("first"), day(F.max("ts")).alias("last"), F.max("event_id").alias("newest"))

    @reg.add("a28_unpivot_rank", """
        WITH f AS (SELECT count_if(contains(text, '!!')) AS shout, count_if(contains(text, '|')) AS pipe, count_if(contains(text, 'zzzz')) AS never, count_if(contains(text, '$$$')) AS money FROM documents), u AS (UNPIVOT f ON shout, pipe, never, money INTO NAME flag VALUE n)
        SELECT flag, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, flag)::INT AS rank FROM u WHERE n > 0""")
    def a28(spark, sf):
        flags = {k: F.contains("text", F.lit(v)) for k, v in {"shout": "!!", "pipe": "|", "never": "zzzz", "money": "$$$"}.items()}
        return agg.unpivot_ranked(table(spark, sf, "documents"), flags)

    @reg.add("a30_axis_max", "SELECT l_returnflag, max(l_extendedprice) FILTER (l_discount < 0.09) AS axis FROM lineitem GROUP BY 1")
    def a30(spark, sf):
        return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.max(F.when(F.col("l_discount") < 0.09, F.col("l_extendedprice"))).alias("axis"))

    @reg.add("a35_padded_domain", """
        SELECT event_type, round(lo - pad, 6) AS low, round(hi + pad, 6) AS high FROM (SELECT event_type, min(value) AS lo, max(value) AS hi, CASE WHEN max(value) = min(value) THEN 1 ELSE 0.05 * (max(value) - min(value)) END AS pad FROM events GROUP BY 1)""")
    def a35(spark, sf):
        e = table(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        pad = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(0.05 * (F.col("hi") - F.col("lo")))
        return e.select("event_type", F.round(F.col("lo") - pad, 6).alias("low"), F.round(F.col("hi") + pad, 6).alias("high"))
