"""Queries over dates, months and durations written in many layouts (F40-F58, F96-F103).

The texts are made from order dates and keys, so the SQL twins know the answer from the date itself and read no layout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table

# The same columns in both languages: the date in parts.
PARTS = """
o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, upper(strftime(o_orderdate, '%b')) AS mon, strftime(o_orderdate, '%B') AS month, strftime(o_orderdate, '%d') AS dd,
  strftime(o_orderdate, '%m') AS mm, strftime(o_orderdate, '%Y') AS yyyy, day(o_orderdate)::INT AS day, month(o_orderdate)::INT AS m, year(o_orderdate)::INT AS y FROM orders)"""


def _orders(spark, sf):
    d = F.to_date("o_orderdate")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), d.alias("d"))
    return o.select("*", F.upper(F.date_format("d", "MMM")).alias("mon"), F.date_format("d", "MMMM").alias("month"), F.date_format("d", "dd").alias("dd"), F.date_format("d", "MM").alias("mm"), F.date_format("d", "yyyy").alias("yyyy"), F.dayofmonth("d").alias("day"), F.month("d").alias("m"), F.year("d").alias("y"))


def _pick(*texts: Column | str) -> Column:
    """One of the texts by the key's remainder."""
    case = F
    for i, t in enumerate(texts):
        case = case.when(F.col("k") % len(texts) == i, t)
    return case


def _text(form: str, *columns: str) -> Column:
    return F.format_string(form, *columns)


def register(reg: Registry) -> None:
    @reg.add("f40_file_date", f"""
        WITH {PARTS} SELECT k, CASE WHEN k % 4 < 2 THEN d::VARCHAR END AS date FROM o""")
    def f40(spark, sf):
        name = _pick(_text("%s%s%s_01B5203.pdf", "mon", "dd", "yyyy"), _text("a/b/%s%s%s_12B7.pdf", "mon", "dd", "yyyy"), F.lit("WLY012021_01B5203.pdf"), _text("FEB31%s_02B5203", "yyyy"))
        return _orders(spark, sf).select("k", dates.file_date(name).cast("string").alias("date"))

    @reg.add("f41_body_date", f"""
        WITH {PARTS} SELECT k, CASE k % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE d::VARCHAR END AS date FROM o""")
    def f41(spark, sf):
        split = F.concat(F.substring("dd", 1, 1), F.lit(" "), F.substring("dd", 2, 1))
        text = _pick(_text("In Re: 12345 Date: %s. %d, %s Appeal", "mon", "day", "yyyy"), _text("x date:  %s %d,%s", "mon", "day", "yyyy"), F.concat(F.lit("DATE: "), "mon", F.lit(" "), split, F.lit(" "), "yyyy"), _text("Date: WLY. %d, %s DATE: JUL 0 1 2021", "day", "yyyy"), F.lit("no date"))
        return _orders(spark, sf).select("k", dates.body_date(text).cast("string").alias("date"))

    @reg.add("f42_date_precedence", f"""
        WITH {PARTS} SELECT k, CASE k % 4 WHEN 3 THEN NULL ELSE d::VARCHAR END AS date, CASE k % 4 WHEN 3 THEN '' WHEN 2 THEN 'body' ELSE 'filename' END AS source, k % 4 = 1 AS disagrees FROM o""")
    def f42(spark, sf):
        good, other = _text("%s%s%s_01B5203", "mon", "dd", "yyyy"), _text("Date: %s. %d, 1890", "mon", "day")
        body = _text("Date: %s %d, %s", "mon", "day", "yyyy")
        found = dates.sourced_date(_pick(good, good, F.lit("scan.pdf"), F.lit("scan.pdf")), _pick(body, F.when(F.col("dd") == "29", _text("Date: MAR 1, %s", "yyyy")).otherwise(other), body, F.lit("")))
        return _orders(spark, sf).withColumn("f", found).select("k", F.col("f.date").cast("string").alias("date"), "f.source", "f.disagrees")

    @reg.add("f45_as_date", f"""
        WITH {PARTS} SELECT k, CASE WHEN k % 6 < 4 THEN d::VARCHAR END AS date FROM o""")
    def f45(spark, sf):
        text = _pick(_text("%s-%s-%s", "yyyy", "mm", "dd"), _text("%d/%d/%s", "m", "day", "yyyy"), _text(" %s-%s-%s 10:20:30", "yyyy", "mm", "dd"), F.concat(_text("%d/%d/", "m", "day"), F.substring("yyyy", 3, 2)), _text("%d/32/%s", "m", "yyyy"), F.lit("  "))
        return _orders(spark, sf).select("k", dates.as_date(text).cast("string").alias("date"))

    @reg.add("f46_quarter_bounds", """
        SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE::VARCHAR AS quarter_end,
          'FY' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS expected FROM orders""")
    def f46(spark, sf):
        d = F.to_date("o_orderdate")
        return table(spark, sf, "orders").select(d.alias("d")).distinct().select(F.col("d").cast("string").alias("day"), dates.quarter_end(F.col("d")).cast("string").alias("quarter_end"), dates.expected_quarter(F.col("d")).alias("expected"))

    @reg.add("f47_month_range", """
        WITH b AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1)
        SELECT o_custkey, strftime(m, '%Y-%m') AS month, strftime(m - INTERVAL 1 MONTH, '%Y-%m') AS previous FROM b, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', z)::TIMESTAMP, INTERVAL 1 MONTH)) AS t(m)""")
    def f47(spark, sf):
        bounds = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
        months = bounds.select("o_custkey", F.explode(dates.month_range(dates.month_key(F.col("a")), dates.month_key(F.col("z")))).alias("month"))
        return months.select("*", dates.previous_month(F.col("month")).alias("previous"))

    @reg.add("f48_directory_year", """
        SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END)::INT AS folder FROM orders""")
    def f48(spark, sf):
        months = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
        return months.select("month", dates.directory_year(F.col("month")).alias("folder"))

    @reg.add("f50_months_apart", """
        WITH b AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1),
        n AS (SELECT o_custkey, ((year(z) - year(a)) * 12 + month(z) - month(a))::INT AS months FROM b)
        SELECT o_custkey, months, CASE WHEN months < 12 THEN months || CASE WHEN months = 1 THEN ' month' ELSE ' months' END
          ELSE (months // 12) || CASE WHEN months // 12 = 1 THEN ' year' ELSE ' years' END || CASE WHEN months % 12 = 0 THEN '' ELSE ' ' || (months % 12) || CASE WHEN months % 12 = 1 THEN ' month' ELSE ' months' END END END AS said FROM n""")
    def f50(spark, sf):
        bounds = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
        months = bounds.select("o_custkey", dates.months_apart(F.col("a"), F.col("z")).alias("months"))
        return months.select("*", dates.say_months(F.col("months")).alias("said"))

    @reg.add("f51_named_month", f"""
        WITH {PARTS} SELECT k, CASE WHEN k % 6 < 3 THEN yyyy || '-' || mm END AS month FROM o""")
    def f51(spark, sf):
        text = _pick(_text("%s %s", "month", "yyyy"), _text("about %s. %s", "mon", "yyyy"), F.concat(F.substring("month", 1, 4), F.lit(" "), "yyyy"), F.lit("N/A"), _text("%s 1870", "month"), _text("Wly %s", "yyyy"))
        return _orders(spark, sf).select("k", dates.named_month(text).alias("month"))

    @reg.add("f52_us_date_and_number", f"""
        WITH {PARTS} SELECT k, CASE WHEN k % 3 < 2 THEN d::VARCHAR END AS date, CASE WHEN k % 4 < 2 THEN k + 1000000 END AS number FROM o""")
    def f52(spark, sf):
        date = _pick(_text("%d/%d/%s", "m", "day", "yyyy"), _text("as of %s/%s/%s now", "mm", "dd", "yyyy"), _text("13/%d/%s", "day", "yyyy"))
        number = _pick(_text("%,d", F.col("k") + 1000000), _text("n = %d items", F.col("k") + 1000000), F.lit("--"), F.lit(""))
        return _orders(spark, sf).select("k", dates.us_date(date).cast("string").alias("date"), dates.whole_number(number).alias("number"))

    @reg.add("f53_prose_dates", f"""
        WITH {PARTS}, p AS (SELECT k, d, d + INTERVAL 40 DAY AS e, month, dd, day, yyyy, mm, 'By 8 CFR 214.2(h). The window opens on ' AS lead FROM o)
        SELECT k, d::VARCHAR AS date, 'The window opens on ' || CASE k % 3 WHEN 0 THEN month || ' ' || day || ', ' || yyyy WHEN 1 THEN day || ' ' || month || ' ' || yyyy ELSE d::VARCHAR END || ', see No.1:26.' AS sentence FROM p
        UNION ALL SELECT k, e::DATE::VARCHAR, 'It shuts on ' || e::DATE::VARCHAR || ' again' FROM p""")
    def f53(spark, sf):
        o = _orders(spark, sf)
        day = F.when(F.col("k") % 3 == 0, _text("%s %d, %s", "month", "day", "yyyy")).when(F.col("k") % 3 == 1, _text("%d %s %s", "day", "month", "yyyy")).otherwise(F.col("d").cast("string"))
        text = F.concat(F.lit("By 8 CFR 214.2(h). The window opens on "), day, F.lit(", see No.1:26. It shuts on "), F.date_add("d", 40).cast("string"), F.lit(" again"))
        found = o.select("k", text.alias("text")).select("k", "text", F.explode(dates.prose_dates(F.col("text"))).alias("f"))
        return found.select("k", F.col("f.date").cast("string").alias("date"), dates.sentence_around(F.col("text"), F.col("f.at")).alias("sentence"))

    @reg.add("f53_dates_apart", """
        WITH o AS (SELECT o_orderkey AS k, date_trunc('month', o_orderdate)::DATE AS m, o_orderkey % 9 AS n, o_orderkey % 3 AS a, o_orderkey // 3 % 3 AS b FROM orders), e AS (SELECT k, a, b, m + n::INT AS early, m + n::INT + 10 AS late FROM o),
        s AS (SELECT k, late, early, CASE a WHEN 0 THEN strftime(late, '%-d %B %Y') WHEN 1 THEN strftime(late, '%b %-d, %Y') ELSE strftime(late, '%Y-%m-%d') END AS lt, CASE b WHEN 0 THEN strftime(early, '%-d %B %Y') WHEN 1 THEN strftime(early, '%B %-d,  %Y') ELSE strftime(early, '%Y-%m-%d') END AS et FROM e)
        SELECT k, 1 AS n, late::VARCHAR AS date, instr('Due ' || lt, lt)::INT AS at, 'Due ' || lt || ' at noon.' AS sentence FROM s
        UNION ALL SELECT k, 2, early::VARCHAR, (length('Due ' || lt || ' at noon. Then on ') + 1)::INT, 'Then on ' || et || ' it shut.' FROM s""")
    def f53_apart(spark, sf):
        o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("m"))
        early = F.date_add("m", (F.col("k") % 9).cast("int"))
        late = F.date_add(early, 10)  # 11 May where the other is 1 May: the one is found inside the other
        as_text = lambda d, n, one, two: F.when(n == 0, F.date_format(d, one)).when(n == 1, F.date_format(d, two)).otherwise(F.date_format(d, "yyyy-MM-dd"))
        a, b = F.col("k") % 3, F.floor(F.col("k") / 3) % 3
        text = F.concat(F.lit("Due "), as_text(late, a, "d MMMM yyyy", "MMM d, yyyy"), F.lit(" at noon. Then on "), as_text(early, b, "d MMMM yyyy", "MMMM d,  yyyy"), F.lit(" it shut. Not on 31 February 2020, to Mayor 5, 2020, v1 May 20201; and the first again: "), F.date_format(late, "yyyy-MM-dd"))
        found = o.select("k", text.alias("text")).select("k", "text", F.posexplode(dates.prose_dates(F.col("text"))).alias("n", "f"))
        return found.select("k", (F.col("n") + 1).alias("n"), F.col("f.date").cast("string").alias("date"), F.col("f.at").alias("at"), dates.sentence_around(F.col("text"), F.col("f.at")).alias("sentence"))

    @reg.add("f54_say_days", """
        WITH n AS (SELECT DISTINCT (o_orderkey % 1500)::INT AS days FROM orders),
        s AS (SELECT days, floor(days / 7 + 0.5)::INT AS w, floor(days / 30 * 10 + 0.5) / 10 AS m, floor(days / 365 * 10 + 0.5) / 10 AS y FROM n)
        SELECT days, CASE WHEN days < 14 THEN days || CASE WHEN days = 1 THEN ' day' ELSE ' days' END WHEN days < 60 THEN 'about ' || w || CASE WHEN w = 1 THEN ' week' ELSE ' weeks' END
          WHEN days < 365 THEN 'about ' || regexp_replace(m::VARCHAR, '\\.0$', '') || CASE WHEN m = 1 THEN ' month' ELSE ' months' END
          ELSE 'about ' || regexp_replace(y::VARCHAR, '\\.0$', '') || CASE WHEN y = 1 THEN ' year' ELSE ' years' END END AS said FROM s""")
    def f54(spark, sf):
        days = table(spark, sf, "orders").select((F.col("o_orderkey") % 1500).cast("int").alias("days")).distinct()
        return days.select("days", dates.say_days(F.col("days")).alias("said"))

    @reg.add("f55_stale_months", """
        WITH m AS (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m') AS as_of, strftime(max(o_orderdate), '%Y-%m') AS verified, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1)
        SELECT o_custkey, as_of, verified, (year(z) * 12 + month(z)) - (year(a) * 12 + month(a)) > 2 AS stale FROM m""")
    def f55(spark, sf):
        m = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
        m = m.select("o_custkey", dates.month_key(F.col("a")).alias("as_of"), dates.month_key(F.col("z")).alias("verified"))
        return m.select("*", dates.stale(F.col("as_of"), F.col("verified")).alias("stale"))

    @reg.add("f56_say_age", """
        SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'as of ' || o_orderdate::DATE || ', ' || date_diff('day', o_orderdate::DATE, DATE '1999-01-01') || CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1999-01-01') = 1 THEN ' day ago' ELSE ' days ago' END END AS said FROM orders""")
    def f56(spark, sf):
        day = F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate"))
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), dates.say_age(day, F.lit("1999-01-01").cast("date")).alias("said"))

    @reg.add("f57_scheduling_month", f"""
        WITH {PARTS} SELECT k, CASE WHEN k % 6 < 4 THEN (y + 20) || '-' || mm END AS month FROM o""")
    def f57(spark, sf):
        later = F.col("y") + 20
        text = _pick(F.concat(F.initcap("mon"), F.lit("-"), later), F.concat("month", F.lit(" "), later), F.concat(F.col("m"), F.lit("/"), later), F.concat(later, F.lit("-"), "m"), F.concat(F.lit("13/"), later), F.concat("month", F.lit(" 1999")))
        return _orders(spark, sf).select("k", dates.scheduling_month(text).alias("month"))

    @reg.add("f58_sort_key", f"""
        WITH {PARTS} SELECT k, CASE k % 3 WHEN 2 THEN '99999999' ELSE yyyy || mm || dd END AS sort_key FROM o""")
    def f58(spark, sf):
        return _orders(spark, sf).select("k", dates.sort_key(_pick(_text("%s. %d, %s", "mon", "day", "yyyy"), _text(" %s %d, %s", "mon", "day", "yyyy"), F.lit(""))).alias("sort_key"))

    @reg.add("f96_month_label", f"""
        WITH {PARTS} SELECT DISTINCT yyyy || '-' || mm AS key, month || ' ' || yyyy AS label FROM o""")
    def f96(spark, sf):
        keys = _orders(spark, sf).select(F.concat_ws("-", "yyyy", "mm").alias("key")).distinct()
        return keys.select("key", dates.month_label(F.col("key")).alias("label"))

    @reg.add("f99_reglue_dates", f"""
        WITH {PARTS} SELECT k, 'EB2 ' || dd || mon || right(yyyy, 2) || ' C ' || dd || mon || right(yyyy, 2) || ' 7 ' || mon || ' 1999' AS text FROM o""")
    def f99(spark, sf):
        yy = F.substring("yyyy", 3, 2)
        split = F.concat("dd", F.lit(" "), F.lower("mon"), F.lit(" "), F.substring("yyyy", 3, 1), F.lit(" "), F.substring("yyyy", 4, 1))
        text = F.concat(F.lit("EB2 "), split, F.lit(" C "), "dd", "mon", yy, F.lit(" 7 "), "mon", F.lit(" 1999"))
        return _orders(spark, sf).select("k", dates.reglue(text).alias("text"))

    @reg.add("f100_show_day", f"""
        WITH {PARTS} SELECT k, CASE k % 3 WHEN 0 THEN left(month, 3) || ' ' || day || ', ' || yyyy WHEN 1 THEN 'Current' ELSE '2020-13-01' END AS shown FROM o""")
    def f100(spark, sf):
        return _orders(spark, sf).select("k", dates.show_day(_pick(F.col("d").cast("string"), F.lit("CURRENT"), F.lit("2020-13-01"))).alias("shown"))

    @reg.add("f102_strict_iso", f"""
        WITH {PARTS} SELECT k, CASE WHEN k % 4 = 0 THEN d::VARCHAR END AS date FROM o""")
    def f102(spark, sf):
        text = _pick(F.col("d").cast("string"), _text("%s-02-30", "yyyy"), _text("%s/%s/%s", "yyyy", "mm", "dd"), _text("%s-%s-%s ", "yyyy", "mm", "dd"))
        return _orders(spark, sf).select("k", dates.strict_iso(text).cast("string").alias("date"))

    @reg.add("f103_axis_percent", """
        SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (year(o_orderdate) + (dayofyear(o_orderdate) - 1)::DOUBLE / dayofyear(make_date(year(o_orderdate), 12, 31)) - 1993) / 4.0::DOUBLE * 100)), 6) AS percent FROM orders""")
    def f103(spark, sf):
        days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
        return days.select(F.col("d").cast("string").alias("day"), F.round(dates.axis_percent(F.col("d"), 1993, 1997), 6).alias("percent"))
