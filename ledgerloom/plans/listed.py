"""Queries over lists, orders, columns and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, lexicons, text
from ledgerloom.operators import governance, joins, ranking
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table


def register(reg: Registry) -> None:
    @reg.add("p7_multi_field", """
        SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') AND p_size = 11 AND (p_brand LIKE '%1%' OR p_type = 'ECONOMY')""")
    def p7(spark, sf):
        p = table(spark, sf, "part")
        return p.filter(F.contains(F.lower("p_name"), F.lit("ring")) & (F.col("p_size") == 11) & (F.contains("p_brand", F.lit("1")) | (F.col("p_type") == "ECONOMY"))).select("p_partkey")

    @reg.add("p9_haystack", """
        SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring brand#1')""")
    def p9(spark, sf):
        hay = table(spark, sf, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("hay"))
        return hay.filter(F.contains("hay", F.lit("ring brand#1"))).select("p_partkey")

    @reg.add("p22_year_range", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996")
    def p22(spark, sf):
        # A range on the column itself, so it reaches the scan.
        o = table(spark, sf, "orders")
        return o.filter((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey")

    @reg.add("p29_list_equality", """
        SELECT o_orderkey AS k, o_orderkey % 4 < 3 AS same, o_orderkey % 2 = 0 AS drift FROM orders""")
    def p29(spark, sf):
        k = F.col("o_orderkey") % 4
        a = F.when(k == 0, "[1, 2]").when(k == 1, " x ").when(k == 3, "[1,2]")
        b = F.when(k == 0, "[1,2]").when(k == 1, "x").when(k == 3, "[2,1]")
        path = F.when(F.col("o_orderkey") % 2 == 0, "a.b.as_of").otherwise("as_of.b")
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), governance.same_value(a, b).alias("same"), governance.leaf_in(path, ["as_of", "status_note"]).alias("drift"))

    @reg.add("p33_prefix_partition", """
        SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS community, CASE o_orderkey % 4 WHEN 0 THEN 'sub' || o_custkey % 9 WHEN 2 THEN 'named' ELSE NULL END AS sub FROM orders""")
    def p33(spark, sf):
        k = F.col("o_orderkey") % 4
        ident = F.when(k == 0, F.concat(F.lit("community-x-sub"), F.col("o_custkey") % 9)).when(k == 2, "community-x-").otherwise("news-1")
        own = F.nullif(F.regexp_extract(ident, r"^community-x-(.+)$", 1), F.lit(""))
        sub = F.when(F.startswith(ident, F.lit("community-")), F.coalesce(own, F.when(k == 2, F.lit("named")), F.lit("other")))
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.startswith(ident, F.lit("community-")).alias("community"), sub.alias("sub"))

    @reg.add("j25_unlabelled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
    def j25(spark, sf):
        return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")

    @reg.add("a27_text_fields", """
        SELECT 'text' AS name, count_if(length(text) > 25 AND contains(text, ' '))::BIGINT AS n FROM documents UNION ALL SELECT 'lang', count_if(length(lang) > 25 AND contains(lang, ' ')) FROM documents""")
    def a27(spark, sf):
        d = table(spark, sf, "documents")
        counts = d.agg(*[F.count_if((F.length(c) > 25) & F.contains(c, F.lit(" "))).alias(c) for c in ("text", "lang")])
        return counts.unpivot([], ["text", "lang"], "name", "n")

    @reg.add("a29_ordered_distinct", """
        SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1""")
    def a29(spark, sf):
        first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
        return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda e: e["event_type"]), ",").alias("kinds"))  # one entry a kind

    @reg.add("o8_head_limit", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
    def o8(spark, sf):
        return table(spark, sf, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(25).select("event_id")

    @reg.add("o10_matrix_modes", """
        WITH r AS (SELECT n_nationkey, n_name, sum(CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END)::BIGINT AS risk FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
        SELECT n_name, row_number() OVER (ORDER BY risk DESC, n_name)::BIGINT AS by_risk, row_number() OVER (ORDER BY n_name)::BIGINT AS by_name FROM r""")
    def o10(spark, sf):
        from ledgerloom.operators.ordered import numbered

        weight = F.when(F.col("c_mktsegment") == "HOUSEHOLD", 2).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0)
        r = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.sum(weight).alias("risk"))
        tagged = r.withColumn("shown", F.concat(F.lit("<b>"), "n_name", F.lit("</b>")))
        by_risk = numbered(tagged, [F.desc("risk"), "n_name"], "by_risk")
        return numbered(by_risk.withColumn("bare", text.strip_html(F.col("shown"))), ["bare"], "by_name").select("n_name", "by_risk", "by_name")

    @reg.add("o12_first_of_dates", """
        SELECT o_custkey, min(o_orderdate)::DATE::VARCHAR AS first, least(count(DISTINCT o_orderdate), 3)::INT AS shown FROM orders GROUP BY 1""")
    def o12(spark, sf):
        days = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("d")).distinct()
        few = days.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("d"))).filter("k <= 3")
        return few.groupBy("o_custkey").agg(F.min("d").alias("first"), F.count("*").cast("int").alias("shown"))

    @reg.add("o13_poster_rank", """
        SELECT event_id, row_number() OVER (ORDER BY (value > 30) DESC, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 9 END, event_id)::INT AS place FROM events ORDER BY place LIMIT 30""")
    def o13(spark, sf):
        order = [F.desc("affects"), ranking.rank_of("event_type", ["error", "purchase"], 9), F.col("event_id")]
        top = table(spark, sf, "events").select("event_id", "event_type", (F.col("value") > 30).alias("affects")).orderBy(*order).limit(30)
        return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("event_id", "place")  # 30 rows

    @reg.add("u4_label_union", """
        SELECT doc_id, concat_ws(',', CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN contains(text, '!!') THEN 'loud' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN coalesce(lang, '') <> 'en' AND NOT coalesce(contains(text, '!!') OR contains(text, '|'), false) THEN 'general' END) AS labels FROM documents""")
    def u4(spark, sf):
        has = lambda s: F.coalesce(F.contains("text", F.lit(s)), F.lit(False))
        found = lexicons.labels({"english": F.coalesce(F.col("lang") == "en", F.lit(False)), "loud": has("!!"), "table": has("|")}, "general")
        return table(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("labels"))

    @reg.add("u5_token_sets", """
        WITH t AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || p_brand || ' ' || split_part(p_name, ' ', 1)), ' ')) AS b FROM part)
        SELECT p_partkey, len(list_intersect(a, b))::INT AS both, len(list_distinct(a || b))::INT AS either FROM t""")
    def u5(spark, sf):
        a = F.array_distinct(F.split("p_name", " "))
        b = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand", F.substring_index("p_name", " ", 1))), " "))
        return table(spark, sf, "part").select("p_partkey", F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either"))

    @reg.add("q8_self_audit", """
        WITH c AS (SELECT count(*) AS n, count_if(o_orderpriority IS NULL OR o_orderpriority = '') AS blank, count_if(o_orderstatus = 'P') AS partial, count_if(o_orderstatus = 'P' AND o_totalprice < 1000) AS cheap, count_if(o_orderdate < TIMESTAMP '1990-01-01') AS old FROM orders)
        SELECT 'priority' AS section, n AS checked, blank AS bad, round(blank / n, 6) AS share, blank / n <= 0 AS ok FROM c
        UNION ALL SELECT 'cheap', partial, cheap, round(cheap / partial, 6), cheap / partial <= 0.05 FROM c
        UNION ALL SELECT 'partial', n, partial, round(partial / n, 6), partial / n <= 0.01 FROM c
        UNION ALL SELECT 'dates', n, old, round(old / n, 6), old / n <= 0 FROM c""")
    def q8(spark, sf):
        every, partial = F.lit(True), F.col("o_orderstatus") == "P"
        return governance.audit_sections(table(spark, sf, "orders"), {
            "priority": (every, F.coalesce(F.col("o_orderpriority"), F.lit("")) == "", 0.0),
            "cheap": (partial, F.col("o_totalprice") < 1000, 0.05),
            "partial": (every, partial, 0.01),
            "dates": (every, F.col("o_orderdate") < F.lit("1990-01-01").cast("timestamp_ntz"), 0.0),
        })

    @reg.add("x1_handlers", """
        SELECT event_type AS kind, count(*)::BIGINT AS n, CASE event_type WHEN 'error' THEN max(value) ELSE min(value) END AS observed FROM events GROUP BY 1""")
    def x1(spark, sf):
        make = lambda best: (lambda df: df.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), best("value").alias("observed")))
        return governance.handled(table(spark, sf, "events"), "event_type", {"error": make(F.max)} | {k: make(F.min) for k in ("click", "view", "purchase", "signup")})

    @reg.add("f43_century_pivot", """
        WITH t AS (SELECT o_orderkey AS k, o_orderdate AS d, o_orderkey % 2 = 0 OR day(o_orderdate) > 9 AS long, strftime(o_orderdate, '%y')::INT AS y FROM orders)
        SELECT k, CASE WHEN y >= 70 THEN '19' ELSE '20' END || strftime(d, '%y-%m-%d') AS pivoted, '20' || strftime(d, '%y-%m-%d') AS plain, CASE WHEN long THEN '20' || strftime(d, '%y-%m-%d') END AS two_digits,
          CASE WHEN long THEN CASE WHEN y >= 95 THEN '19' ELSE '20' END || strftime(d, '%y-%m-%d') END AS both FROM t""")
    def f43(spark, sf):
        o, k = table(spark, sf, "orders"), F.col("o_orderkey")
        token = F.upper(F.date_format("o_orderdate", "ddMMMyy"))
        token = F.when(k % 2 == 0, token).otherwise(F.regexp_replace(token, "^0", ""))
        kinds = {"pivoted": (70, True), "plain": (100, True), "two_digits": (100, False), "both": (95, False)}
        return o.select(k.alias("k"), *[dates.cutoff(token, *kind).alias(name) for name, kind in kinds.items()])

    @reg.add("f59_candidate_urls", """
        WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)
        SELECT strftime(m, '%Y-%m') AS month, lower(strftime(m + INTERVAL 1 MONTH, '%B')) || '-' || year(m + INTERVAL 1 MONTH) || '.pdf' AS next, lower(strftime(m, '%B')) || '-' || year(m) || '.pdf' AS this FROM m""")
    def f59(spark, sf):
        m = table(spark, sf, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).distinct()
        name = lambda d: F.concat(F.lower(F.date_format(d, "MMMM")), F.lit("-"), F.year(d), F.lit(".pdf"))
        return m.select(F.date_format("m", "yyyy-MM").alias("month"), name(F.add_months("m", 1)).alias("next"), name(F.col("m")).alias("this"))

    @reg.add("f92_mail_text", """
        SELECT p_partkey, 'Dear ' || p_name || chr(10) || 'See it' || chr(10) || 'Bye & thanks' AS body, 'http://x/' || p_partkey AS link FROM part""")
    def f92(spark, sf):
        html = F.concat(F.lit("<style>p{}</style><p>Dear  <b>"), "p_name", F.lit("</b></p><div>See <a class='c' href='http://x/"), "p_partkey", F.lit("'>it</a><br/><br></div>Bye &amp; thanks<script>x()</script>"))
        return table(spark, sf, "part").select("p_partkey", text.mail_text(html).alias("body"), F.get(text.links(html), F.lit(0)).alias("link"))

    @reg.add("f93_mail_header", """
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Zoë ' || p_name ELSE p_name || ' plain' END AS subject FROM part""")
    def f93(spark, sf):
        coded = F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(F.concat(F.lit("Zoë "), "p_name"), "utf-8")), F.lit("?="))
        header = F.when(F.col("p_partkey") % 2 == 0, coded).otherwise(F.concat("p_name", F.lit(" \n plain")))
        return table(spark, sf, "part").select("p_partkey", text.decoded_header(header).alias("subject"))

    @reg.add("x_sliding", """
        SELECT w AS start, count(*)::BIGINT AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1""")
    def x_sliding(spark, sf):
        e = table(spark, sf, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
        return e.groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")

    @reg.add("j14_queue_bands", """
        WITH c AS (SELECT o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '1994-01-01' THEN strftime(o_orderdate, '%Y-%m') END AS month, count(*) AS n FROM orders GROUP BY 1, 2),
        k AS (SELECT o_custkey, month, CASE WHEN n > 1 THEN n ELSE 0 END AS known, CASE WHEN n > 1 THEN 0 ELSE 1 END AS hidden FROM c), m(mark) AS (VALUES ('1995-06'), ('1997-01'))
        SELECT o_custkey, mark, coalesce(sum(known) FILTER (month IS NULL OR month < mark), 0)::BIGINT AS known, coalesce(sum(hidden) FILTER (month IS NULL OR month < mark), 0)::BIGINT AS suppressed, coalesce(sum(known) FILTER (month = mark), 0)::BIGINT AS in_month,
          coalesce(sum(known) FILTER (month > mark), 0)::BIGINT AS later, coalesce(sum(known) FILTER (left(month, 4) = left(mark, 4)), 0)::BIGINT AS in_year, coalesce(mark > max(month), true) AS past_window FROM k CROSS JOIN m GROUP BY 1, 2""")
    def j14(spark, sf):
        month = F.when(F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp_ntz"), F.date_format("o_orderdate", "yyyy-MM"))
        cells = table(spark, sf, "orders").groupBy("o_custkey", month.alias("month")).agg(F.count("*").alias("n"))
        cells = cells.select("o_custkey", "month", F.when(F.col("n") > 1, F.col("n")).alias("known"), F.when(F.col("n") == 1, 1).alias("hidden"))
        return joins.queue_bands(cells, "o_custkey", "month", "known", "hidden", ["1995-06", "1997-01"])

    # The score of a search entry, term by term as its rule lists them, over three fields made of parts.
    fields = "lower(p_name) AS t, lower(p_type || ' ' || p_brand) AS s, lower(p_name || '-' || p_size) AS b, p_size % 2 = 0 AS q"
    flat = lambda c: f"regexp_replace({c}, '[^a-z0-9]+', '', 'g')"
    terms = ("ring", "brand1", "g1")
    plain = lambda w: f"(CASE WHEN strpos(t, '{w}') = 1 THEN 26 WHEN strpos(t, '{w}') > 1 THEN 18 ELSE 0 END + CASE WHEN contains(s, '{w}') THEN 6 ELSE 0 END)"
    folded = lambda w: f"CASE WHEN strpos({flat('t')}, '{w}') = 1 THEN 22 WHEN strpos({flat('t')}, '{w}') > 1 THEN 16 WHEN contains({flat('s')}, '{w}') THEN 5 ELSE 0 END"
    none = lambda w: f"({plain(w)} = 0 AND NOT contains(b, '{w}'))"
    late = lambda w: f"({none(w)} AND {folded(w)} = 0 AND contains({flat('b')}, '{w}'))"
    points = " + ".join(f"CASE WHEN {none(w)} THEN {folded(w)} ELSE {plain(w)} END" for w in terms)
    body = " + ".join(f"CASE WHEN contains(b, '{w}') THEN 4 WHEN {late(w)} THEN 3 ELSE 0 END" for w in terms)
    hits = " + ".join(f"({plain(w)} > 0 OR contains(b, '{w}') OR {folded(w)} > 0 OR {late(w)})::INT" for w in terms)

    @reg.add("f20_relevance_arms", f"""
        WITH f AS (SELECT p_partkey, {fields} FROM part), h AS (SELECT p_partkey, q, {points} AS points, least(12, {body}) AS body, {hits} AS hits FROM f)
        SELECT p_partkey, CASE WHEN hits = 0 THEN 0 ELSE points + body + round(22.0 * hits / 3)::INT + CASE WHEN q THEN 5 ELSE 0 END END::INT AS score FROM h""")
    def f20(spark, sf):
        p = table(spark, sf, "part")
        score = text.relevance(list(terms), F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand"), F.concat_ws("-", "p_name", "p_size"), F.col("p_size") % 2 == 0)
        return p.select("p_partkey", score.alias("score"))
