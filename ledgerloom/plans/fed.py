"""Queries over feeds, mail, laid-out tables and guarded changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.operators import feeds, governance, grids, series
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table

# Lexicons over the names of parts, which stand in for headlines.
RULES = feeds.Rules(
    categories={"ring": r"(?i)\bring\b", "bolt": r"(?i)\bbolt\b"}, generic=r"(?i)\bwidget\b", topics=[("colour", ["red", "blue"]), ("size", ["small", "large"])], high=["large"], medium=["red", "blue"],
    facts=r"(?i)\bred\b", phrase=r"(?i)\bgreen\b", context=r"(?i)\bgear\b", fine=[("red-thing", r"(?i)\bred\b"), ("small-thing", r"(?i)\bsmall\b")],
)
AS_OF = "2024-03-01"
SENDERS = [("gov.example", "official-mail", 1), ("law.example", "law-mail", 2)]

# Entries made of parts and what the rules say of each, in SQL.
ENTRIES = """
e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 37 = 0 THEN '' ELSE p_name END AS title, ' ' || p_name || ' ' AS w, CASE WHEN p_partkey % 11 <> 0 THEN DATE '2024-03-01' - (p_size - 3)::INT END AS published, CASE p_partkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source, p_partkey % 3 + 1 AS tier FROM part),
c AS (SELECT *, contains(w, ' ring ') AS ring, contains(w, ' bolt ') AS bolt, contains(w, ' widget ') AS widget, contains(w, ' green ') AND contains(w, ' gear ') AS pair FROM e),
g AS (SELECT *, CASE WHEN title = '' THEN NULL WHEN ring AND NOT bolt THEN 'ring' WHEN bolt AND NOT ring THEN 'bolt' WHEN ring OR bolt OR widget OR pair THEN 'cross-cutting' END AS category,
  CASE WHEN contains(title, 'red') OR contains(title, 'blue') THEN 'colour' WHEN contains(title, 'small') OR contains(title, 'large') THEN 'size' ELSE 'policy' END AS topic,
  CASE WHEN contains(title, 'large') THEN 'high' WHEN contains(title, 'red') OR contains(title, 'blue') THEN 'medium' ELSE 'low' END AS importance,
  CASE WHEN published IS NULL THEN 'no_date' WHEN DATE '2024-03-01' - published > 30 THEN 'stale' WHEN published > DATE '2024-03-01' THEN 'future' END AS late FROM c),
d AS (SELECT *, CASE WHEN title = '' THEN 'no_title' WHEN category IS NULL THEN 'scope' ELSE late END AS dropped, coalesce(tier = 1 AND category IS NOT NULL AND contains(w, ' red '), false) AS affects FROM g)"""


def entries(spark, sf):
    k = F.col("p_partkey")
    published = F.when(k % 11 != 0, F.date_sub(F.lit(AS_OF).cast("date"), F.col("p_size") - 3))
    source = F.when(k % 3 == 0, "alpha").when(k % 3 == 1, "beta").otherwise("gamma")
    publisher = F.when(k % 5 == 0, "The Post")
    return table(spark, sf, "part").select(k.alias("at"), F.when(k % 37 == 0, "").otherwise(F.col("p_name")).alias("title"), F.concat(F.lit("http://x/"), k).alias("url"), published.alias("published"), source.alias("source_id"), publisher.alias("publisher"), (k % 3 + 1).cast("int").alias("tier"))


def register(reg: Registry) -> None:
    @reg.add("s31_feed_items", f"""
        WITH {ENTRIES} SELECT 'http://x/' || k AS url, source AS feed, dropped, CASE WHEN k % 5 = 0 THEN 'The Post' ELSE source END AS source_id, category, topic, importance, affects AS affects_facts, ['high', 'medium', 'low'][tier] AS confidence FROM d""")
    def s31(spark, sf):
        return feeds.feed_items(entries(spark, sf), RULES, AS_OF, 30).select("url", "feed", "dropped", "source_id", "category", "topic", "importance", "affects_facts", "confidence")

    @reg.add("a33_run_counters", f"""
        WITH {ENTRIES} SELECT source AS feed, count(*)::BIGINT AS fetched, count_if(dropped IS NULL)::BIGINT AS kept, count_if(dropped = 'no_title')::BIGINT AS no_title, count_if(dropped = 'scope')::BIGINT AS scope, 0::BIGINT AS relevance,
          count_if(dropped = 'no_date')::BIGINT AS no_date, count_if(dropped = 'stale')::BIGINT AS stale, count_if(dropped = 'future')::BIGINT AS future, 0::BIGINT AS seen, 0::BIGINT AS unknown_sender, 0::BIGINT AS out_of_scope FROM d GROUP BY 1""")
    def a33(spark, sf):
        return feeds.run_counters(feeds.feed_items(entries(spark, sf), RULES, AS_OF, 30))

    @reg.add("s32_community_items", f"""
        WITH {ENTRIES}, q AS (SELECT *, source = 'beta' AS strict, CASE source WHEN 'gamma' THEN ['base'] ELSE [] END AS base, category IS NOT NULL OR contains(w, ' gear ') AS loose, contains(w, ' red ') OR contains(w, ' ring ') AS token FROM g WHERE source <> 'alpha'),
        r AS (SELECT *, CASE WHEN title = '' THEN 'no_title' WHEN NOT (loose AND (NOT strict OR token)) THEN 'relevance' ELSE late END AS gate FROM q),
        s AS (SELECT *, row_number() OVER (PARTITION BY source, title, published, gate IS NULL ORDER BY k) AS n FROM r)
        SELECT 'http://x/' || k AS url, coalesce(gate, CASE WHEN n > 1 THEN 'seen' END) AS dropped, 'community-' || source AS source_id, coalesce(category, 'cross-cutting') AS category, 3 AS tier, false AS affects_facts,
          array_to_string(CASE WHEN len(base) = 0 AND f IS NULL THEN ['general'] WHEN f IS NULL THEN base ELSE base || [f] END, ',') AS labels
        FROM (SELECT *, CASE WHEN title = '' THEN NULL WHEN contains(w, ' red ') THEN 'red-thing' WHEN contains(w, ' small ') THEN 'small-thing' END AS f FROM s)""")
    def s32(spark, sf):
        registry = spark.createDataFrame([("beta", True, []), ("gamma", False, ["base"])], "source_id string, strict boolean, defaults array<string>")
        found = feeds.community_items(entries(spark, sf), registry, RULES, r"(?i)\bgear\b", r"(?i)\b(red|ring)\b", AS_OF, 30)
        return found.select("url", "dropped", "source_id", "category", "tier", "affects_facts", F.array_join("labels", ",").alias("labels"))

    @reg.add("p12_relevance", f"""
        WITH {ENTRIES} SELECT k, category IS NOT NULL OR contains(' ' || title || ' ', ' gear ') AS permissive, (category IS NOT NULL OR contains(' ' || title || ' ', ' gear ')) AND contains(' ' || title || ' ', ' red ') AS strict FROM g""")
    def p12(spark, sf):
        keep = lambda strict: feeds.relevant(F.col("title"), RULES, r"(?i)\bgear\b", r"(?i)\bred\b", F.lit(strict))
        return entries(spark, sf).select(F.col("at").alias("k"), keep(False).alias("permissive"), keep(True).alias("strict"))

    @reg.add("p13_contextual_phrase", f"WITH {ENTRIES} SELECT k, pair AND title <> '' AS together FROM c")
    def p13(spark, sf):
        return entries(spark, sf).select(F.col("at").alias("k"), feeds.together(F.col("title"), RULES.phrase, RULES.context).alias("together"))

    @reg.add("p30_item_ids", f"""
        WITH {ENTRIES} SELECT k, left(sha1(CASE WHEN k % 5 = 0 THEN 'The Post' ELSE source END || '|' || title || '|' || coalesce(published::VARCHAR, '')), 16) AS id FROM e""")
    def p30(spark, sf):
        return feeds.feed_items(entries(spark, sf), RULES, AS_OF).select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("k"), "id")

    @reg.add("p32_mail_funnel", f"""
        WITH {ENTRIES}, m AS (SELECT *, CASE k % 4 WHEN 3 THEN 'unknown' WHEN 2 THEN 'official' WHEN 1 THEN 'law-mail' ELSE 'official-mail' END AS source_id, CASE k % 4 WHEN 1 THEN 2 ELSE 1 END AS t FROM g)
        SELECT k AS message_id, source_id AS feed, CASE WHEN k % 4 = 3 THEN 'unknown-sender' WHEN category IS NULL THEN 'out-of-scope' END AS dropped, CASE WHEN k % 4 = 3 THEN NULL ELSE t END AS tier, CASE WHEN title = '' THEN '(no subject)' ELSE title END AS headline,
          'One here. Two there!' AS summary, CASE WHEN k % 2 = 0 THEN 'http://x/' || k ELSE '' END AS url FROM m""")
    def p32(spark, sf):
        e = entries(spark, sf)
        k = F.col("at") % 4
        header = F.when(k == 0, "News <a@GOV.example>").when(k == 1, "b@law.example").when(k == 2, "c@ally.example").otherwise("d@spam.example")
        links = F.when(F.col("at") % 2 == 0, F.array(F.lit("http://x/unsubscribe"), F.col("url"))).otherwise(F.array().cast("array<string>"))
        messages = e.select(F.col("at").alias("message_id"), header.alias("sender"), F.col("title").alias("subject"), "published", F.lit(" One here.  Two there! Three. ").alias("body"), links.alias("links"))
        found = feeds.mail_items(messages, RULES, SENDERS, ["gov.example", "law.example", "ally.example"])
        return found.select("message_id", "feed", "dropped", F.when(F.col("dropped").eqNullSafe("unknown-sender"), F.lit(None)).otherwise(F.col("tier")).alias("tier"), "headline", "summary", "url")

    @reg.add("d22_fact_findings", f"""
        WITH {ENTRIES} SELECT CASE topic WHEN 'colour' THEN 'paint.cells' WHEN 'size' THEN 'size.cells' ELSE 'other' END AS path, 'low' AS confidence, count(*)::BIGINT AS n FROM d WHERE dropped IS NULL AND affects GROUP BY 1""")
    def d22(spark, sf):
        items = feeds.feed_items(entries(spark, sf), RULES, AS_OF, 30)
        return feeds.fact_findings(items, [("colour", "paint.cells"), ("size", "size.cells")], "fees", "other").groupBy("path", "confidence").agg(F.count("*").alias("n"))

    @reg.add("d16_fine_topic", f"""
        WITH {ENTRIES} SELECT k, CASE WHEN contains(' ' || title || ' ', ' red ') THEN 'red-thing' WHEN contains(' ' || title || ' ', ' small ') THEN 'small-thing' END AS fine FROM e""")
    def d16(spark, sf):
        return entries(spark, sf).select(F.col("at").alias("k"), feeds.fine_topic(F.col("title"), RULES).alias("fine"))

    @reg.add("w9_representative", f"""
        WITH {ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY tier, (k % 2 = 0) DESC, published DESC NULLS LAST, k) AS n, count(*) OVER (PARTITION BY title) - 1 AS others FROM e)
        SELECT title, k AS id, others FROM r WHERE n = 1""")
    def w9(spark, sf):
        e = entries(spark, sf).withColumn("id", F.col("at"))
        return feeds.representative(e, "title", F.col("at") % 2 == 0).select("title", "id", "others")

    @reg.add("p24_table_rows", """
        WITH g AS (SELECT p_partkey AS k, unnest([{'c': 'EB-1', 'x': 'all', 't': 'C'}, {'c': 'EB-1', 'x': 'china', 't': '01JAN20'}, {'c': 'EB-1', 'x': 'india', 't': 'U'}]) AS r FROM part)
        SELECT k AS p_partkey, r.c AS category, r.x AS "column", r.t AS token, NULL AS problem FROM g
        UNION ALL SELECT p_partkey, 'EB-2', CASE WHEN p_partkey % 2 = 0 THEN x END, CASE WHEN p_partkey % 2 = 0 THEN '02FEB21' END, CASE WHEN p_partkey % 2 = 1 THEN '2 tokens for 3 columns' END FROM part, (VALUES ('all'), ('china'), ('india')) AS t(x) WHERE p_partkey % 2 = 0 OR x = 'all'""")
    def p24(spark, sf):
        head = "x\nFINAL ACTION DATES FOR EMPLOYMENT\nnote\nEmploy-   All Other         CHINA-    INDIA\nment      Areas             born\n"
        second = F.when(F.col("p_partkey") % 2 == 0, "2nd    02FEB21    02FEB21   02FEB21").otherwise("2nd    02FEB21    15UL24   02FEB21")
        page = F.concat(F.lit(head + "1st        C               01JAN20    U\n"), second, F.lit("\nOther Workers  C C C\n1st   U  U  U\nDATES FOR FILING OF EMPLOYMENT\n1st  C C C\n"))
        pages = table(spark, sf, "part").select("p_partkey", page.alias("page"))
        part = grids.section(F.col("page"), "FINAL ACTION DATES FOR EMPLOYMENT", "DATES FOR FILING OF EMPLOYMENT")
        token = r"(?<![A-Za-z0-9])(\d{1,2}[A-Z]{3}\d{2}|C|U)(?![A-Za-z0-9])"
        return grids.table_rows(pages, "p_partkey", part, [("india", "INDIA"), ("china", "CHINA"), ("all", "All")], {"1st": "EB-1", "2nd": "EB-2"}, token)

    @reg.add("p28_row_category", """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'EB-1' WHEN 1 THEN 'EB-5' ELSE NULL END AS category, CASE WHEN p_partkey % 2 = 0 THEN 'India' END AS column_name FROM part""")
    def p28(spark, sf):
        k = F.col("p_partkey") % 4
        label = F.when(k == 0, "1st class").when(k == 1, "5th Unreserved pool").when(k == 2, "5th Set Aside").otherwise("Other 1st")
        kind = grids.row_category(label, [("EB-1", r"^1st\b"), ("EB-5", r"^5th\s+unreserved"), ("EB-5", r"^5th\s*$")])
        return table(spark, sf, "part").select("p_partkey", kind.alias("category"), grids.canonical(F.when(k % 2 == 0, " INDIA ").otherwise("Mars"), {"india": "India"}).alias("column_name"))

    @reg.add("p27_row_lookup", """
        SELECT l_orderkey AS k, first(l_quantity ORDER BY l_linenumber, l_quantity) FILTER (l_linenumber = 2)::VARCHAR AS second, CASE WHEN count_if(l_linenumber = 2) = 0 THEN 'second: no row with ''line 2''' ELSE '' END AS notes FROM lineitem GROUP BY 1""")
    def p27(spark, sf):
        row = F.struct("l_linenumber", "l_quantity", F.concat(F.lit("LINE "), "l_linenumber").alias("label"), F.col("l_quantity").cast("string").alias("value"))
        rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(row)).alias("rows"))  # an order's lines
        found = rows.withColumn("f", grids.row_lookup(F.col("rows"), {"second": "line 2"}))
        return found.select("k", F.col("f.values")["second"].alias("second"), F.array_join("f.notes", ";").alias("notes"))

    @reg.add("u10_unpivot_cells", """
        SELECT o_custkey, o_orderstatus || '.' || left(o_orderpriority, 1) AS path, count(*)::VARCHAR AS found FROM orders GROUP BY 1, 2""")
    def u10(spark, sf):
        n = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.count("*").cast("string").alias("n"))
        inner = n.groupBy("o_custkey", "o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("m"))  # five priorities at most
        grid = inner.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "m"))).alias("grid"))  # three states
        return grids.findings(grid, "o_custkey", "grid")

    @reg.add("q2_quarter_audit", """
        WITH q AS (SELECT DISTINCT 'FY' || year(d) || 'Q' || quarter(d) AS quarter, year(d) * 4 + quarter(d) AS i FROM (SELECT o_orderdate + INTERVAL 3 MONTH AS d FROM orders))
        SELECT 'gap' AS rule, quarter AS detail FROM q WHERE i % 5 = 0 AND i > (SELECT min(i) FROM q WHERE i % 5 <> 0) AND i < (SELECT max(i) FROM q WHERE i % 5 <> 0)
        UNION ALL SELECT 'duplicate', quarter FROM q WHERE i % 5 = 1 UNION ALL SELECT 'type', quarter || ': denied' FROM q WHERE i % 5 = 2 UNION ALL SELECT 'type', quarter || ': certified' FROM q WHERE i % 5 = 3""")
    def q2(spark, sf):
        later = F.add_months("o_orderdate", 3)
        q = table(spark, sf, "orders").select(dates.fiscal_quarter(F.col("o_orderdate")).alias("quarter"), (F.year(later) * 4 + F.quarter(later)).alias("i")).distinct().filter("i % 5 <> 0")
        # Every fifth quarter is left out, so that there are gaps to find.
        records = q.select("quarter", F.when(F.col("i") % 5 == 3, "many").otherwise("12").alias("certified"), F.when(F.col("i") % 5 != 2, "0").alias("denied"), F.explode(F.when(F.col("i") % 5 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"))
        return governance.quarter_audit(records, "quarter", ["certified", "denied"])

    @reg.add("q12_staleness", """
        SELECT o_custkey, greatest(0, 1999 * 4 + 1 - (year(d) * 4 + quarter(d)))::INT AS behind FROM (SELECT o_custkey, max(o_orderdate) + INTERVAL 3 MONTH AS d FROM orders GROUP BY 1)""")
    def q12(spark, sf):
        last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("d"))
        return last.select("o_custkey", governance.staleness(dates.fiscal_quarter(F.col("d")), F.lit("FY1999Q1")).alias("behind"))

    @reg.add("q10_health_notes", """
        SELECT o_custkey, f IS NOT NULL OR p IS NOT NULL AS parse_ok, concat_ws(';', CASE WHEN f IS NULL THEN 'filled is null' END, CASE WHEN p IS NULL THEN 'partial is null' END) AS notes
        FROM (SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus = 'F' AND o_orderkey % 8 = 0) AS f, max(o_orderkey) FILTER (o_orderstatus = 'P' AND o_orderkey % 8 = 1) AS p FROM orders GROUP BY 1)""")
    def q10(spark, sf):
        latest = lambda s, r: F.max(F.when((F.col("o_orderstatus") == s) & (F.col("o_orderkey") % 8 == r), F.col("o_orderkey")))
        per = table(spark, sf, "orders").groupBy("o_custkey").agg(latest("F", 0).alias("f"), latest("P", 1).alias("p"))
        return per.withColumn("h", governance.health({"filled": F.col("f"), "partial": F.col("p")})).select("o_custkey", "h.parse_ok", F.array_join("h.notes", ";").alias("notes"))

    @reg.add("p25_flat_variables", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer")
    def p25(spark, sf):
        c = table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
        return governance.flat_variables(governance.forbid(c.drop("c_name"), ["C_NAME"]), {"id": "c_custkey", "segment": "c_mktsegment"})

    @reg.add("j7_quorum_changes", """
        WITH n AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS states, max(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY 1),
        q AS (SELECT 'cell.' || o_custkey AS path, CASE WHEN s <> 'P' THEN s END AS value FROM n WHERE states = 1),
        s AS (SELECT 'cell.' || c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN 'F' END AS value FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')
        SELECT q.path, s.value AS old, q.value AS new, s.path IS NOT NULL AS existed FROM q LEFT JOIN s USING (path) WHERE s.path IS NULL OR s.value IS DISTINCT FROM q.value""")
    def j7(spark, sf):
        n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("states"), F.max("o_orderstatus").alias("s"))
        path = lambda c: F.concat(F.lit("cell."), c).alias("path")
        quorum = n.select(path("o_custkey"), F.when(F.col("s") != "P", F.col("s")).alias("value"), F.when(F.col("states") == 1, "high").otherwise("low").alias("confidence"))
        store = table(spark, sf, "customer").filter("c_mktsegment <> 'HOUSEHOLD'").select(path("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "F").alias("value"))
        return governance.quorum_changes(quorum, store)

    @reg.add("a22_tallies", """
        SELECT count_if(o_orderstatus = 'F')::BIGINT AS "F", count_if(o_orderstatus = 'O')::BIGINT AS "O", count_if(o_orderstatus NOT IN ('F', 'O'))::BIGINT AS other FROM orders""")
    def a22(spark, sf):
        return governance.tallies(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"])

    @reg.add("f81_fenced_json", """
        SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_partkey END AS changes FROM part""")
    def f81(spark, sf):
        k = F.col("p_partkey")
        good = F.concat(F.lit('```json\n{"changes": '), k, F.lit("}\n```"))
        said = F.when(k % 3 == 0, F.concat(F.lit('Text\n```json\n{"other": 1}\n```\n```json\n{broken\n```\n'), good, F.lit('\n```json\n{"changes": -1}\n```'))).when(k % 3 == 1, good).otherwise(F.lit('{"changes": 5}'))
        block = governance.fenced_json(said, "changes")
        return table(spark, sf, "part").select("p_partkey", F.get_json_object(block, "$.changes").cast("long").alias("changes"))

    @reg.add("q5_guarded_apply", """
        SELECT 'cat.' || c_custkey || '.date' AS path, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS value FROM customer UNION ALL SELECT 'cat.' || c_custkey || '.verified', CASE WHEN c_custkey % 4 = 0 THEN 'true' ELSE 'false' END FROM customer
        UNION ALL SELECT 'cat.' || c_custkey || '.note', 'added' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT * FROM (VALUES ('meta.version', '0.2.8'), ('meta.last_verified', '2024-03-01'), ('kept.a', '1'), ('kept.b.c', '2'))""")
    def q5(spark, sf):
        n, at = table(spark, sf, "customer"), F.concat(F.lit("cat."), "c_custkey")
        leaf = lambda name: F.concat(at, F.lit(f".{name}")).alias("path")
        meta = spark.createDataFrame([("meta.version", "0.2.7"), ("meta.last_verified", "2024-01-01"), ("kept.a", "1"), ("kept.b.c", "2")], "path string, value string")
        store = n.select(leaf("date"), F.col("c_name").alias("value")).unionByName(n.select(leaf("verified"), F.lit("false").alias("value"))).unionByName(meta)
        even, flip = n.filter("c_custkey % 2 = 0"), (F.col("c_custkey") % 4 == 0).alias("flip")
        changes = even.select(leaf("date"), F.lit("new").alias("value"), flip).unionByName(even.select(leaf("note"), F.lit("added").alias("value"), F.lit(False).alias("flip")))
        return governance.guarded_apply(store, changes, AS_OF, ["kept"])

    @reg.add("p19_paths", """
        SELECT event_id, path, value FROM (SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'a.b', NULL FROM events) WHERE value IS NOT NULL""")
    def p19(spark, sf):
        return governance.leaves(table(spark, sf, "events"), "event_id", "props", ["k", "a.b"])

    @reg.add("q11_append_once", """
        SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
    def q11(spark, sf):
        months = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
        return governance.append_once(months.filter("month < '1998-01'"), months.filter("month >= '1997-06'").withColumn("n", F.when(F.col("month") < "1998-01", -1).otherwise(F.col("n"))), "month")

    @reg.add("t10_page_age", """
        SELECT o_custkey, CASE WHEN d IS NULL OR DATE '1998-12-01' - d > 90 THEN 'ACTION' ELSE 'OK' END AS severity FROM (SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'F')::DATE AS d FROM orders GROUP BY 1)""")
    def t10(spark, sf):
        last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))).alias("d"))
        return last.select("o_custkey", governance.page_age(F.col("d"), "1998-12-01", 90).alias("severity"))

    @reg.add("a34_state_matrix", """
        WITH m AS (SELECT o_orderpriority AS p, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1, 2), d AS (SELECT p, y, CASE WHEN lag(n) OVER w IS NULL THEN 'first' WHEN n > lag(n) OVER w THEN 'advance' WHEN n < lag(n) OVER w THEN 'retro' ELSE 'stall' END AS s FROM m WINDOW w AS (PARTITION BY p ORDER BY y))
        SELECT p, max(s) FILTER (y = 1994) AS "1994", max(s) FILTER (y = 1995) AS "1995", max(s) FILTER (y = 1996) AS "1996" FROM d GROUP BY 1""")
    def a34(spark, sf):
        m = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
        before = F.lag("n").over(Window.partitionBy("p").orderBy("y"))
        state = F.when(before.isNull(), "first").when(F.col("n") > before, "advance").when(F.col("n") < before, "retro").otherwise("stall")
        return series.matrix(m.withColumn("s", state), "p", "y", "s", [1994, 1995, 1996])

    @reg.add("w17_line_segments", """
        WITH k AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'current' WHEN o_orderkey % 7 = 0 THEN 'gap' ELSE 'dated' END AS kind FROM orders),
        b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - row_number() OVER (PARTITION BY o_custkey, kind ORDER BY o_orderkey) AS run FROM k)
        SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*)::BIGINT AS n, CASE WHEN kind = 'current' THEN 'marker' WHEN count(*) > 1 THEN 'segment' ELSE 'point' END AS shape FROM b WHERE kind = 'dated' GROUP BY o_custkey, kind, run
        UNION ALL SELECT o_custkey, o_orderkey, o_orderkey, 1, 'marker' FROM k WHERE kind = 'current'""")
    def w17(spark, sf):
        value = F.when(F.col("o_orderstatus") == "P", "CURRENT").when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate").cast("string"))
        return series.segments(table(spark, sf, "orders").select("o_custkey", "o_orderkey", value.alias("v")), "o_custkey", "o_orderkey", "v")

    @reg.add("f98_chart_kind", """
        SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'dated' WHEN 1 THEN 'current' ELSE 'gap' END AS kind, CASE o_orderkey % 4 WHEN 2 THEN 'unavailable' WHEN 3 THEN 'none' END AS reason FROM orders""")
    def f98(spark, sf):
        k = F.col("o_orderkey") % 4
        value = F.when(k == 0, F.to_date("o_orderdate").cast("string")).when(k == 1, "CURRENT").when(k == 2, "U")
        return table(spark, sf, "orders").withColumn("c", series.chart_kind(value)).select(F.col("o_orderkey").alias("k"), "c.kind", "c.reason")

    @reg.add("f74_scenarios", """
        SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'nodata' WHEN 1 THEN 'nopd' WHEN 2 THEN 'current' WHEN 3 THEN 'unavailable' ELSE CASE WHEN o_orderdate::DATE - DATE '1996-01-01' <= 14 THEN 'current' ELSE 'project' END END AS status FROM orders""")
    def f74(spark, sf):
        k = F.col("o_orderkey") % 5
        cutoff = F.when(k == 2, "CURRENT").when(k > 3, "1996-01-01").when(k == 1, "1996-01-01")
        status = series.scenario(k != 0, F.when(k != 1, F.to_date("o_orderdate")), cutoff)
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), status.alias("status"))

    @reg.add("f73_range_mode", """
        WITH g AS (SELECT o_orderkey AS k, (o_orderkey % 50)::DOUBLE AS lo, (o_orderkey % 50 + o_custkey % 20)::DOUBLE AS typ, (o_orderkey % 50 + o_custkey % 20 + o_orderkey % 13)::DOUBLE AS hi FROM orders)
        SELECT k, CASE WHEN hi <= 30 THEN 'bounded' WHEN typ <= 30 THEN 'partial' WHEN lo <= 30 THEN 'beyond-with-floor' ELSE 'beyond' END AS mode FROM g""")
    def f73(spark, sf):
        from ledgerloom.functions.projection import range_mode

        low = F.col("o_orderkey") % 50
        typical = low + F.col("o_custkey") % 20
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), range_mode(low, typical, typical + F.col("o_orderkey") % 13, F.lit(30)).alias("mode"))
