"""Queries over text, rules and governance (P*, F*, D*, Q*, search)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, lexicons, text
from ledgerloom.operators import governance, joins, mining, vocabulary
from ledgerloom.operators.clauses import ClauseWords, clause_place, clauses
from ledgerloom.plans.registry import Registry
from ledgerloom.session import held, table

# Lexicons of the test corpus.
NOTICES = [("apache", "Apache License"), ("gpl", "General Public License"), ("mit", "MIT License"), ("cc", "CC BY"), ("rights", "rights reserved")]
STOP = tuple("the a an of to in on for and or but with at by from as is are was were be been being it its this that these those".split())
# Words that pin a story, and words that many stories share; a link needs two of both, one of which pins.
STORY_RARE = ("100000", "9-11", "l-1", "l1", "lottery", "litigation", "lawsuit", "proclamation", "injunction", "retrogression", "apache", "gpl", "scum")
STORY_DISTINCTIVE = ("fee", "fees", "h-1b", "h1b", "renewal", "premium", "processing", "cap", "wage", "license", "licensed", "rights", "reserved", "commons", "mit")


def _case(patterns, tail):
    parts = []
    for label, p in patterns:
        if tail:
            parts.append(f"WHEN contains(right(text, {tail}), '{p}') THEN '{label}'")
        parts.append(f"WHEN contains(text, '{p}') THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


# The words of clauses in the planted texts.
WORDS = ClauseWords(
    adverbs=("hereby", "therefore", "now"), negators=("do not", "decline to", "will not"), doubts=("without merit", "nothing in", "no basis"),
    partial=("part", "portion", "finding"), full=("petition", "appeal", "decision"), determiners=("the", "this", "an"), standards=("petitions such as",),
)
# Three clauses in front of each document, by its number, among sentences that are none; the same in both languages.
VERBS = ("order", "vacate", "affirm", "modify", "reverse", "remand", "dismiss")
PLANTED = f"""
c AS (SELECT doc_id, source, text, unnest([0, 1, 2]) AS j FROM documents),
p AS (SELECT doc_id, j, length(text) AS own, {list(VERBS)}[(doc_id + 3 * j) % 7 + 1] AS verb, 'object ' || ((doc_id * (j + 1)) % 23) || [' portion', ' appeal', ' matter'][(doc_id + j) % 3 + 1] AS object, (doc_id + j) % 2 = 0 AS caps, (doc_id * 3 + j) % 5 = 0 AS negated,
  ['partial', 'full', 'unknown'][(doc_id + j) % 3 + 1] AS scope, ['', 'hereby ', 'therefore now '][(doc_id // 2 + j) % 3 + 1] AS adverbs, ['Awe orders all.', 'We, order it.', 'Owe no thing. We.'][(doc_id + 2 * j) % 3 + 1] AS other FROM c),
said AS (SELECT *, other || ' We ' || adverbs || CASE WHEN negated THEN 'do not ' ELSE '' END || CASE WHEN caps THEN upper(verb) ELSE verb END || ' the ' || object || '. ' AS sentence FROM p),
f AS (SELECT doc_id, verb, object, caps, negated, scope, (coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(other) + 1)::INT AS begin,
  (coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(other) + 1)::DOUBLE / (own + sum(length(sentence)) OVER (PARTITION BY doc_id)) AS place FROM said),
d AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN 'REMAND ORDER' ELSE 'FINAL ORDER' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'denied' ELSE 'granted' END AS petition FROM documents)"""


def planted(spark, sf):
    k = F.col("doc_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))

    def sentence(j):
        verb = pick(VERBS, (k + 3 * j) % 7)
        thing = F.concat(F.lit("object "), (k * (j + 1)) % 23, pick([" portion", " appeal", " matter"], (k + j) % 3))
        other, adverbs = pick(["Awe orders all.", "We, order it.", "Owe no thing. We."], (k + 2 * j) % 3), pick(["", "hereby ", "therefore now "], (F.floor(k / 2) + j) % 3)
        return F.concat(other, F.lit(" We "), adverbs, F.when((k * 3 + j) % 5 == 0, "do not ").otherwise(""), F.when((k + j) % 2 == 0, F.upper(verb)).otherwise(verb), F.lit(" the "), thing, F.lit(". "))

    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "source", F.concat(*[sentence(j) for j in range(3)], "text").alias("text"))


def register(reg: Registry) -> None:
    @reg.add("p1_first_match_label", f"SELECT doc_id, {_case(NOTICES, 4000)} AS label FROM documents")
    def p1(spark, sf):
        found = lexicons.first_match(F.col("text"), NOTICES, 4000)
        return table(spark, sf, "documents").select("doc_id", found["label"].alias("label"))

    @reg.add("p2_doc_class_default", """
        SELECT doc_id, CASE WHEN regexp_matches(source || ' ' || left(text, 3000), '^src1[0-9]? ') THEN 'first' WHEN contains(source || ' ' || left(text, 3000), '!!') THEN 'shout' ELSE 'merits' END AS class FROM documents""")
    def p2(spark, sf):
        head = F.concat_ws(" ", "source", F.substring("text", 1, 3000))
        return table(spark, sf, "documents").select("doc_id", F.when(head.rlike("^src1[0-9]? "), "first").when(F.contains(head, F.lit("!!")), "shout").otherwise("merits").alias("class"))

    @reg.add("p3_multi_flag_priority", """
        WITH f AS (SELECT conv_id, bool_or(role = 'system') AS s, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a FROM conversations GROUP BY 1)
        SELECT conv_id, CASE WHEN s AND u AND a THEN 'cross' WHEN u AND a THEN 'both' WHEN a THEN 'assistant' WHEN u THEN 'user' ELSE '' END AS party FROM f""")
    def p3(spark, sf):
        has = lambda r: F.bool_or(F.col("role") == r)
        f = table(spark, sf, "conversations").groupBy("conv_id").agg(has("system").alias("s"), has("user").alias("u"), has("assistant").alias("a"))
        return f.select("conv_id", F.when(F.col("s") & F.col("u") & F.col("a"), "cross").when(F.col("u") & F.col("a"), "both").when(F.col("a"), "assistant").when(F.col("u"), "user").otherwise("").alias("party"))

    @reg.add("p4_ordered_bucket", """
        SELECT p_partkey, CASE WHEN p_type IS NULL THEN '' WHEN contains(p_name, 'ring') THEN 'rings' WHEN regexp_matches(p_name, 'bolt|nut') THEN 'fasteners' ELSE 'Not classified' END AS bucket FROM part""")
    def p4(spark, sf):
        n = F.col("p_name")
        return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type").isNull(), "").when(F.contains(n, F.lit("ring")), "rings").when(n.rlike("bolt|nut"), "fasteners").otherwise("Not classified").alias("bucket"))

    @reg.add("p5_flags", "SELECT doc_id, regexp_matches(text, 'Licen[sc]e') AS licence, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS phone, regexp_matches(text, '@[a-z]+\\.') AS mail FROM documents WHERE lang = 'en'")
    def p5(spark, sf):
        flags = {"licence": "Licen[sc]e", "phone": "[0-9]{3}-[0-9]{4}", "mail": r"@[a-z]+\."}
        return table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", *[lexicons.any_match(F.col("text"), p).alias(k) for k, p in flags.items()])

    @reg.add("p6_match_counts", "SELECT doc_id, len(regexp_extract_all(text, '(^|[^a-zA-Z])the[^a-zA-Z]'))::BIGINT AS the, len(regexp_extract_all(text, '[.!?]'))::BIGINT AS ends FROM documents WHERE lang = 'en'")
    def p6(spark, sf):
        t = F.col("text")
        return table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", lexicons.count_matches(t, "(^|[^a-zA-Z])the[^a-zA-Z]").alias("the"), lexicons.count_matches(t, "[.!?]").alias("ends"))

    @reg.add("p8_faceted_filter", "SELECT event_id FROM events WHERE event_type = 'click' AND value BETWEEN 5 AND 25 AND user_id < 60")
    def p8(spark, sf):
        facets = {"event_type": "click", "low": 5, "high": 25, "user_below": 60, "props": None}
        e = table(spark, sf, "events")
        tests = {"event_type": lambda v: F.col("event_type") == v, "low": lambda v: F.col("value") >= v, "high": lambda v: F.col("value") <= v, "user_below": lambda v: F.col("user_id") < v, "props": lambda v: F.contains("props", F.lit(v))}
        for name, value in facets.items():
            if value not in (None, ""):  # a blank facet is no filter
                e = e.filter(tests[name](value))
        return e.select("event_id")

    @reg.add("p10_recency_drop_counts", """
        SELECT event_type, count_if(CAST(ts AS DATE) >= DATE '2024-01-20')::BIGINT AS kept, count_if(CAST(ts AS DATE) < DATE '2024-01-20')::BIGINT AS stale, count_if(ts IS NULL)::BIGINT AS no_date FROM events GROUP BY 1""")
    def p10(spark, sf):
        age = F.datediff(F.lit("2024-01-30"), "ts")
        return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(age <= 10).alias("kept"), F.count_if(age > 10).alias("stale"), F.count_if(F.col("ts").isNull()).alias("no_date"))

    @reg.add("p14_gate_with_remainder", """
        SELECT CAST(doc_id AS VARCHAR) AS item, n_chars FROM documents WHERE n_chars >= 20000 UNION ALL SELECT 'rest of ' || count(*), sum(n_chars)::BIGINT FROM documents WHERE n_chars < 20000""")
    def p14(spark, sf):
        d = table(spark, sf, "documents").select("doc_id", "n_chars")
        rest = d.filter("n_chars < 20000").agg(F.concat(F.lit("rest of "), F.count("*")).alias("item"), F.sum("n_chars").alias("n_chars"))
        return d.filter("n_chars >= 20000").select(F.col("doc_id").cast("string").alias("item"), "n_chars").unionByName(rest)

    @reg.add("p17_arity_guard", """
        SELECT p_partkey, CASE WHEN len(string_split(p_name, ' ')) = 2 THEN string_split(p_name, ' ')[1] END AS color, CASE WHEN len(string_split(p_name, ' ')) = 2 THEN string_split(p_name, ' ')[2] END AS kind, len(string_split(p_name, ' ')) <> 2 AS rejected FROM part""")
    def p17(spark, sf):
        parts = F.split("p_name", " ")
        ok = F.size(parts) == 2
        return table(spark, sf, "part").select("p_partkey", F.when(ok, F.get(parts, F.lit(0))).alias("color"), F.when(ok, F.get(parts, F.lit(1))).alias("kind"), (~ok).alias("rejected"))

    @reg.add("p20_redact_own_value", "SELECT c_custkey, 'Holder [redacted] of ' || c_mktsegment AS sentence FROM customer")
    def p20(spark, sf):
        sentence = F.concat_ws(" ", F.lit("Holder"), "c_name", F.lit("of"), "c_mktsegment")
        return table(spark, sf, "customer").select("c_custkey", text.redact(sentence, F.col("c_name")).alias("sentence"))

    @reg.add("q6_leak_check", """
        SELECT c_custkey, CASE WHEN c_custkey % 10 = 7 THEN 'title' WHEN c_custkey % 10 = 3 THEN 'body,note' END AS leaks FROM customer WHERE c_custkey % 10 IN (3, 7)""")
    def q6(spark, sf):
        c, k = table(spark, sf, "customer"), F.col("c_custkey") % 10
        # Names that end in signs, hold the end of a quotation, or are the beginning of a longer word.
        ending = F.element_at(F.array(*map(F.lit, ["", " Jr.", " (II)", r"\E.x", " & Co"])), (F.col("c_custkey") % 5 + 1).cast("int"))
        own = F.concat("c_name", ending)
        c = c.select("c_custkey", own.alias("own"), F.concat(F.lit("Holder "), own, F.lit(" of "), "c_mktsegment").alias("said"))
        clean, longer = text.redact(F.col("said"), F.col("own")), F.concat(F.lit("The "), "own", F.lit("ville case"))
        records = c.select(
            "c_custkey", "own", F.when(k == 7, F.upper("said")).otherwise(clean).alias("title"), F.when(k == 3, F.col("said")).when(k == 5, longer).otherwise(clean).alias("body"),
            F.when(k == 3, F.concat(F.lit("("), "own", F.lit(")"))).when(k == 4, F.lit(None)).otherwise(clean).alias("note"),
        )
        return governance.leaks(records, ["title", "body", "note"], "own").select("c_custkey", F.array_join("leaks", ",").alias("leaks"))

    @reg.add("q1_series_audit", """
        WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS v FROM orders),
        d AS (SELECT DISTINCT o_custkey, month, left(month, 4)::INT * 12 + right(month, 2)::INT AS i FROM m), g AS (SELECT *, i - lag(i) OVER (PARTITION BY o_custkey ORDER BY month) AS step FROM d)
        SELECT 'duplicate' AS rule, o_custkey, month AS detail FROM m GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'illegal', o_custkey, month FROM m WHERE v NOT IN ('F', 'O') UNION ALL SELECT 'gap', o_custkey, month FROM g WHERE step > 1""")
    def q1(spark, sf):
        m = table(spark, sf, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("v"))
        return governance.series_audit(m, "o_custkey", "month", "v", F.col("v").isin("F", "O"))

    @reg.add("q3_method_check", """SELECT 'mismatch' AS strict, 'within' AS loose, 'loose' AS chosen""")
    def q3(spark, sf):
        per = lambda d: d.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.lit(30).alias("m"))
        o = table(spark, sf, "orders")
        stored = per(o)
        loose = stored.withColumn("n", F.col("n") + 1)  # off by one in thousands
        return governance.methodology(stored, per(o.filter("o_orderstatus <> 'P'")), loose, "y", ["n"], "m")

    @reg.add("q4_disposition", """
        WITH f AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'fees.amount' WHEN 1 THEN 'dates.as_of' WHEN 2 THEN 'law.8cfr.text' ELSE 'dates.cutoff' END AS path, nullif(o_orderstatus, 'P') AS found, (o_orderkey % 3 + 1)::INT AS tier,
          CASE WHEN o_orderkey % 10 = 0 THEN 'low' ELSE 'high' END AS confidence, o_orderkey % 13 = 0 AS human_only, o_orderkey % 7 <> 0 AS exists, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE 'F' END AS current, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS verified FROM orders),
        c AS (SELECT *, CASE WHEN path LIKE 'fees.%' OR contains(path, 'cfr') THEN 'out_of_scope' WHEN human_only THEN 'auto_fetchable_false' WHEN confidence = 'low' THEN 'low_confidence' WHEN "exists" AND found IS NOT DISTINCT FROM current THEN 'no_change'
          WHEN verified IS NOT DISTINCT FROM true AND "exists" THEN 'unexpected_change' WHEN verified IS NOT DISTINCT FROM false AND tier = 1 THEN 'verification_transition' WHEN (NOT "exists" OR current IS NULL) AND found IS NOT NULL THEN 'new_coverage'
          WHEN path = 'dates.as_of' THEN 'expected_change' ELSE 'unexpected_change' END AS category FROM f)
        SELECT o_orderkey, category, category IN ('verification_transition', 'new_coverage', 'expected_change') AS eligible, category = 'verification_transition' AS flip FROM c""")
    def q4(spark, sf):
        k = F.col("o_orderkey")
        f = table(spark, sf, "orders").select(
            "o_orderkey",
            F.when(k % 4 == 0, "fees.amount").when(k % 4 == 1, "dates.as_of").when(k % 4 == 2, "law.8cfr.text").otherwise("dates.cutoff").alias("path"),
            F.nullif("o_orderstatus", F.lit("P")).alias("found"),
            (k % 3 + 1).cast("int").alias("tier"),
            F.when(k % 10 == 0, "low").otherwise("high").alias("confidence"),
            (k % 13 == 0).alias("human_only"),
            (k % 7 != 0).alias("exists"),
            F.when((k % 7 != 0) & (k % 11 != 0), "F").alias("current"),
            F.when(k % 5 == 1, True).when(k % 5 != 0, False).alias("verified"),
        )
        return governance.dispose(f, ["fees."], "cfr", ["as_of"]).select("o_orderkey", "category", "eligible", "flip")

    @reg.add("q8_population", """WITH d AS (SELECT count(c_custkey)::BIGINT AS c_custkey, count_if(trim(c_name) <> '')::BIGINT AS c_name, count(c_acctbal)::BIGINT AS c_acctbal FROM customer) UNPIVOT d ON c_custkey, c_name, c_acctbal INTO NAME "column" VALUE filled""")
    def q8(spark, sf):
        return governance.population(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"))

    @reg.add("f2_strip_html", """
        SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
          '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&mdash;', '—'), '&ndash;', '–'), '&amp;', '&'), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) AS body FROM pages""".replace("\\\\", "\\"))
    def f2(spark, sf):
        return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))

    @reg.add("f5_snippet", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(left(text, 120), ' [^ ]*$', '') || '…' END AS snippet FROM documents")
    def f5(spark, sf):
        return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), 120).alias("snippet"))

    @reg.add("f6_sentences", r"""
        SELECT doc_id, left(array_to_string(list_slice(string_split(regexp_replace(text, '([.!?])[ \t\r\n\f\x0B]+', '\1' || chr(1), 'g'), chr(1)), 1, 2), ' '), 600) AS lead FROM documents""")
    def f6(spark, sf):
        return table(spark, sf, "documents").select("doc_id", text.sentences(F.col("text"), 2).alias("lead"))

    @reg.add("f13_stable_id", "SELECT page_id, substr(sha1(page_id || '|' || url), 1, 16) AS id FROM pages")
    def f13(spark, sf):
        return table(spark, sf, "pages").select("page_id", text.stable_id(F.col("page_id").cast("string"), F.col("url")).alias("id"))

    @reg.add("f14_doc_key", "SELECT doc_id, replace(source || '/' || lang, '/', '_') || '__' || substr(sha256(text), 1, 10) AS key FROM documents")
    def f14(spark, sf):
        return table(spark, sf, "documents").select("doc_id", text.doc_key(F.concat_ws("/", "source", "lang"), F.col("text")).alias("key"))

    @reg.add("f26_word_count", r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\r\n\f\x0B]+'))::BIGINT AS words FROM documents")
    def f26(spark, sf):
        return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[^ \t\r\n\f\x0B]+")).cast("long").alias("words"))

    @reg.add("f43_token_tristate", """SELECT * FROM (VALUES ('C', 'CURRENT'), ('U', NULL), ('01NOV22', '2022-11-01'), ('1NOV22', '2022-11-01'), ('15UL24', NULL), ('01JAN61', '1961-01-01'), ('', NULL), ('current', 'CURRENT'), ('31FEB20', NULL)) t(token, cutoff)""")
    def f43(spark, sf):
        t = spark.createDataFrame([(x,) for x in ("C", "U", "01NOV22", "1NOV22", "15UL24", "01JAN61", "", "current", "31FEB20")], "token string")
        return t.select("token", dates.cutoff(F.col("token"), pivot=61).alias("cutoff"))

    @reg.add("f44_any_date", """
        SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
    def f44(spark, sf):
        k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
        shown = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k % 4 == 1, F.date_format(d, "EEE, d MMM yyyy HH:mm:ss")).when(k % 4 == 2, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "M/d/yyyy"))
        return table(spark, sf, "orders").select("o_orderkey", dates.any_date(shown).alias("day"))

    @reg.add("f46_fiscal", "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 'FY' || year(o_orderdate + INTERVAL 3 MONTH) || 'Q' || quarter(o_orderdate + INTERVAL 3 MONTH) AS quarter FROM orders")
    def f46(spark, sf):
        return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().select(F.col("d").cast("string").alias("day"), dates.fiscal_quarter(F.col("d")).alias("quarter"))

    @reg.add("f49_years_months", """
        WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT d, least(d, DATE '1998-02-28') AS a, greatest(d, DATE '1998-02-28') AS b FROM d),
        n AS (SELECT d, (year(b) - year(a)) * 12 + month(b) - month(a) - (day(b) < day(a))::INT AS k FROM m)
        SELECT CAST(d AS VARCHAR) AS day, (k // 12)::INT AS years, (k % 12)::INT AS months, d > DATE '1998-02-28' AS negative FROM n""")
    def f49(spark, sf):
        d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
        return d.select(F.col("d").cast("string").alias("day"), dates.years_months(F.col("d"), F.lit("1998-02-28").cast("date")).alias("r")).select("day", "r.*")

    @reg.add("f54_duration", "SELECT * FROM (VALUES ('1.5 months', 45), ('2 weeks', 14), ('1 year', 365), ('10 days', 10), ('soon', NULL), ('3  weeks ', 21)) t(text, days)")
    def f54(spark, sf):
        t = spark.createDataFrame([(x,) for x in ("1.5 months", "2 weeks", "1 year", "10 days", "soon", "3  weeks ")], "text string")
        return t.select("text", dates.duration_days(F.col("text")).alias("days"))

    @reg.add("f70_rank", """
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'infinity'::DOUBLE WHEN 'P' THEN '-infinity'::DOUBLE ELSE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::DOUBLE END > 10000.5 AS late FROM orders""")
    def f70(spark, sf):
        value = F.when(F.col("o_orderstatus") == "F", "CURRENT").when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        return table(spark, sf, "orders").select("o_orderkey", (dates.cutoff_rank(value) > 10000.5).alias("late"))

    @reg.add("f72_projection", """
        WITH g AS (SELECT o_orderkey, greatest(0, date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) / 365.25::DOUBLE) AS gap, CASE o_orderkey % 3 WHEN 0 THEN [0.7::DOUBLE, 0.45, 0.2] WHEN 1 THEN [1.2, 0.9, 0.6] ELSE [0.1, 0.3, 0.5] END AS p FROM orders),
        h AS (SELECT o_orderkey, gap, greatest(0.15::DOUBLE, p[1]) AS f, greatest(0.10::DOUBLE, p[2]) AS t, greatest(0.06::DOUBLE, p[3]) AS s FROM g)
        SELECT o_orderkey, round(least(60, gap / greatest(f, t)), 6) AS fast, round(least(70, gap / t), 6) AS typical, round(least(80, gap / least(s, t)), 6) AS slow FROM h""")
    def f72(spark, sf):
        from ledgerloom.functions.projection import waits

        k = F.col("o_orderkey") % 3
        pace = lambda i: F.when(k == 0, (0.7, 0.45, 0.2)[i]).when(k == 1, (1.2, 0.9, 0.6)[i]).otherwise((0.1, 0.3, 0.5)[i])
        w = waits(F.datediff("o_orderdate", F.lit("1998-01-01")), pace(0), pace(1), pace(2))
        return table(spark, sf, "orders").select("o_orderkey", w.alias("w")).select("o_orderkey", *[F.round(f"w.{c}", 6).alias(c) for c in ("fast", "typical", "slow")])

    @reg.add("f80_json_flatten", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
    def f80(spark, sf):
        return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))

    @reg.add("search_top12", """
        WITH t AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)
        SELECT page_id, (CASE WHEN contains(title, 'the of') THEN 60 WHEN contains(regexp_replace(title, '[^a-z0-9]+', '', 'g'), 'theof') THEN 52 ELSE 0 END
          + sum_points + round(22 * hits / 2::DOUBLE)::INT)::INT AS score FROM (
          SELECT page_id, title, a + b AS sum_points, (a > 0)::INT + (b > 0)::INT AS hits FROM (
            SELECT page_id, title, CASE WHEN instr(title, 'the') = 1 THEN 26 WHEN instr(title, 'the') > 1 THEN 18 WHEN instr(regexp_replace(title, '[^a-z0-9]+', '', 'g'), 'the') = 1 THEN 22 WHEN instr(regexp_replace(title, '[^a-z0-9]+', '', 'g'), 'the') > 1 THEN 16 ELSE 0 END AS a,
              CASE WHEN instr(title, 'of') = 1 THEN 26 WHEN instr(title, 'of') > 1 THEN 18 WHEN instr(regexp_replace(title, '[^a-z0-9]+', '', 'g'), 'of') = 1 THEN 22 WHEN instr(regexp_replace(title, '[^a-z0-9]+', '', 'g'), 'of') > 1 THEN 16 ELSE 0 END AS b FROM t)) WHERE hits > 0 ORDER BY score DESC, page_id LIMIT 12""")
    def search(spark, sf):
        title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
        scored = table(spark, sf, "pages").select("page_id", text.relevance(["the", "of"], title, F.lit(""), F.lit(""), F.lit(False)).alias("score"))
        return scored.filter("score > 0").orderBy(F.desc("score"), "page_id").limit(12)

    @reg.add("d1_frames")
    def d1(spark, sf):
        said = F.concat_ws(" ", F.lit("In sum we hereby"), F.when(F.col("doc_id") % 2 == 0, "GRANT").otherwise("deny"), F.lit("the petition in part."), "text")
        return clauses(table(spark, sf, "documents").select("doc_id", said.alias("text")), WORDS)

    @reg.add("d1_planted_clauses", f"WITH {PLANTED} SELECT doc_id, verb, object, caps, negated, scope, begin FROM f")
    def d1_planted(spark, sf):
        return clauses(planted(spark, sf), WORDS).select("doc_id", "verb", "object", "caps", "negated", "scope", "begin")

    @reg.add("wl3_texts_to_rates", f"""
        WITH {PLANTED},
        v AS (SELECT doc_id, verb, count(*) AS occ, count_if(caps) AS c FROM f GROUP BY 1, 2),
        verbs AS (SELECT verb, round(sum(c)::DOUBLE / sum(occ), 4) AS caps_ratio, round(count_if(title = 'REMAND ORDER')::DOUBLE / count(*) / (SELECT avg((title = 'REMAND ORDER')::INT) FROM d), 3) AS remand_lift FROM v JOIN d USING (doc_id) GROUP BY 1 HAVING count(*) >= 20),
        objects AS (SELECT object, round(count_if(petition = 'denied')::DOUBLE / count(*), 4) AS deny_rate FROM (SELECT DISTINCT doc_id, object FROM f) JOIN d USING (doc_id) GROUP BY 1 HAVING count(*) >= 10),
        s AS (SELECT f.*, caps_ratio, remand_lift, deny_rate, round(caps_ratio + 0.5::DOUBLE * caps::INT + 0.4::DOUBLE * (place < 0.15 OR place > 0.75)::INT + 0.25::DOUBLE * least(remand_lift / 4, 1.0::DOUBLE), 6) AS score FROM f JOIN verbs USING (verb) LEFT JOIN objects USING (object)),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place, verb, object) AS n FROM s),
        o AS (SELECT doc_id, verb, negated, CASE WHEN verb = 'order' THEN 'operative' WHEN deny_rate >= 0.5 THEN 'reasoning' WHEN deny_rate IS NOT NULL THEN 'operative' ELSE scope END AS scope FROM b WHERE n = 1 AND (caps_ratio > 0 OR remand_lift >= 2)),
        r AS (SELECT d.source, CASE WHEN title = 'REMAND ORDER' OR (verb = 'remand' AND NOT negated) THEN 'remanded' WHEN verb = 'dismiss' AND NOT negated THEN 'dismissed' WHEN NOT negated AND scope <> 'reasoning' AND verb = 'reverse' THEN 'reversed'
            WHEN NOT negated AND scope <> 'reasoning' AND verb = 'vacate' THEN 'vacated' WHEN NOT negated AND scope <> 'reasoning' AND verb = 'modify' THEN 'modified' WHEN NOT negated AND scope <> 'reasoning' AND verb = 'order' THEN 'corrective'
            WHEN verb = 'affirm' OR petition = 'denied' OR negated OR scope = 'reasoning' THEN 'affirmed' ELSE '' END AS outcome FROM d LEFT JOIN o USING (doc_id))
        SELECT source, outcome, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 4) AS share FROM r GROUP BY 1, 2""")
    def wl3(spark, sf):
        docs = planted(spark, sf)
        k = F.col("doc_id")
        labels = docs.select("doc_id", "source", F.when(k % 4 == 0, "REMAND ORDER").otherwise("FINAL ORDER").alias("title"), F.when(k % 3 == 0, "denied").otherwise("granted").alias("petition"))
        found = held(clauses(docs, WORDS)).join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").withColumn("place", clause_place(F.col("begin"), F.col("n")))
        best = vocabulary.operative_clause(found, vocabulary.verbs(found, labels), vocabulary.objects(found, labels))
        decided = labels.join(best, "doc_id", "left").withColumn("title", F.initcap("title"))
        none = F.lit("")
        result = mining.outcome(F.coalesce("verb", none), F.coalesce("scope", none), F.coalesce("negated", F.lit(False)), F.col("title"), F.col("petition"))
        counts = decided.groupBy("source", result.alias("outcome")).agg(F.count("*").alias("n"))
        return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 4))

    outcome_inputs = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'remand' WHEN 1 THEN 'dismiss' WHEN 2 THEN 'reverse' WHEN 3 THEN 'vacate' WHEN 4 THEN 'modify' WHEN 5 THEN 'order' WHEN 6 THEN 'affirm' ELSE '' END AS v,
      CASE o_orderkey % 3 WHEN 0 THEN 'operative' WHEN 1 THEN 'reasoning' ELSE 'unknown' END AS scope, o_orderkey % 5 = 0 AS neg, CASE o_orderkey % 7 WHEN 0 THEN 'Remand Order' WHEN 1 THEN 'Final Order' ELSE '' END AS title, CASE WHEN o_orderstatus = 'P' THEN 'denied' ELSE '' END AS pfr FROM orders"""

    @reg.add("d6_outcome_rule", f"""
        WITH i AS ({outcome_inputs}), r AS (SELECT *, CASE WHEN title = 'Remand Order' OR (v = 'remand' AND NOT neg) THEN 'remanded' WHEN v = 'dismiss' AND NOT neg THEN 'dismissed'
          WHEN NOT neg AND scope <> 'reasoning' AND v = 'reverse' THEN 'reversed' WHEN NOT neg AND scope <> 'reasoning' AND v = 'vacate' THEN 'vacated' WHEN NOT neg AND scope <> 'reasoning' AND v = 'modify' THEN 'modified' WHEN NOT neg AND scope <> 'reasoning' AND v = 'order' THEN 'corrective'
          WHEN v = 'affirm' OR pfr = 'denied' OR neg OR scope = 'reasoning' THEN 'affirmed' ELSE '' END AS outcome FROM i)
        SELECT o_orderkey, outcome, (title <> '' AND outcome <> '' AND ((title = 'Remand Order' AND outcome <> 'remanded') OR (title = 'Final Order' AND outcome = 'remanded'))) AS conflict FROM r""")
    def d6(spark, sf):
        k = F.col("o_orderkey")
        verbs = ("remand", "dismiss", "reverse", "vacate", "modify", "order", "affirm", "")
        pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
        i = table(spark, sf, "orders").select("o_orderkey", pick(verbs, 8).alias("v"), pick(("operative", "reasoning", "unknown"), 3).alias("scope"), (k % 5 == 0).alias("neg"), pick(("Remand Order", "Final Order", "", "", "", "", ""), 7).alias("title"), F.when(F.col("o_orderstatus") == "P", "denied").otherwise("").alias("pfr"))
        r = i.withColumn("outcome", mining.outcome(F.col("v"), F.col("scope"), F.col("neg"), F.col("title"), F.col("pfr")))
        return r.select("o_orderkey", "outcome", mining.conflict(F.col("title"), F.col("outcome")).alias("conflict"))

    @reg.add("d11_category", """
        WITH h AS (SELECT doc_id, contains(text, 'License') AS a, contains(text, '!!') AS b, contains(text, '|') AS c, contains(text, '***') AS g FROM documents)
        SELECT doc_id, CASE WHEN a::INT + b::INT + c::INT = 1 THEN CASE WHEN a THEN 'licence' WHEN b THEN 'shout' ELSE 'table' END WHEN a::INT + b::INT + c::INT > 1 OR g THEN 'cross-cutting' END AS category FROM h""")
    def d11(spark, sf):
        has = lambda s: F.contains("text", F.lit(s))
        return table(spark, sf, "documents").select("doc_id", lexicons.category({"licence": has("License"), "shout": has("!!"), "table": has("|")}, has("***")).alias("category"))

    @reg.add("d12_topic", "SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'french' WHEN contains(url, 'page=') THEN 'paged' ELSE 'policy' END AS topic FROM pages")
    def d12(spark, sf):
        u = F.col("url")
        return table(spark, sf, "pages").select("page_id", F.when(F.contains(u, F.lit("/fr/")), "french").when(F.contains(u, F.lit("page=")), "paged").otherwise("policy").alias("topic"))

    @reg.add("d13_importance", "SELECT event_id, CASE WHEN event_type = 'error' OR value > 35 THEN 'high' WHEN event_type IN ('purchase', 'signup') THEN 'medium' ELSE 'low' END AS importance FROM events")
    def d13(spark, sf):
        t = F.col("event_type")
        return table(spark, sf, "events").select("event_id", F.when((t == "error") | (F.col("value") > 35), "high").when(t.isin("purchase", "signup"), "medium").otherwise("low").alias("importance"))

    @reg.add("d14_gate", "SELECT doc_id, source = 'src1' AND lang = 'en' AND contains(text, 'the ') AS affects FROM documents")
    def d14(spark, sf):
        return table(spark, sf, "documents").select("doc_id", ((F.col("source") == "src1") & (F.col("lang") == "en") & F.contains("text", F.lit("the "))).alias("affects"))

    @reg.add("d17_greedy_cluster")
    def d17(spark, sf):
        # A story's headline is the first line of a document. Equal headlines are one item, with the smallest doc_id.
        headline = F.split_part("text", F.lit("\n"), F.lit(1))
        docs = table(spark, sf, "documents").select("doc_id", F.array_sort(F.coalesce(text.signature(headline, STOP), F.array().cast("array<string>"))).alias("tokens"))
        stories = docs.filter(F.size("tokens") > 0).groupBy("tokens").agg(F.min("doc_id").alias("k"))
        pairs = joins.similar_self_pairs(stories, "k", "tokens", 0.6, STORY_DISTINCTIVE, STORY_RARE)
        seeds = stories.join(mining.cluster_pairs(stories.select("k").distinct(), "k", pairs), "k").select("tokens", "seed")
        return docs.join(seeds, "tokens", "left").select("doc_id", F.coalesce("seed", "doc_id").alias("seed"))
