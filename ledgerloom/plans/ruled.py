"""Queries over clauses, vocabularies, citations and the relevance of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import mining, relevance, vocabulary
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table

# Clauses made of order lines, the same in both languages: an order is a document, a line a clause.
CLAUSES = """
f AS (SELECT l_orderkey AS doc_id, ['order', 'vacate', 'affirm', 'modify', 'find'][l_partkey % 5 + 1] AS verb, 'object ' || (l_suppkey % 40) AS object, l_linenumber % 2 = 0 AS caps, l_quantity > 40 AS negated,
  ['partial', 'full', 'unknown'][l_suppkey % 3 + 1] AS scope, l_quantity / 50.0 AS place FROM lineitem),
d AS (SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'P' THEN 'REMAND ORDER' WHEN 'F' THEN 'FINAL ORDER' ELSE '' END AS title, CASE WHEN o_orderpriority < '3' THEN 'denied' ELSE 'granted' END AS petition FROM orders),
v AS (SELECT doc_id, verb, count(*) AS occ, count_if(caps) AS c, count_if(negated) AS n, count_if(place < 0.15 OR place > 0.75) AS e, count_if(scope = 'partial') AS sp, count_if(scope = 'full') AS sf, count_if(scope = 'unknown') AS su FROM f GROUP BY 1, 2),
verbs AS (SELECT verb, count(*)::BIGINT AS docs, sum(occ)::BIGINT AS occurrences, round(sum(c)::DOUBLE / sum(occ), 4) AS caps_ratio, round(sum(e)::DOUBLE / sum(occ), 4) AS edge_share, round(sum(n)::DOUBLE / sum(occ), 4) AS negated_ratio,
  round(count_if(title = 'REMAND ORDER')::DOUBLE / count(*) / (SELECT avg((title = 'REMAND ORDER')::INT) FROM d), 3) AS remand_lift, sum(sp)::BIGINT AS scope_partial, sum(sf)::BIGINT AS scope_full, sum(su)::BIGINT AS scope_unknown
  FROM v LEFT JOIN d USING (doc_id) GROUP BY 1 HAVING count(*) >= 20),
objects AS (SELECT object, count(*)::BIGINT AS docs, round(count_if(petition = 'denied')::DOUBLE / count(*), 4) AS deny_rate FROM (SELECT DISTINCT doc_id, object FROM f) LEFT JOIN d USING (doc_id) GROUP BY 1 HAVING count(*) >= 10)"""


def clauses(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    line = table(spark, sf, "lineitem")
    found = line.select(
        F.col("l_orderkey").alias("doc_id"), pick(["order", "vacate", "affirm", "modify", "find"], F.col("l_partkey") % 5).alias("verb"), F.concat(F.lit("object "), F.col("l_suppkey") % 40).alias("object"), (F.col("l_linenumber") % 2 == 0).alias("caps"),
        (F.col("l_quantity") > 40).alias("negated"), pick(["partial", "full", "unknown"], F.col("l_suppkey") % 3).alias("scope"), (F.col("l_quantity") / 50.0).alias("place"),
    )
    order = table(spark, sf, "orders")
    title = F.when(F.col("o_orderstatus") == "P", "REMAND ORDER").when(F.col("o_orderstatus") == "F", "FINAL ORDER").otherwise("")
    labels = order.select(F.col("o_orderkey").alias("doc_id"), title.alias("title"), F.when(F.col("o_orderpriority") < "3", "denied").otherwise("granted").alias("petition"))
    return found, labels


# Rules made of parts: a title by the key, a body that amends a section or none, and the guide's citations.
RULE = """
r AS (SELECT p_partkey AS k, p_partkey % 5 AS t, p_partkey % 4 AS b, p_size % 10 AS s FROM part)"""


def register(reg: Registry) -> None:
    @reg.add("d2_vocabulary", f"WITH {CLAUSES} SELECT * FROM verbs")
    def d2(spark, sf):
        return vocabulary.verbs(*clauses(spark, sf))

    @reg.add("d2_objects", f"WITH {CLAUSES} SELECT * FROM objects")
    def d2_objects(spark, sf):
        return vocabulary.objects(*clauses(spark, sf))

    @reg.add("d2_frame_table", f"""
        WITH {CLAUSES} SELECT verb, object, min(scope) AS scope, count(*)::BIGINT AS docs FROM (SELECT doc_id, verb, object, min(scope) AS scope FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 20""")
    def d2_frames(spark, sf):
        return vocabulary.frame_table(clauses(spark, sf)[0])

    @reg.add("a10_residual", f"""
        WITH {CLAUSES}, w AS (SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT doc_id, verb, object FROM f) GROUP BY verb, object), o AS (SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT doc_id, object FROM f) GROUP BY object)
        SELECT (SELECT count_if(n < 150) FROM w)::BIGINT AS frames_below, (SELECT coalesce(sum(n) FILTER (n < 150), 0) FROM w)::BIGINT AS occurrences_below, (SELECT count_if(n >= 800) FROM o)::BIGINT AS objects_kept, (SELECT round(100.0::DOUBLE * coalesce(sum(n) FILTER (n >= 800), 0) / sum(n), 4) FROM o) AS coverage""")
    def a10(spark, sf):
        return vocabulary.residual(clauses(spark, sf)[0], 150, 800)

    @reg.add("d5_operative_clause", f"""
        WITH {CLAUSES}, s AS (SELECT f.*, caps_ratio, remand_lift, deny_rate, round(caps_ratio + 0.5::DOUBLE * caps::INT + 0.4::DOUBLE * (place < 0.15 OR place > 0.75)::INT + 0.25::DOUBLE * least(remand_lift / 4, 1.0::DOUBLE), 6) AS score FROM f JOIN verbs USING (verb) LEFT JOIN objects USING (object)),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place, verb, object) AS n FROM s)
        SELECT doc_id, verb, object, negated, CASE WHEN verb = 'order' THEN 'operative' WHEN deny_rate >= 0.5 THEN 'reasoning' WHEN deny_rate IS NOT NULL THEN 'operative' ELSE scope END AS scope, score FROM b WHERE n = 1 AND (caps_ratio > 0 OR remand_lift >= 2)""")
    def d5(spark, sf):
        found, labels = clauses(spark, sf)
        found = found.distinct()
        return vocabulary.operative_clause(found, vocabulary.verbs(clauses(spark, sf)[0], labels), vocabulary.objects(found, labels))

    @reg.add("j23_broadcast_vocab", f"""
        WITH {CLAUSES} SELECT doc_id, count(*)::BIGINT AS n, count(deny_rate)::BIGINT AS known, max(deny_rate) AS rate FROM f LEFT JOIN objects USING (object) GROUP BY 1""")
    def j23(spark, sf):
        found, labels = clauses(spark, sf)
        known = vocabulary.lookup(found, vocabulary.objects(found, labels), "object")
        return known.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("deny_rate").alias("known"), F.max("deny_rate").alias("rate"))

    @reg.add("d3_order_title", """
        SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'REMAND ORDER' WHEN 1 THEN 'OPINION AND ORDER' ELSE '' END AS title FROM orders""")
    def d3(spark, sf):
        k = F.col("o_orderkey") % 3
        body = F.when(k == 0, "x\nREMAND ORDER\nFINAL ORDER").when(k == 1, "the OPINION AND ORDER of REMAND ORDER").otherwise(F.concat(F.lit("Remand Order "), F.repeat(F.lit("word "), 1200), F.lit(" FINAL ORDER")))
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), mining.order_title(body, ("REMAND ORDER", "FINAL ORDER", "OPINION AND ORDER", "ORDER")).alias("title"))

    @reg.add("d4_petition_result", """
        SELECT l_orderkey AS doc_id, CASE WHEN arg_min(g, (NOT caps, l_linenumber)) THEN 'granted' ELSE 'denied' END AS petition
        FROM (SELECT l_orderkey, l_linenumber, l_partkey % 3 = 0 AS g, l_suppkey % 2 = 0 AS caps FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1 AND l_partkey % 3 < 2) GROUP BY 1""")
    def d4(spark, sf):
        from pyspark.sql import Window

        first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
        line = table(spark, sf, "lineitem").withColumn("n", first).filter("n = 1")
        verb = F.when(F.col("l_partkey") % 3 == 0, "granted").when(F.col("l_partkey") % 3 == 1, "deny").otherwise("find")
        return mining.petition_result(line.select(F.col("l_orderkey").alias("doc_id"), verb.alias("verb"), (F.col("l_suppkey") % 2 == 0).alias("caps"), F.col("l_linenumber").alias("start")))

    @reg.add("d9_prongs_failed", """
        SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE '' END || CASE WHEN p_partkey // 3 % 3 = 0 THEN '2' ELSE '' END || CASE WHEN p_partkey // 9 % 3 = 0 THEN '3' ELSE '' END AS prongs, p_partkey % 5 = 1 AS stopped FROM part""")
    def d9(spark, sf):
        k = F.col("p_partkey")
        # For each prong: found unmet, or only named near a finding about something else, or too far from it.
        far = F.concat(F.lit(" has not shown, "), F.repeat(F.concat("p_name", F.lit(", ")), 20))
        parts = [("public weight", "He has not shown the "), ("good  standing", "They FAILED to prove that of the "), ("balance of gains", "It has not  shown, as said, the ")]
        said = []
        for n, (name, finding) in enumerate(parts):
            bit = F.floor(k / 3**n) % 3
            met = F.concat(F.lit(f"The {name} is plain. He has not shown "), "p_name", F.lit(". "))
            said.append(F.when(bit == 0, F.concat(F.lit(finding), F.lit(f"{name} of "), "p_name", F.lit(". "))).when(bit == 1, met).otherwise(F.concat(F.lit("It"), far, F.lit(f"the {name}. "))))
        stop = F.when(k % 5 == 1, F.concat(F.lit("We need not reach "), "p_brand", F.lit(" or the remaining tests."))).when(k % 5 == 2, "We need not reach it. The remaining tests stand.").otherwise("We reach the remaining tests.")
        prongs = (relevance.Prong(1, ("public weight",), 60), relevance.Prong(2, ("good standing",), 60), relevance.Prong(3, ("balance of gains",), 60))
        text = F.concat(*said, stop)
        return table(spark, sf, "part").select("p_partkey", relevance.prongs_failed(text, ("has not shown", "failed to prove"), prongs).alias("prongs"), relevance.stopped_early(text, ("need not reach",), ("remaining tests",)).alias("stopped"))

    @reg.add("d18_citations", """
        SELECT p_partkey, '8' AS title, '214.' || p_size AS section, 'h' AS paragraph FROM part UNION ALL SELECT p_partkey, '20', '655.' || (p_partkey % 9 + 1), NULL FROM part""")
    def d18(spark, sf):
        said = F.concat(F.lit("Under 8 CFR 214."), "p_size", F.lit("(h)(4) and 20 cfr 655."), F.col("p_partkey") % 9 + 1, F.lit("; again 8  CFR 214."), "p_size", F.lit("(h)(9)."))
        return table(spark, sf, "part").select("p_partkey", F.inline(relevance.citations(said)))

    @reg.add("d18_amended", """
        SELECT p_partkey, '214.' || p_size AS section, 'f,h' AS paragraphs FROM part UNION ALL SELECT p_partkey, '655.731', CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE '' END FROM part""")
    def d18_amended(spark, sf):
        tail = F.when(F.col("p_partkey") % 2 == 0, " is amended by revising paragraph (c).").otherwise(F.concat(F.lit(" is amended by "), F.repeat(F.lit("words "), 500), F.lit("paragraph (c).")))
        body = F.concat(F.lit("1. Amend Sec. 214."), "p_size", F.lit(" as follows: revise paragraphs (f) and\n(h). 2. Section 655.731"), tail)
        # The texts are made of a few bytes a row, so that a file is one task unless its rows are dealt out.
        parts = table(spark, sf, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
        return parts.select("p_partkey", F.explode(relevance.amended(body)).alias("a")).select("p_partkey", "a.section", F.array_join(F.array_sort("a.paragraphs"), ",").alias("paragraphs"))

    @reg.add("d19_relevance", f"""
        WITH {RULE}, e AS (SELECT k, t, b, b = 0 AND s IN (1, 2) AS exact, b < 2 AND s IN (1, 2, 3) AS near, b = 3 AS nothing FROM r),
        g AS (SELECT k, CASE WHEN t = 0 THEN 1 WHEN exact THEN 2 WHEN t IN (1, 2) THEN 3 WHEN near THEN 4 WHEN nothing THEN 5 ELSE 6 END AS rung FROM e)
        SELECT k AS p_partkey, CASE WHEN rung IN (1, 6) THEN 'WATCH' ELSE 'ACTION' END AS severity, rung FROM g""")
    def d19(spark, sf):
        t, b = F.col("p_partkey") % 5, F.col("p_partkey") % 4
        title = F.when(t == 0, "Fee adjustments for naturalization and refugees").when(t == 1, "Wage levels of H-1B workers and asylum").when(t == 2, "Biometric fees").when(t == 3, "A final rule")
        section = F.concat(F.lit("214."), F.col("p_size") % 10)
        body = F.when(b == 0, F.concat(F.lit("Amend Sec. "), section, F.lit(" by revising paragraphs (h), (k)."))).when(b == 1, F.concat(F.lit("Section "), section, F.lit(" is amended."))).when(b == 2, "Revise Sec. 999.9 paragraph (h).").otherwise("No instruction.")
        cited = spark.createDataFrame([("8", "214.1", "h"), ("8", "214.2", "h"), ("8", "214.3", "c"), ("20", "214.4", "h"), ("8", "214.3", None)], "title string, section string, paragraph string")
        subjects = relevance.Subjects(("H-1B", "wage level*"), ("fee*", "biometric*"), ("naturalization", "asylum"))
        return relevance.relevance(table(spark, sf, "part").select("p_partkey", title.alias("title"), body.alias("body")), cited, "p_partkey", subjects)

    @reg.add("d20_regions", """
        SELECT p_partkey, false AS in_flag, NULL AS kind, 'q-first' AS anchor, 4 AS line, '2026-09-15' AS date FROM part
        UNION ALL SELECT p_partkey, true, 'is-warn', 'q-first', CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 5 END, '2026-01-02' FROM part
        UNION ALL SELECT p_partkey, false, NULL, 'part-x', CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 7 END, '2025-03-04' FROM part""")
    def d20(spark, sf):
        html = F.concat(F.lit('<html>\n<script>var d = "2020-01-01";\n</script>\n<h3 id="q-first" class="x">When</h3> by September 15, 2026'), F.when(F.col("p_partkey") % 2 == 0, "\n").otherwise(""), F.lit('<p>x</p>\n<div class="note-box is-warn" title="x">until 2026-01-02</div> no date\n'), F.lit('\n<section id="part-x">from 4 March 2025</section>'))
        found = relevance.regions(table(spark, sf, "part").select("p_partkey", html.alias("html")), "p_partkey", "html", "note-box", "is-", ("q-", "part-"))
        return found.withColumn("date", F.col("date").cast("string"))

    @reg.add("d21_ruling_severity", """
        SELECT l_orderkey AS k, CASE WHEN bool_or(l_partkey % 10 = 0) THEN 'ACTION' ELSE 'WATCH' END AS severity FROM lineitem GROUP BY 1""")
    def d21(spark, sf):
        said = F.when(F.col("l_partkey") % 10 == 0, "MEMORANDUM and order").otherwise("Notice of appearance in borders")
        return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(relevance.entry_severity(F.collect_list(said), ("memorandum", "order*")).alias("severity"))  # an order's lines
