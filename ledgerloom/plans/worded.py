"""Queries over short texts: occupations, dockets, versions, links, labels, shown values (F3-F31, F71-F103)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table

SYNONYMS = {"ring": "hoop band", "small ring": "ringlet", "widget": "gadget", "bolt": "screw pin"}
OFFICES = ["AT", "CH", "DA", "DC", "NY"]


def register(reg: Registry) -> None:
    @reg.add("f3_keep_lines", r"""
        SELECT page_id, len(html) - len(replace(html, chr(10), '')) AS breaks, strpos(replace(regexp_replace(html, '(?s)<(script)\b.*?</script>|<(style)\b.*?</style>', '', 'g'), chr(10), ''), '<h1>') AS at FROM pages""")
    def f3(spark, sf):
        kept = text.keep_lines(F.col("html"))
        return table(spark, sf, "pages").select("page_id", (F.length(kept) - F.length(F.replace(kept, F.lit("\n"), F.lit("")))).cast("long").alias("breaks"), F.instr(F.replace(kept, F.lit("\n"), F.lit("")), "<h1>").cast("long").alias("at"))

    @reg.add("f7_clause_sentence", """
        SELECT p_partkey, 'We order the ' || p_name || ' of ' || p_brand || '.' AS sentence FROM part""")
    def f7(spark, sf):
        lead = F.concat(F.lit("See 5 C.F.R. 1201. Before it. "), F.repeat(F.lit("word "), (F.col("p_partkey") % 90).cast("int")), F.lit("end. "))
        whole = F.concat(lead, F.lit("We order  the "), "p_name", F.lit(" of "), "p_brand", F.lit(". And more. "), F.repeat(F.lit("more "), 90))
        start = F.length(lead) + 1
        return table(spark, sf, "part").select("p_partkey", text.clause_sentence(whole, start, start + 8).alias("sentence"))

    @reg.add("f9_clean_occupation", """
        SELECT p_partkey, p_name || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' (' || p_brand || ')' WHEN 2 THEN ' (' || p_brand || ' (' || p_type || ') x)' ELSE ' ' || p_brand END AS occupation FROM part""")
    def f9(spark, sf):
        p, size, k = table(spark, sf, "part"), F.col("p_size") % 4, F.col("p_partkey")
        bracket = F.when(size == 1, F.concat(F.lit(" ("), "p_brand", F.lit(")"))).when(size == 2, F.concat(F.lit(" ("), "p_brand", F.lit(" ("), "p_type", F.lit(") x)"))).when(size == 3, F.concat(F.lit(" "), "p_brand")).otherwise("")
        tail = F.when(k % 5 == 1, " under the  SECOND preference as claimed (x").when(k % 5 == 2, "  who ").when(k % 5 == 3, F.concat(F.lit(" ("), "p_type")).when(k % 5 == 4, " ;, ").otherwise("")
        lead = F.when(k % 7 == 3, ") ").when(k % 7 == 4, ", - ").otherwise("")
        worn = F.concat(lead, F.replace("p_name", F.lit(" "), F.lit("  ")), bracket, tail)
        return p.select("p_partkey", text.clean_occupation(worn, (r"under\s+the\s+\w+\s+preference\b", r"who\b")).alias("occupation"))

    @reg.add("f10_scan_damage", """
        SELECT p_partkey, p_partkey % 7 IN (0, 1, 2, 6) AS damaged FROM part""")
    def f10(spark, sf):
        mark = F.element_at(F.array(*map(F.lit, ["v1s10n", "x0", "1a", "10 01", "2b", "0", "I0"])), (F.col("p_partkey") % 7 + 1).cast("int"))
        worn = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_name", mark, "p_type")).otherwise(F.concat_ws(" ", mark, "p_type", "p_name", F.lit("of 2 or 34")))
        return table(spark, sf, "part").select("p_partkey", text.scan_damage(worn).alias("damaged"))

    @reg.add("f11_first_good_capture", """
        SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' maker' WHEN 1 THEN p_name || ' smith' WHEN 2 THEN 'person of skill' WHEN 3 THEN p_brand || ' clerk' WHEN 4 THEN '' ELSE p_name || ' (' || p_brand || ')' END AS occupation FROM part""")
    def f11(spark, sf):
        patterns = [r"(?i)\bhired as an? ([^.,;]{3,90}?) (?:at|with)\b", r"(?i)\bthe work of an? ([^.,;]{3,90})"]
        kind, name, brand = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_brand")
        many = F.concat_ws(" ", *[F.lit(f"word{n}") for n in range(13)])
        bodies = [
            F.concat(F.lit("In 2020 she was hired as a "), name, F.lit(" maker at "), brand, F.lit(". It is the work of a lifetime.")),
            F.concat(F.lit("Hired as a guest that is early at noon, he does the work of a "), name, F.lit(" smith; "), brand),
            F.concat(F.lit("Hired as a person of skill with "), brand, F.lit(", "), name),
            F.concat(F.lit("He was hired as a person of skill at "), name, F.lit(". He does the work of a "), brand, F.lit(" clerk.")),
            F.concat(F.lit("Hired as a "), many, F.lit(" at noon. "), F.repeat(F.lit("x"), 3000), F.lit(" hired as a "), name, F.lit(" at noon.")),
            F.concat(F.lit("hired as a "), name, F.lit(" ("), brand, F.lit(") (and more at home")),
        ]
        body = F.element_at(F.array(*bodies), (kind + 1).cast("int"))
        return table(spark, sf, "part").select("p_partkey", text.first_good(body, patterns, r"(?i)\b(that|is)\b", r"(?i)^person of skill").alias("occupation"))

    @reg.add("f12_status", """
        SELECT o_orderkey AS k, 'Certified-' || o_orderpriority AS status FROM orders""")
    def f12(spark, sf):
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.status(F.concat(F.lit(" Certified  -  "), "o_orderpriority")).alias("status"))

    @reg.add("f17_docket_parts", """
        SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'NY' ELSE '' END AS office, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE right('0' || o_custkey, 4) END AS kind FROM orders""")
    def f17(spark, sf):
        kind = F.expr("right('0' || o_custkey, 4)")
        docket = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" NY-"), kind, F.lit("-16-0001-I-1"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("ZZ-"), kind)).otherwise("NY")
        return table(spark, sf, "orders").withColumn("p", text.docket_parts(docket, OFFICES)).select(F.col("o_orderkey").alias("k"), "p.office", "p.kind")

    @reg.add("f19_query_tokens", """
        WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS words FROM part),
        syn(k, v) AS (VALUES ('ring', ['hoop', 'band']), ('widget', ['gadget']), ('bolt', ['screw', 'pin'])),
        t AS (SELECT p_partkey, p_name, w, i FROM (SELECT p_partkey, p_name, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w)),
        e AS (SELECT p_partkey, i, [w] || coalesce(v, []) AS own FROM t LEFT JOIN syn ON k = w),
        f AS (SELECT p_partkey, flatten(list(own ORDER BY i)) AS own FROM e GROUP BY 1)
        SELECT f.p_partkey, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') AS tokens
        FROM (SELECT f.p_partkey, CASE WHEN contains(p_name, 'small ring') THEN ['ringlet'] ELSE [] END || own AS a FROM f JOIN part USING (p_partkey)) f""")
    def f19(spark, sf):
        query = F.concat(F.lit("What is the "), F.initcap("p_name"), F.lit("?"))
        return table(spark, sf, "part").select("p_partkey", F.array_join(text.query_tokens(query, SYNONYMS, ("what", "is", "the")), " ").alias("tokens"))

    @reg.add("f23_labelled_cell", """
        SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'again: ' || o_custkey ELSE o_custkey || ' ' || o_orderpriority END AS first, CASE WHEN o_orderkey % 2 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS second FROM orders""")
    def f23(spark, sf):
        k = F.col("o_orderkey")
        perm = F.when(k % 2 == 1, F.concat(F.lit("\n perm :"), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise("")
        noise = F.when(k % 3 == 0, F.concat(F.lit("\nno label "), "o_custkey")).when(k % 3 == 1, F.concat(F.lit("\n : "), "o_custkey")).otherwise(F.concat(F.lit("\nperms: "), "o_custkey"))
        cell = F.concat(F.lit("H-1b :  "), "o_custkey", F.lit(" "), "o_orderpriority", F.lit(" "), perm, noise, F.when(k % 5 == 0, F.concat(F.lit("\nh-1B: again: "), "o_custkey")).otherwise(""))
        return table(spark, sf, "orders").withColumn("m", text.labelled(cell)).select(k.alias("k"), F.try_element_at("m", F.lit("H-1B")).alias("first"), F.try_element_at("m", F.lit("PERM")).alias("second"))

    @reg.add("f24_escapes", r"""
        SELECT o_orderkey AS k, '<b>&amp;' AS plain, '&lt;b class=&quot;' || o_orderpriority || '&quot;&gt;&amp;amp;' AS html, '\*' || o_orderpriority || '\_\[x\]' AS markdown, format('{:,}', o_custkey * 1000) AS shown FROM orders""")
    def f24(spark, sf):
        html = text.html_escape(F.concat(F.lit('<b class="'), "o_orderpriority", F.lit('">&amp;')))
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit("<b>&amp;").alias("plain"), html.alias("html"), text.markdown_escape(F.concat(F.lit("*"), "o_orderpriority", F.lit("_[x]"))).alias("markdown"), text.thousands(F.col("o_custkey") * 1000).alias("shown"))

    @reg.add("f25_next_patch", """
        SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN '1.' || o_custkey || '.' || (o_orderkey + 1) WHEN 1 THEN 'v' || o_orderkey || '.1' WHEN 2 THEN o_custkey || '.2.1' WHEN 3 THEN '0' || o_custkey || '.7.' || (o_orderkey + 1) WHEN 4 THEN '1.' || o_custkey || '.3.4.1' ELSE '1.2.-' || o_orderkey || '.1' END AS version FROM orders""")
    def f25(spark, sf):
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        kinds = [F.format_string("1.%d.%d", c, k), F.format_string("v%d", k), F.format_string("%d.2", c), F.format_string(" 0%d.7.%d ", c, k), F.format_string("1.%d.3.4", c), F.format_string("1.2.-%d", k)]
        return table(spark, sf, "orders").select(k.alias("k"), text.next_patch(F.element_at(F.array(*kinds), (k % 6 + 1).cast("int"))).alias("version"))

    @reg.add("f27_first_link", """
        WITH l AS (SELECT page_id, url, 'https://x.org/' || ['Unsubscribe', 'my/PREFERENCES', 'a/subscriber/z', 'Removal'][page_id % 4 + 1] || '?p=' || page_id AS bad FROM pages)
        SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN bad WHEN 2 THEN 'http://plain/' || page_id WHEN 3 THEN '' ELSE url END AS link FROM l""")
    def f27(spark, sf):
        k = F.col("page_id")
        bad = F.concat(F.lit("https://x.org/"), F.element_at(F.array(*map(F.lit, ["Unsubscribe", "my/PREFERENCES", "a/subscriber/z", "Removal"])), (k % 4 + 1).cast("int")), F.lit("?p="), k)
        plain, mail = F.concat(F.lit("http://plain/"), k), F.concat(F.lit("mailto:"), k)
        lists = [F.array(mail, bad, F.col("url"), plain), F.array(bad, F.concat(F.lit("ftp://"), k)), F.array(bad, plain, F.col("url")), F.array(mail, F.concat(F.lit("/page/"), k)), F.array(F.col("url"), bad)]
        return table(spark, sf, "pages").select("page_id", text.first_link(F.element_at(F.array(*lists), (k % 5 + 1).cast("int"))).alias("link"))

    @reg.add("f28_bare_title", """
        SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN p_name || ' (PDF, ' || p_size || ' KB) of ' || p_brand WHEN 4 THEN p_name || ' (old) ' || p_brand ELSE p_name || ' ' || p_brand END AS title FROM part""")
    def f28(spark, sf):
        base, k = F.concat_ws(" ", "p_name", "p_brand"), F.col("p_partkey") % 5
        sized = F.concat(F.lit(" (PDF, "), "p_size", F.lit(" KB)"))
        title = F.when(k == 0, F.concat(base, sized)).when(k == 1, F.concat(base, F.lit("(pdf)"))).when(k == 2, F.concat(base, F.lit("  (Pdf, "), F.col("p_size") / 10, F.lit(" MB)  ")))
        title = title.when(k == 3, F.concat("p_name", sized, F.lit(" of "), "p_brand")).otherwise(F.concat("p_name", F.lit(" (old) "), "p_brand", sized))
        return table(spark, sf, "part").select("p_partkey", text.bare_title(title).alias("title"))

    @reg.add("f29_route", """
        SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'advanced_degree' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '+exceptional' ELSE '' END AS route FROM orders""")
    def f29(spark, sf):
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.route(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0).alias("route"))

    @reg.add("f30_confidence_tier", """
        SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'unverified' WHEN o_custkey % 5 IN (0, 1) THEN 'verified' WHEN o_custkey % 5 = 2 THEN 'unverified' ELSE 'aggregator' END AS tier FROM orders""")
    def f30(spark, sf):
        k = F.col("o_orderkey") % 4
        marks = ["Tier-1", "TIER-1 and single-source", "a Single-Source", "tier 1, single source", "tier-2"]
        mark = F.element_at(F.array(*map(F.lit, marks)), (F.col("o_custkey") % 5 + 1).cast("int"))
        note = F.when((F.col("o_custkey") % 5 == 4) & (k == 3), F.lit(None)).otherwise(F.concat("o_orderpriority", F.lit(" by "), mark, F.lit(", read on "), F.date_format("o_orderdate", "yyyy-MM-dd")))
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.confidence_tier(F.when(k == 0, F.lit(False)).when(k == 1, F.lit(True)), note).alias("tier"))

    @reg.add("f31_relevance_dots", """
        SELECT o_orderkey AS k, greatest(1, least(5, CASE o_orderkey % 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END))::INT AS dots FROM orders""")
    def f31(spark, sf):
        importance = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "low").otherwise("medium")
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.relevance_dots(F.col("o_orderkey") % 4, importance, F.col("o_orderkey") % 3 == 0).alias("dots"))

    @reg.add("f71_safe_percent", """
        SELECT event_type, CASE WHEN count_if(value > 1000000) = 0 THEN 0.0 ELSE 100.0 END::DOUBLE AS of_none, round(100.0::DOUBLE * count_if(value > 10) / count(*), 9) AS of_all FROM events GROUP BY 1""")
    def f71(spark, sf):
        big = F.count_if(F.col("value") > 1000000)
        return table(spark, sf, "events").groupBy("event_type").agg(text.percent(big, big).alias("of_none"), F.round(text.percent(F.count_if(F.col("value") > 10), F.count("*")), 9).alias("of_all"))

    @reg.add("f75_scale", """
        WITH s AS (SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS span FROM orders GROUP BY 1 HAVING max(o_totalprice) > min(o_totalprice)),
        l AS (SELECT o_custkey, span, pow(10.0, floor(log10(span / 8)))::DOUBLE AS p FROM s)
        SELECT o_custkey, CASE WHEN span / 8 / p <= 1 THEN 1 WHEN span / 8 / p <= 2 THEN 2 WHEN span / 8 / p <= 5 THEN 5 ELSE 10 END * p AS step, greatest(0.0::DOUBLE, least(100.0::DOUBLE, span / 4000)) AS place FROM l""")
    def f75(spark, sf):
        s = table(spark, sf, "orders").groupBy("o_custkey").agg((F.max("o_totalprice") - F.min("o_totalprice")).alias("span")).filter("span > 0")
        return s.select("o_custkey", text.nice_step(F.col("span"), 8).alias("step"), text.clamp(F.col("span") / 4000, 0.0, 100.0).alias("place"))

    @reg.add("f76_digit_list", """
        SELECT o_orderkey AS k, list_sum(list_transform(string_split(o_orderkey::VARCHAR, ''), lambda d: d::INT))::BIGINT AS total, contains(o_orderkey::VARCHAR, '3') AS has_three FROM orders""")
    def f76(spark, sf):
        listed = text.digits_listed(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.aggregate(listed, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_contains(listed, 3).alias("has_three"))

    @reg.add("f80_canonical_json", """
        SELECT l_orderkey AS k, '{' || string_agg('"' || l_linenumber || '":' || q, ',' ORDER BY l_linenumber::VARCHAR) || '}' AS json FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
    def f80(spark, sf):
        per = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("q"))
        entries = F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("n"), "q")))  # an order's lines
        return per.groupBy(F.col("l_orderkey").alias("k")).agg(text.canonical_json(entries).alias("json"))

    @reg.add("f82_map_defaults", """
        SELECT event_type, count(*)::BIGINT AS n, coalesce(CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' END, 'other') AS code FROM events GROUP BY 1""")
    def f82(spark, sf):
        codes = F.create_map(F.lit("click"), F.lit("C"), F.lit("view"), F.lit("V"))
        return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("code", F.coalesce(F.try_element_at(codes, F.col("event_type")), F.lit("other")))

    @reg.add("f83_array_tests", """
        SELECT l_orderkey AS k, bool_or(l_quantity > 45) AS some, bool_and(l_quantity > 5) AS every, min(l_linenumber) FILTER (l_quantity > 45)::INT AS first FROM lineitem GROUP BY 1""")
    def f83(spark, sf):
        lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("a"))  # an order's lines
        big = lambda x: x["l_quantity"] > 45
        return lines.select("k", F.exists("a", big).alias("some"), F.forall("a", lambda x: x["l_quantity"] > 5).alias("every"), F.get(F.filter("a", big), F.lit(0))["l_linenumber"].cast("int").alias("first"))

    @reg.add("f84_sparse_struct", """
        SELECT o_custkey, '{' || concat_ws(',', CASE WHEN f > 0 THEN '"f":' || f END, CASE WHEN o > 0 THEN '"o":' || o END, CASE WHEN p > 0 THEN '"p":' || p END) || '}' AS json
        FROM (SELECT o_custkey, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p FROM orders GROUP BY 1)""")
    def f84(spark, sf):
        per = table(spark, sf, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])
        return per.select("o_custkey", text.sparse(f=F.col("f"), o=F.col("o"), p=F.col("p")).alias("json"))

    @reg.add("f90_useful_summary", """
        SELECT doc_id, coalesce(trim(text) <> '' AND length(trim(text)) > length(trim(left(text, 60))) + 20, false) AS useful FROM documents""")
    def f90(spark, sf):
        return table(spark, sf, "documents").select("doc_id", text.useful_summary(F.col("text"), F.substring("text", 1, 60)).alias("useful"))

    @reg.add("f91_reason", """
        SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'Flag: ' || o_orderstatus ELSE '' END AS reason FROM orders""")
    def f91(spark, sf):
        k = F.col("o_orderkey") % 3
        return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.reason(F.when(k == 0, F.col("o_orderpriority")).when(k == 1, " "), F.when(k < 2, F.col("o_orderstatus"))).alias("reason"))

    @reg.add("f95_provenance", """
        SELECT o_custkey, CASE WHEN f IS NULL AND o IS NULL THEN '' ELSE concat_ws('; ', 'Filled as of ' || f, 'Open as of ' || o) || '.' END AS said
        FROM (SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'F' AND o_orderkey % 4 = 0)::DATE::VARCHAR AS f, max(o_orderdate) FILTER (o_orderstatus = 'O' AND o_orderkey % 4 = 1)::DATE::VARCHAR AS o FROM orders GROUP BY 1)""")
    def f95(spark, sf):
        latest = lambda s, r: F.max(F.when((F.col("o_orderstatus") == s) & (F.col("o_orderkey") % 4 == r), F.to_date("o_orderdate"))).cast("string")
        per = table(spark, sf, "orders").groupBy("o_custkey").agg(latest("F", 0).alias("f"), latest("O", 1).alias("o"))
        return per.select("o_custkey", text.provenance({"Filled": F.col("f"), "Open": F.col("o")}).alias("said"))

    @reg.add("f97_shown_values", """
        SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '—' ELSE c_mktsegment END AS segment, greatest(0.0::DOUBLE, least(100.0::DOUBLE, c_acctbal / 50)) AS bar FROM customer""")
    def f97(spark, sf):
        segment = F.when(F.col("c_custkey") % 8 == 0, " ").when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
        return table(spark, sf, "customer").select("c_custkey", text.or_dash(segment).alias("segment"), text.clamp(F.col("c_acctbal") / 50, 0.0, 100.0).alias("bar"))

    @reg.add("f101_only_link", """
        SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS only, url AS first FROM pages""")
    def f101(spark, sf):
        given = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), "url", F.lit("\n"))).otherwise(F.concat(F.lit("see <"), "url", F.lit("> and http://x")))
        return table(spark, sf, "pages").select("page_id", text.only_link(given).alias("only"), text.first_url(given).alias("first"))

    @reg.add("p20_redact_names", """
        SELECT c_custkey, '[redacted] and [redacted], LEE, of the Agency for ' || c_mktsegment AS sentence FROM customer""")
    def p20(spark, sf):
        name = F.concat(F.lit("Smith"), F.col("c_custkey"))
        sentence = F.concat(F.upper(name), F.lit("-Jones and "), F.initcap(name), F.lit(", LEE, of the Agency for "), "c_mktsegment")
        names = F.array(name, F.concat(name, F.lit("-Jones")), F.lit("Lee"), F.lit("agency"))
        return table(spark, sf, "customer").select("c_custkey", text.redact_names(sentence, names, ("Agency",)).alias("sentence"))

    @reg.add("d8_evidence", """
        SELECT c_custkey, 'We order [redacted] to ' || c_mktsegment || '.' AS evidence FROM customer""")
    def d8(spark, sf):
        name = F.concat(F.lit("Smith"), F.col("c_custkey"))
        lead = F.concat(F.lit("About "), name, F.lit(". "))
        whole = F.concat(lead, F.lit("We order "), name, F.lit(" to "), "c_mktsegment", F.lit(". "), name, F.lit(" left."))
        start = F.length(lead) + 1
        return table(spark, sf, "customer").select("c_custkey", text.evidence(whole, start, start + 8, F.array(name)).alias("evidence"))
