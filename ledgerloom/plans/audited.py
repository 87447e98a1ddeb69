"""Audits over tables of tables, registries, stores and documents of any values."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import governance, variants
from ledgerloom.plans.registry import Registry
from ledgerloom.session import shared_place, table
from ledgerloom.sources.store import Store

STOP = ("the", "of", "a")


def register(reg: Registry) -> None:
    @reg.add("q9_identical_tables", """
        WITH t AS (SELECT o_custkey, string_agg(o_orderstatus, '|' ORDER BY o_orderstatus) AS rows FROM orders GROUP BY 1)
        SELECT o_custkey, same_as FROM (SELECT o_custkey, min(o_custkey) OVER (PARTITION BY rows) AS same_as FROM t) WHERE o_custkey <> same_as""")
    def q9(spark, sf):
        return governance.identical_tables(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", ["o_orderstatus"])

    @reg.add("j26_column_difference", """
        WITH n AS (SELECT p_partkey, name, (p_partkey // i) % 3 AS r FROM part, (VALUES (1, 'name'), (3, 'brand'), (9, 'type'), (27, 'size')) AS v(i, name))
        SELECT p_partkey, CASE r WHEN 0 THEN 'first' ELSE 'second' END AS side, name FROM n WHERE r < 2""")
    def j26(spark, sf):
        names = {1: "name", 3: "brand", 9: "type", 27: "size"}
        kept = lambda lost: F.map_from_entries(F.array_compact(F.array(*[F.when(F.floor(F.col("p_partkey") / i) % 3 != lost, F.struct(F.lit(n).alias("k"), F.lit("v").alias("v"))) for i, n in names.items()])))
        records = table(spark, sf, "part").select("p_partkey", kept(1).alias("csv"), kept(0).alias("json"))
        return governance.column_difference(records, "p_partkey", "csv", "json")

    @reg.add("q1_series_shape", """
        WITH s AS (SELECT o_custkey, count(*) AS n, o_custkey % 5 AS r, list(strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) AS m FROM orders GROUP BY 1)
        SELECT 'missing' AS rule, o_custkey, '' AS detail FROM s WHERE r = 0 OR (r = 1 AND n = 1) UNION ALL SELECT 'length', o_custkey, n || '/' || (n - 1) FROM s WHERE r = 1 AND n > 1
        UNION ALL SELECT 'unsorted', o_custkey, m[n - list_position(list_transform(range(1, n), lambda i: m[n - i + 1] > m[n - i]), true)] FROM s WHERE r = 2 AND m[1] <> m[n]""")
    def q1(spark, sf):
        at = F.struct("o_orderdate", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("m"))
        series = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(at)).alias("o"))  # a customer's orders
        r, months = F.col("o_custkey") % 5, F.col("o.m")
        values = F.when(r == 1, F.slice(months, F.lit(1), F.size(months) - 1)).otherwise(months)
        records = series.select("o_custkey", F.when(r == 0, F.lit(None)).when(r == 2, F.reverse(months)).otherwise(months).alias("months"), values.alias("values"))
        return governance.series_shape(records, "o_custkey", "months", "values")

    @reg.add("q8_dead_branches", """
        WITH c AS (SELECT o_orderpriority AS name, count(*)::BIGINT AS n FROM orders GROUP BY 1), l(name) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('6-NEVER'))
        SELECT coalesce(c.name, l.name) AS name, coalesce(n, 0)::BIGINT AS n, l.name IS NOT NULL AS listed FROM c FULL JOIN l ON c.name = l.name""")
    def q8(spark, sf):
        return governance.dead_branches(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "6-NEVER"])

    @reg.add("x4_source_registry", """
        WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 's' || l_suppkey % 7 AS source_id, 'cat' || l_partkey % 5 || '.c' || l_linenumber AS path, l_suppkey % 7 AS s, l_partkey % 5 AS p FROM lineitem)
        SELECT source_id, path, CASE WHEN s < 6 THEN s % 3 + 1 END::INT AS tier, coalesce(s < 6 AND s % 2 = 0, false) AS auto_fetchable, coalesce(s < 6 AND (p = s OR (p = 4 AND l_linenumber = 2)), false) AS covered, count(*)::BIGINT AS n FROM f GROUP BY ALL""")
    def x4(spark, sf):
        registry = spark.createDataFrame([(f"s{s}", s % 3 + 1, [f"cat{s}", "cat4.c2"], s % 2 == 0) for s in range(6)], "source_id string, tier int, coverage array<string>, auto_fetchable boolean")
        findings = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("source_id"), F.concat(F.lit("cat"), F.col("l_partkey") % 5, F.lit(".c"), "l_linenumber").alias("path"))
        return governance.source_registry(registry, findings, "source_id", "path").groupBy("source_id", "path", "tier", "auto_fetchable", "covered").agg(F.count("*").alias("n"))

    @reg.add("f15_signature", """
        WITH w AS (SELECT p_partkey, string_split(p_name, ' ') || ['pre-' || p_size, CASE WHEN p_partkey % 3 > 0 THEN 'wire' END, CASE WHEN p_partkey % 3 = 1 THEN 'of' END] AS w FROM part)
        SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x IS NOT NULL AND x NOT IN ('the', 'of', 'a')))), ' ') AS tokens FROM w""")
    def f15(spark, sf):
        k = F.col("p_partkey") % 3
        tail = F.when(k == 0, " - The Daily Wire of Record").when(k == 1, "-wire of $").otherwise(" | wire – News, Inc.")
        tail = F.when(k == 1, " wire of $").otherwise(tail)
        headline = F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" of a Pre-"), "p_size", F.lit(","), tail)
        return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(text.signature(headline, STOP, outlets=True)), " ").alias("tokens"))

    @reg.add("p19_variant_changes", """
        SELECT p_partkey, '{"a":{"l":[' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"' || p_brand || '"' END || ',2,{"z":false}],"n":' || CASE p_partkey % 4 WHEN 0 THEN (p_size + 1)::VARCHAR WHEN 1 THEN 'true' WHEN 2 THEN '[' || p_size || ',"x"]' ELSE 'null' END || CASE WHEN p_partkey % 2 = 0 THEN ',"new":{"k":"' || p_name || '"}' ELSE '' END || '}'
          || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ',"t":"' || p_name || '"' END || '}' AS document, p_partkey % 3 = 0 AS was_null FROM part""")
    def p19(spark, sf):
        p, k = table(spark, sf, "part"), F.col("p_partkey")
        brand = F.when(k % 3 == 0, "null").otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"')))
        document = F.concat(F.lit('{"t": "'), "p_name", F.lit('", "a": {"n": '), "p_size", F.lit(', "l": ['), brand, F.lit(', 2, {"z": false}]}}'))
        docs = p.select("p_partkey", F.parse_json(document).alias("d"))
        n = F.when(k % 4 == 0, (F.col("p_size") + 1).cast("string")).when(k % 4 == 1, "true").when(k % 4 == 2, F.concat(F.lit("["), "p_size", F.lit(',"x"]'))).otherwise("null")
        change = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("value"))
        listed = F.array(change("a.n", n), F.when(k % 2 == 0, change("a.new", F.concat(F.lit('{"k": "'), "p_name", F.lit('"}')))), F.when(k % 5 == 0, change("t", F.lit(None).cast("string"))))
        changes = p.select("p_partkey", F.inline(F.array_compact(listed)))
        after = variants.regroup(variants.assign(variants.flatten(docs, "p_partkey", "d"), changes, "p_partkey"), "p_partkey")
        first = variants.get(F.col("d"), "a.l.0")
        return after.join(docs.select("p_partkey", (first["found"] & F.is_variant_null(first["value"])).alias("was_null")), "p_partkey")

    @reg.add("k7_store_merge", """
        SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS value, 3::INT AS version, (SELECT count(*) FILTER (c_custkey % 2 = 1) FROM customer)::BIGINT AS added, (SELECT count(*) FILTER (c_custkey % 3 = 0 AND c_custkey % 2 = 0) FROM customer)::BIGINT AS changed FROM customer""")
    def k7(spark, sf):
        store = Store(spark, f"{shared_place(spark)}/store-{uuid.uuid4().hex}")
        c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("value"))
        twice = lambda rows: rows.groupBy("c_custkey").count().filter("count > 1")
        store.commit({"cells": c.filter("c_custkey % 2 = 0")}, {"cells": twice})
        fresh = c.withColumn("value", F.when(F.col("c_custkey") % 3 == 0, "changed").otherwise(F.col("value")))
        refused = store.commit({"cells": store.read("cells").unionByName(fresh)}, {"cells": twice})  # a merge that keeps both rows of a key
        merged = store.read("cells").join(fresh.select("c_custkey"), "c_custkey", "left_anti").unionByName(fresh)
        done = store.commit({"cells": merged}, {"cells": twice}, key={"cells": ["c_custkey"]})
        store.restore(1)
        last = store.restore(2)
        if refused.committed or last.version != 4:
            raise RuntimeError("the store took what its audit refused")
        counts = done.changes["cells"]
        return store.read("cells").select("c_custkey", "value", F.lit(last.version - 1).alias("version"), F.lit(counts["added"]).cast("long").alias("added"), F.lit(counts["changed"]).cast("long").alias("changed"))
