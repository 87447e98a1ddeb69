"""Queries over pages and workbooks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.plans.registry import Registry
from ledgerloom.session import shared_place, table
from ledgerloom.sources import markup, readers, workbook


def part_workbooks(spark, sf) -> str:
    """The part table as workbooks in the shared folder, whose name is returned."""
    folder = f"{shared_place(spark)}/workbooks-{uuid.uuid4().hex}"
    workbook.write_workbooks(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), folder, 700).collect()  # a row a file
    return folder


def register(reg: Registry) -> None:
    @reg.add("s14_nested_tables", """
        WITH p AS (SELECT page_id, regexp_replace(trim(url), '\\s+', ' ', 'g') AS url FROM pages)
        SELECT page_id, 0 AS "table", 'T & ' || page_id AS caption, 0 AS row, 'id|url' AS cells, NULL::INT AS parent FROM p
        UNION ALL SELECT page_id, 0, 'T & ' || page_id, 1, page_id || '|' || url || CASE page_id % 4 WHEN 0 THEN chr(10) || 'in ' || page_id * 2 WHEN 1 THEN '' WHEN 2 THEN chr(10) || 'line' ELSE chr(10) || 'out' || chr(10) || 'a b' || chr(10) || 'deep ' || page_id END, NULL FROM p
        UNION ALL SELECT page_id, 1, '', 0, 'in|' || page_id * 2, 0 FROM p WHERE page_id % 4 = 0
        UNION ALL SELECT page_id, 1, 'out', 0, 'a|b' || chr(10) || 'deep ' || page_id, 0 FROM p WHERE page_id % 4 = 3 UNION ALL SELECT page_id, 2, '', 0, 'deep|' || page_id, 1 FROM p WHERE page_id % 4 = 3""")
    def s14(spark, sf):
        k, page = F.col("page_id"), table(spark, sf, "pages")
        deep = F.concat(F.lit("<table><caption>out</caption><tbody><tr><td>a<td>b<table><tr><td>deep<td>"), k, F.lit("</table></tbody></table>"))
        inner = F.when(k % 4 == 0, F.concat(F.lit("<table><tr><td>in</td><td>"), k * 2, F.lit("</td></tr></table>"))).when(k % 4 == 1, "<!-- <td>no</td></tr> -->").when(k % 4 == 2, "<br>line").otherwise(deep)
        planted = F.concat(F.lit("<TABLE class='x>y'><caption>T &amp; "), k, F.lit("</caption><tr><th>id<th>url<tr><td>"), k, F.lit("<td>"), F.replace("url", F.lit("&"), F.lit("&amp;")), inner, F.lit("</td></tr></TABLE><footer>"))
        whole = page.select("page_id", F.replace("html", F.lit("<footer>"), planted).alias("html"))
        return markup.html_tables(whole, "page_id", "html").select("page_id", "table", "caption", "row", F.array_join("cells", "|").alias("cells"), "parent")

    @reg.add("s16_page_links", """
        WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<nav>.*?</nav>', 0) AS nav FROM pages),
        l AS (SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs, regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM n),
        e AS (SELECT page_id, unnest(hrefs) AS href, unnest(texts) AS text, generate_subscripts(hrefs, 1) - 1 AS place FROM l)
        SELECT page_id, place::INT AS place, replace(href, '&amp;', '&') AS href, replace(text, '&amp;', '&') AS text FROM e""")
    def s16(spark, sf):
        return markup.page_links(table(spark, sf, "pages"), "page_id", "html").filter("path = 'html/body/nav/ul/li'").select("page_id", F.col("at").alias("place"), "href", "text")

    @reg.add("s12_workbook_rows", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part")
    def s12(spark, sf):
        return readers.named_rows(workbook.workbook_sheets(spark, part_workbooks(spark, sf)), ["p_partkey", "p_name", "p_size"]).select("p_partkey", "p_name", "p_size")

    @reg.add("q7_dual_reader", "SELECT count(*)::BIGINT AS parts, 0::BIGINT AS only_streaming, 0::BIGINT AS only_whole FROM part")
    def q7(spark, sf):
        folder = part_workbooks(spark, sf)
        each = lambda cells, n: cells.select("file", "sheet", "row", "cells", F.lit(n).alias("reader"))
        both = each(workbook.workbook_sheets(spark, folder), 1).unionByName(each(readers.workbooks(spark, folder), -1))
        # A row that both read adds up to nothing.
        rows = both.groupBy("file", "sheet", "row", "cells").agg(F.sum("reader").alias("d"))
        return rows.agg(F.count_if((F.col("row") > 1) & (F.col("d") == 0)).alias("parts"), F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_streaming"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_whole"))
