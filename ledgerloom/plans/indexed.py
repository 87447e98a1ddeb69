"""Queries through an index or one automaton: many searches at once, many word lists in a pass."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import onepass
from ledgerloom.operators.search import SearchIndex
from ledgerloom.plans.registry import Registry
from ledgerloom.session import shared_place, table

LISTS = onepass.Lexicons({"english": [("article", "the"), ("article", "a"), ("and", "and"), ("or", "or")], "german": ["und", "der", "*keit"], "stems": [("inter", "in*"), ("con", "con*"), ("ing", "*ing")]})
# The same lists for words of a text, a condition for each label.
WORDS = {
    "english": {"article": "x IN ('the', 'a')", "and": "x = 'and'", "or": "x = 'or'"},
    "german": {"und": "x = 'und'", "der": "x = 'der'", "*keit": "ends_with(x, 'keit')"},
    "stems": {"inter": "starts_with(x, 'in')", "con": "starts_with(x, 'con')", "ing": "ends_with(x, 'ing')"},
}

# A word may hold a beginning and an end side by side, but not one inside the other.
TWICE = """coalesce(list_sum(list_transform(w, lambda x: (starts_with(x, 'in') OR starts_with(x, 'con'))::INT + (ends_with(x, 'ing') AND NOT (starts_with(x, 'in') AND length(x) < 5) AND NOT (starts_with(x, 'con') AND length(x) < 6))::INT)), 0)"""


def found_sql() -> str:
    """Columns of each list: n_<list> and labels_<list>, from the words of documents."""
    columns = []
    for name, tests in WORDS.items():
        count = " OR ".join(tests.values())
        number = f"len(list_filter(w, lambda x: {count}))" if name != "stems" else TWICE
        labels = ", ".join(f"CASE WHEN len(list_filter(w, lambda x: {t})) > 0 THEN '{label}' END" for label, t in tests.items())
        columns.append(f"{number}::INT AS n_{name}, list_filter([{labels}], lambda x: x IS NOT NULL) AS labels_{name}")
    return f"d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), f AS (SELECT doc_id, {', '.join(columns)} FROM d)"


def register(reg: Registry) -> None:
    flat = lambda c: f"regexp_replace({c}, '[^a-z0-9]+', '', 'g')"

    @reg.add("o5_many_searches", f"""
        WITH e AS (SELECT page_id AS id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t, lower(url) AS s, lower(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)) AS b, page_id % 5 = 0 AS q FROM pages),
        f AS (SELECT *, {flat('t')} AS ft, {flat('s')} AS fs, {flat('b')} AS fb, regexp_extract_all(t, '[a-z0-9-]+') AS ws FROM e),
        a AS (SELECT id AS query, list_filter([left(ws[1], 5), ws[2], right(ws[3], 3)], lambda x: x IS NOT NULL AND x <> '') AS tokens FROM f WHERE id % 10 = 0),
        x AS (SELECT query, tokens, f.*, unnest(tokens) AS w FROM a CROSS JOIN f),
        y AS (SELECT *, CASE WHEN instr(t, w) = 1 THEN 26 WHEN instr(t, w) > 1 THEN 18 ELSE 0 END + CASE WHEN contains(s, w) THEN 6 ELSE 0 END AS plain, contains(b, w) AS inside, CASE WHEN instr(ft, w) = 1 THEN 22 WHEN instr(ft, w) > 1 THEN 16 WHEN contains(fs, w) THEN 5 ELSE 0 END AS flat FROM x),
        z AS (SELECT *, CASE WHEN plain = 0 AND NOT inside THEN flat ELSE plain END AS own, plain = 0 AND NOT inside AND flat = 0 AND contains(fb, w) AS late FROM y),
        g AS (SELECT query, id, any_value(array_to_string(tokens, ' ')) AS phrase, any_value(t) AS t, any_value(ft) AS ft, any_value(q) AS q, sum(own) AS points, sum(CASE WHEN inside THEN 4 WHEN late THEN 3 ELSE 0 END) AS body, sum((own > 0 OR inside OR late)::INT) AS hits, count(*) AS n FROM z GROUP BY query, id),
        r AS (SELECT query, id, (CASE WHEN length(phrase) <= 2 THEN 0 WHEN contains(t, phrase) THEN 60 WHEN contains(ft, replace(phrase, ' ', '')) THEN 52 ELSE 0 END + points + least(body, 12) + round(22.0 * hits / n) + CASE WHEN q THEN 5 ELSE 0 END)::INT AS score FROM g WHERE hits > 0)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank, id, score FROM r QUALIFY rank <= 12""")
    def o5(spark, sf):
        html = F.col("html")
        entries = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.col("url").alias("section"), F.regexp_extract(html, '<div class="ad">([^<]*)</div>', 1).alias("body"), (F.col("page_id") % 5 == 0).alias("question"))
        index = SearchIndex.build(entries, f"{shared_place(spark)}/index-{uuid.uuid4().hex}")
        words = F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9-]+"), F.lit(0))
        tokens = F.array(F.substring(F.get(words, F.lit(0)), 1, 5), F.get(words, F.lit(1)), F.right(F.get(words, F.lit(2)), F.lit(3)))
        asked = entries.filter("id % 10 = 0").select(F.col("id").alias("query"), F.filter(tokens, lambda t: t.isNotNull() & (t != "")).alias("tokens"))  # searches, against all entries
        return index.search(asked)

    @reg.add("p5_one_pass", f"""
        WITH {found_sql()} SELECT doc_id, n_english, n_german, n_stems, array_to_string(labels_english, ',') AS english, array_to_string(labels_german, ',') AS german, array_to_string(labels_stems, ',') AS stems FROM f""")
    def p5(spark, sf):
        found = table(spark, sf, "documents").select("doc_id", onepass.scan(F.col("text"), LISTS).alias("f"))
        return found.select("doc_id", *[F.col(f"f.{n}.n").alias(f"n_{n}") for n in WORDS], *[F.array_join(f"f.{n}.labels", ",").alias(n) for n in WORDS])

    @reg.add("d15_one_pass_rules", f"""
        WITH {found_sql()}
        SELECT doc_id, labels_english[1] AS first, CASE WHEN len(labels_german) = 1 THEN labels_german[1] WHEN len(labels_german) > 1 OR n_stems > 0 THEN 'cross-cutting' END AS category, coalesce(labels_stems[1], 'policy') AS topic,
          CASE WHEN n_german > 3 OR n_english > 0 THEN 'high' WHEN n_stems > 0 THEN 'medium' ELSE 'low' END AS importance,
          CASE WHEN len(l) = 0 THEN 'general' ELSE array_to_string(l, ',') END AS labels
        FROM (SELECT *, list_filter([CASE WHEN doc_id % 4 = 0 THEN 'base' END, CASE WHEN list_contains(labels_german, 'der') THEN 'der' END, CASE WHEN list_contains(labels_german, '*keit') AND n_stems > 0 THEN '*keit' END], lambda x: x IS NOT NULL) AS l FROM f)""")
    def d15(spark, sf):
        found = table(spark, sf, "documents").select("doc_id", onepass.scan(F.col("text"), LISTS).alias("f"))
        english, german, stems = (F.col(f"f.{n}") for n in WORDS)
        labels = onepass.taxonomy(german, ["base", "der", "*keit"], F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("base"))), {"*keit": onepass.flag(stems)})
        return found.select(
            "doc_id", onepass.first_label(english).alias("first"), onepass.one_category(german, onepass.flag(stems)).alias("category"), onepass.topic(stems).alias("topic"),
            onepass.importance(german["n"] > 3, english, stems).alias("importance"), F.array_join(labels, ",").alias("labels"),
        )
