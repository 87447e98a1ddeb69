"""Which rules touch what a guide cites: citations, amended paragraphs, and the ladder of relevance."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import prose_dates
from ledgerloom.functions.text import keep_lines, strip_html

#: Characters after the last instruction of a rule in which its paragraphs are sought.
LAST_BLOCK = 2500


def phrases(words: tuple[str, ...]) -> str:
    """A pattern of whole words and phrases in any case; a `*` at an end stands for any letters."""
    one = lambda w: r"\s+".join(re.escape(part).replace(r"\*", r"\w*") for part in w.split())
    return r"(?i)(?<!\w)(" + "|".join(one(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")(?!\w)"


@dataclass(frozen=True)
class Subjects:
    """Phrases of a rule's title: strong ones are in scope, weak ones only without a rival, outside ones speak of something else."""

    strong: tuple[str, ...]
    weak: tuple[str, ...] = ()
    outside: tuple[str, ...] = ()


def citations(text: Column) -> Column:
    """Distinct (title, section, paragraph) of all '8 CFR 214.2(h)(4)'; the paragraph is the first one or null."""
    pattern = r"(?i)\b(\d+)\s+C\.?F\.?R\.?\s+(?:§+\s*)?(\d+[a-z]?\.\d+[a-z]?)(?:\(([a-z0-9]+)\))?"
    part = lambda m, i: F.regexp_extract(m, pattern, i)
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(every, lambda m: F.struct(part(m, 1).alias("title"), part(m, 2).alias("section"), F.nullif(part(m, 3), F.lit("")).alias("paragraph"))))


def amended(text: Column) -> Column:
    """(section, paragraphs) of each amending instruction: 'Amend Sec. 214.1', 'Section 214.2 is amended' (D18, W11).

    An instruction's paragraphs are sought up to the next one, the last one's in LAST_BLOCK characters.
    """
    number, sign = r"(\d{2,3}[a-z]?\.\d+[a-z]?)", r"(?:section|sec\.?|§+)\s*"
    instruction = rf"(?i)\b(?:(?:amend|revis|add)[a-z]*\s+{sign}{number}|{sign}{number}\s+(?:is|are)\s+(?:amended|revised|added))"
    # Only what is not a single space is replaced, as most white space is.
    plain = F.regexp_replace(text, r"\s{2,}|[^\S ]", " ")
    # One mark before each instruction, with its section, of which either place in the pattern holds one.
    blocks = F.slice(F.split(F.regexp_replace(plain, instruction, "\x01$1$2\x02"), "\x01"), 2, 1 << 30)
    body = lambda b: F.substring_index(b, "\x02", -1)
    lists = lambda b: F.regexp_extract_all(b, F.lit(r"(?i)\bparagraphs?((?:\s*(?:,|and|or)?\s*\([a-z0-9]+\))+)"), F.lit(1))
    letters = lambda b: F.array_distinct(F.regexp_extract_all(F.array_join(lists(b), " "), F.lit(r"\(([a-z0-9]+)\)"), F.lit(1)))

    def found(own: Column) -> Column:
        last = lambda b, i: F.when(i == F.size(own) - 1, F.substring(body(b), 1, LAST_BLOCK)).otherwise(body(b))
        return F.transform(own, lambda b, i: F.struct(F.substring_index(b, "\x02", 1).alias("section"), letters(last(b, i)).alias("paragraphs")))

    # The blocks are named by the outer function; written out in the inner one, they would be made again for each of them.
    return F.get(F.transform(F.array(blocks), found), F.lit(0))


def markers(text: Column, words: tuple[str, ...]) -> Column:
    """Distinct phrases that a text holds, lower-cased and sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(phrases(words)), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def relevance(rules: DataFrame, cited: DataFrame, key: str, subjects: Subjects, cfr_title: str = "8") -> DataFrame:
    """severity and rung (1 to 6) of each rule, by key (D19, RC9). Never drops one: the least is WATCH.

    rules: key, title, body; cited: title, section, paragraph of the guide's own citations. The amended sections and
    paragraphs are exploded and meet the citations in equi-joins: exact paragraphs first, then sections.
    """
    rules = rules.select(F.col(key).alias("key"), "title", amended(F.col("body")).alias("amended"))
    own = cited.filter(F.col("title") == cfr_title).select("section", "paragraph").distinct()
    sections = rules.select("key", F.explode("amended").alias("a")).select("key", "a.section", "a.paragraphs")
    pairs = sections.select("key", "section", F.explode("paragraphs").alias("paragraph")).distinct()
    exact = pairs.join(own, ["section", "paragraph"], "left_semi").groupBy("key").agg(F.count("*").alias("exact"))
    near = sections.select("key", "section").distinct().join(own.select("section").distinct(), "section", "left_semi").groupBy("key").agg(F.count("*").alias("near"))
    judged = rules.join(exact, "key", "left").join(near, "key", "left")
    of_title = lambda words: F.coalesce(F.col("title").rlike(phrases(words)), F.lit(False)) if words else F.lit(False)
    outside, strong, weak = map(of_title, (subjects.outside, subjects.strong, subjects.weak))
    inside = strong | (weak & ~outside)
    rungs = [(outside & ~inside, "WATCH"), (F.col("exact") > 0, "ACTION"), (inside, "ACTION"), (F.col("near") > 0, "ACTION"), (F.size("amended") == 0, "ACTION")]
    severity, rung = F.lit("WATCH"), F.lit(6)
    for n, (test, level) in reversed(list(enumerate(rungs, 1))):
        test = F.coalesce(test, F.lit(False))
        severity, rung = F.when(test, level).otherwise(severity), F.when(test, n).otherwise(rung)
    return judged.select(F.col("key").alias(key), severity.alias("severity"), rung.alias("rung"))


def entry_severity(descriptions: Column, ruling: tuple[str, ...]) -> Column:
    """ACTION if some new entry holds one of the words of rulings, else WATCH."""
    return F.when(F.exists(descriptions, lambda d: d.rlike(phrases(ruling))), "ACTION").otherwise("WATCH")


@dataclass(frozen=True)
class Prong:
    """A test of a decision: the phrases that name it, and how many characters may lie between the finding and the name."""

    digit: int
    names: tuple[str, ...]
    gap: int


def _unmet(text: Column, findings: tuple[str, ...], prong: Prong) -> Column:
    """Whether in some sentence a finding comes first and the prong's name within the gap behind it."""
    pattern = phrases(findings) + rf".{{0,{prong.gap}}}?" + phrases(prong.names).removeprefix("(?i)")
    return F.exists(F.split(text, "[.]"), lambda sentence: sentence.rlike(pattern))


def prongs_failed(text: Column, findings: tuple[str, ...], prongs: tuple[Prong, ...]) -> Column:
    """Digits of the prongs a decision found unmet; tight on purpose, a miss is better than a false hit."""
    return F.concat(*[F.when(_unmet(text, findings, p), str(p.digit)).otherwise("") for p in prongs])


def stopped_early(text: Column, refusals: tuple[str, ...], rest: tuple[str, ...], gap: int = 200) -> Column:
    """Whether a decision refuses in a sentence to go on to the rest."""
    return F.coalesce(_unmet(text, refusals, Prong(0, rest, gap)), F.lit(False))


def regions(pages: DataFrame, key: str, html: str, flag: str, levels: str, anchors: tuple[str, ...]) -> DataFrame:
    """Dates of a page by region: key, in_flag, kind, anchor, line, date.

    A region is a flag block or the prose between flags and anchors. flag: the class of flag blocks, levels: the beginning of the
    class that says their kind; anchors: the beginnings of ids that mark a place. A region's anchor is the last one before it, its line
    that of its first character, scripts and styles counted by their line breaks. Regions without a date give no row.
    """
    name, kinds = re.escape(flag), re.escape(levels)
    ids = "(?:" + "|".join(map(re.escape, anchors)) + ")"
    block, place = rf"<div\b[^>]*\bclass=\"{name} ({kinds}[\w-]+)\"[^>]*>", rf"<[a-z][^<>]*\bid=\"({ids}[\w-]+)\"[^<>]*>"
    marked = F.regexp_replace(keep_lines(F.col(html)), rf"(?s)({block}.*?</div>)", "\x01$1\x01")
    marked = F.regexp_replace(marked, f"({place})", "\x01$1")
    parts = pages.select(F.col(key).alias("key"), F.posexplode(F.split(marked, "\x01")).alias("at", "part"))
    so_far = lambda stop: Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, stop)
    breaks = F.regexp_count("part", F.lit("\n"))
    first = lambda pattern: F.nullif(F.regexp_extract("part", "^" + pattern, 1), F.lit(""))
    placed = parts.select("key", "at", "part", (F.coalesce(F.sum(breaks).over(so_far(-1)), F.lit(0)) + 1).cast("int").alias("line"), F.last(first(place), True).over(so_far(Window.currentRow)).alias("anchor"), first(block).alias("kind"))
    dated = placed.withColumn("d", F.explode(prose_dates(strip_html(F.col("part")))))
    return dated.select(F.col("key").alias(key), F.col("kind").isNotNull().alias("in_flag"), "kind", "anchor", "line", F.col("d.date").alias("date"))
