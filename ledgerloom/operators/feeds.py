"""Feeds and mail: entries become items through scope, recency and class; every drop has a reason that is counted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicons, text

ITEM = ("id", "headline", "url", "source_id", "published", "category", "topic", "summary", "importance", "affects_facts", "confidence", "tier")


@dataclass(frozen=True)
class Rules:
    """Lexicons of a feed run: patterns of the categories, generic patterns, phrases that count only beside a context word
    (P13), ordered topics, terms of importance, and the words that touch facts."""

    categories: dict[str, str]
    generic: str
    topics: list[tuple[str, list[str]]]
    high: list[str]
    medium: list[str]
    facts: str
    phrase: str = ""
    context: str = ""
    fine: list[tuple[str, str]] = field(default_factory=list)


def together(body: Column, phrase: str, context: str) -> Column:
    """A phrase counts only if a context word stands in the same text."""
    return lexicons.any_match(body, phrase) & lexicons.any_match(body, context) if phrase else F.lit(False)


def category(body: Column, rules: Rules) -> Column:
    """RC15: one specific category, else cross-cutting, else null for out of scope."""
    specific = {name: lexicons.any_match(body, p) for name, p in rules.categories.items()}
    return lexicons.category(specific, lexicons.any_match(body, rules.generic) | together(body, rules.phrase, rules.context))


def topic(body: Column, topics: list[tuple[str, list[str]]], default: str = "policy") -> Column:
    """The first topic one of whose terms the text holds, in any case."""
    low, out = F.lower(F.coalesce(body, F.lit(""))), F.lit(default)
    for name, terms in reversed(topics):
        out = F.when(_any_term(low, terms), name).otherwise(out)
    return out


def _any_term(low: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(low, F.lit(t))
    return found


def importance(body: Column, rules: Rules, binding: Column | None = None) -> Column:
    """high for binding kinds and high terms, medium by terms, else low."""
    low = F.lower(F.coalesce(body, F.lit("")))
    high = _any_term(low, rules.high) if binding is None else binding | _any_term(low, rules.high)
    return F.when(high, "high").when(_any_term(low, rules.medium), "medium").otherwise("low")


def affects_facts(body: Column, tier: Column, in_scope: Column, rules: Rules) -> Column:
    """Only an official source in scope that names a fact."""
    return F.coalesce((tier == 1) & in_scope & lexicons.any_match(body, rules.facts), F.lit(False))


def fine_topic(body: Column, rules: Rules) -> Column:
    """The first fine label that matches, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules.fine):
        out = F.when(lexicons.any_match(body, pattern), name).otherwise(out)
    return out


def relevant(body: Column, rules: Rules, permissive: str, token: str, strict: Column) -> Column:
    """In scope or in the looser vocabulary; for strict sources a real token must stand there too."""
    loose = category(body, rules).isNotNull() | lexicons.any_match(body, permissive)
    return loose & (~strict | lexicons.any_match(body, token))


def recency(published: Column, as_of: str, max_days: int) -> Column:
    """Why an entry's date keeps it out: no_date, stale, future; null keeps it (P10)."""
    age = F.datediff(F.lit(as_of).cast("date"), published)
    return F.when(published.isNull(), "no_date").when(age > max_days, "stale").when(age < 0, "future")


def item(headline: Column, url: Column, source: Column, published: Column, kind: Column, topic: Column, summary: Column, importance: Column, affects: Column, confidence: Column, tier: Column) -> list[Column]:
    """Columns of an item in fixed order; its id is made of source, headline and date."""
    ident = text.stable_id(source, text.norm(F.lower(headline)), F.coalesce(published.cast("string"), F.lit("")))
    return [c.alias(n) for n, c in zip(ITEM, (ident, headline, F.coalesce(url, F.lit("")), source, published, kind, topic, F.substring(summary, 1, 600), importance, affects, confidence, tier))]


def feed_items(entries: DataFrame, rules: Rules, as_of: str, max_days: int = 45) -> DataFrame:
    """Entries (title, url, published, source_id, publisher, tier) with `dropped`, the first gate that keeps one out, and ITEM.

    Gates in order: no_title, scope, then recency (S31). An aggregator's entries, which name their publisher, are shown under
    it. Dropped entries stay as rows, so the run's counters come from the same table.
    """
    title = F.coalesce(F.trim(F.col("title")), F.lit(""))
    kind = category(title, rules)
    dropped = F.when(title == "", "no_title").when(kind.isNull(), "scope").otherwise(recency(F.col("published"), as_of, max_days))
    shown = F.coalesce(F.when(F.trim("publisher") != "", F.trim("publisher")), F.col("source_id"))
    tier = F.col("tier")
    confidence = F.when(tier == 1, "high").when(tier == 2, "medium").otherwise("low")
    return entries.select(F.col("source_id").alias("feed"), dropped.alias("dropped"), *item(title, F.col("url"), shown, F.col("published"), kind, topic(title, rules.topics), title, importance(title, rules), affects_facts(title, tier, kind.isNotNull(), rules), confidence, tier))


def community_items(entries: DataFrame, registry: DataFrame, rules: Rules, permissive: str, token: str, as_of: str, max_days: int = 45) -> DataFrame:
    """Posts (title, url, published, source_id, at) of registered sources (source_id, strict, defaults) with `dropped` and ITEM.

    Gates in order: relevance by the source's strictness, recency, then ids seen before (the earliest `at` stays). All are
    low tier and never touch facts; the category is cross-cutting where the scope finds none; labels are the source's
    defaults and the fine topic.
    """
    posts = entries.join(registry, "source_id")
    title = F.coalesce(F.trim(F.col("title")), F.lit(""))
    kind = F.coalesce(category(title, rules), F.lit("cross-cutting"))
    gate = F.when(title == "", "no_title").when(~relevant(title, rules, permissive, token, F.col("strict")), "relevance").otherwise(recency(F.col("published"), as_of, max_days))
    labels = F.array_distinct(F.concat("defaults", F.array_compact(F.array(fine_topic(title, rules)))))
    labels = F.when(F.size(labels) == 0, F.array(F.lit("general"))).otherwise(labels)
    source = F.concat(F.lit("community-"), F.lower("source_id"))
    made = posts.select(F.col("source_id").alias("feed"), "at", gate.alias("gate"), labels.alias("labels"), *item(title, F.col("url"), source, F.col("published"), kind, topic(title, rules.topics), title, F.lit("low"), F.lit(False), F.lit("low"), F.lit(3)))
    again = F.row_number().over(Window.partitionBy("id", F.col("gate").isNull()).orderBy("at")) > 1
    return made.withColumn("dropped", F.coalesce(F.col("gate"), F.when(again, "seen"))).drop("gate", "at")


def run_counters(items: DataFrame) -> DataFrame:
    """feed, fetched, kept, and what each gate dropped."""
    reasons = ("no_title", "scope", "relevance", "no_date", "stale", "future", "seen", "unknown-sender", "out-of-scope")
    return items.groupBy("feed").agg(F.count("*").alias("fetched"), F.count_if(F.col("dropped").isNull()).alias("kept"), *[F.count_if(F.col("dropped") == r).alias(r.replace("-", "_")) for r in reasons])


def sender(header: Column, senders: list[tuple[str, str, int]], known: list[str], default: tuple[str, int]) -> Column:
    """source_id and tier of a From header by the first listed token; null for senders not allowed, the default for allowed
    ones without a rule (P31)."""
    low = F.lower(F.coalesce(header, F.lit("")))
    out = F.struct(F.lit(default[0]).alias("source_id"), F.lit(default[1]).alias("tier"))
    for token, source, tier in reversed(senders):
        out = F.when(F.contains(low, F.lit(token)), F.struct(F.lit(source).alias("source_id"), F.lit(tier).alias("tier"))).otherwise(out)
    return F.when(_any_term(low, known), out)


def mail_items(messages: DataFrame, rules: Rules, senders: list[tuple[str, str, int]], known: list[str], default: tuple[str, int] = ("official", 1)) -> DataFrame:
    """Messages (message_id, sender, subject, published, body, links) with `dropped` and ITEM.

    Unknown senders go first, then what subject and body show to be out of scope. Confidence follows the tier; the summary is
    the first two sentences, or the subject.
    """
    who = sender(F.col("sender"), senders, known, default)
    whole = F.concat_ws("\n", "subject", "body")
    kind = category(whole, rules)
    dropped = F.when(who.isNull(), "unknown-sender").when(kind.isNull(), "out-of-scope")
    summary = text.sentences(text.norm(F.coalesce("body", F.lit(""))), 2)
    tier = who["tier"]
    made = item(F.coalesce(F.when(F.trim("subject") != "", F.trim("subject")), F.lit("(no subject)")), text.first_link(F.coalesce("links", F.array().cast("array<string>"))), who["source_id"], F.col("published"), kind, topic(whole, rules.topics), F.when(summary != "", summary).otherwise(F.col("subject")), importance(whole, rules), affects_facts(whole, tier, kind.isNotNull(), rules), F.when(tier == 1, "high").otherwise("medium"), tier)
    return messages.select("message_id", F.coalesce(who["source_id"], F.lit("unknown")).alias("feed"), dropped.alias("dropped"), *made)


def fact_findings(items: DataFrame, paths: list[tuple[str, str]], fee_path: str, default: str) -> DataFrame:
    """Findings for a human from the items that touch facts: id, path by topic, no value, confidence low."""
    path = F.when(F.contains(F.lower(F.concat_ws(" ", "headline", "summary")), F.lit("fee")), fee_path).otherwise(default)
    for name, where in reversed(paths):
        path = F.when(F.col("topic") == name, where).otherwise(path)
    return items.filter(F.col("dropped").isNull() & F.col("affects_facts")).select("id", path.alias("path"), F.lit(None).cast("string").alias("found"), F.lit("low").alias("confidence"), "tier")


def representative(items: DataFrame, cluster: str, named: Column) -> DataFrame:
    """One item a cluster: of the best tier, then named, then the newest, then by id; with the number of others."""
    order = Window.partitionBy(cluster).orderBy(F.col("tier"), named.desc(), F.col("published").desc_nulls_last(), "id")
    size = F.count("*").over(Window.partitionBy(cluster))
    return items.withColumn("place", F.row_number().over(order)).withColumn("others", size - 1).filter("place = 1").drop("place")
