"""Ranked search through posting lists of letter grams.

An entry's text is found wherever a token stands in it, also inside words and over signs that folding takes away. So the lists are
those of its runs of one, two and three letters, plain and folded: what holds a token holds all runs of the token. For each
token the list of its rarest run is read, and the entries on these lists are scored by the rule itself; any other entry has no hit and
scores nothing. The index is built once; a search reads the lists of its tokens and the entries on them.

Very many searches at once would meet nearly all entries on their lists, a row for each pair. Beyond as many rows on the lists as there are
entries, all entries are read once instead: slices of them look up their own substrings among the tokens, and each slice gives the best of
each search only, so nothing that is moved grows with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import held

#: Folders that the lists are dealt to, so that a search opens those of its runs only.
BUCKETS = 64
#: Runs of a search that are named to the reader of the lists; more are left to the join.
MOST_NAMED, FEW = 20_000, 200
#: Entries of a slice at least, slices without need, entries of a slice at most, and searches of a slice at most.
LEAST_SLICE, SLICES, MOST_SLICE, MOST_ASKED = 2_000, 32, 50_000, 50_000
FIELDS = ("title", "section", "body", "flat_title", "flat_section", "flat_body")


def folded(text: Column) -> Column:
    """Small letters and digits alone."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def runs(text: Column, length: int) -> Column:
    """Runs of so many characters of a text, none over a line end."""
    last = F.length(text) - length + 1
    every = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(length)))).otherwise(F.array().cast("array<string>"))
    return F.filter(every, lambda g: ~F.contains(g, F.lit("\n")))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def score_of(tokens: Column) -> Column:
    """The score of the entry beside a list of tokens (F20, RC12), in the columns of FIELDS and `question`."""
    title, section, body, flat_title, flat_section, flat_body = map(F.col, FIELDS)
    phrase = F.array_join(tokens, " ")
    bonus = F.when(F.length(phrase) <= 2, 0).when(F.contains(title, phrase), 60).when(F.contains(flat_title, F.replace(phrase, F.lit(" "), F.lit(""))), 52).otherwise(0)

    def points(t: Column) -> Column:
        at, place = F.instr(title, t), F.instr(flat_title, t)
        plain = F.when(at == 1, 26).when(at > 1, 18).otherwise(0) + F.when(F.contains(section, t), 6).otherwise(0)
        in_body = F.contains(body, t)
        flat = F.when(place == 1, 22).when(place > 1, 16).when(F.contains(flat_section, t), 5).otherwise(0)
        late = F.when((plain == 0) & ~in_body & (flat == 0) & F.contains(flat_body, t), 3).otherwise(0)
        own = F.when((plain == 0) & ~in_body, flat).otherwise(plain)
        return F.struct(own.alias("points"), (F.when(in_body, 4).otherwise(0) + late).alias("body"), ((own > 0) | in_body | (late > 0)).cast("int").alias("hit"))

    none = F.struct(F.lit(0).alias("points"), F.lit(0).alias("body"), F.lit(0).alias("hit"))
    total = F.aggregate(F.transform(tokens, points), none, lambda a, p: F.struct((a["points"] + p["points"]).alias("points"), (a["body"] + p["body"]).alias("body"), (a["hit"] + p["hit"]).alias("hit")))
    scored = F.transform(F.array(total), lambda s: F.when(s["hit"] == 0, 0).otherwise(bonus + s["points"] + F.least(s["body"], F.lit(12)) + F.round(22 * s["hit"] / F.size(tokens)).cast("int") + F.when(F.col("question"), 5).otherwise(0)))
    return F.get(scored, F.lit(0)).cast("int")


def _stand_in(text: str, tokens: set[str], lengths: list[int]) -> set[str]:
    """The tokens that stand in a text."""
    return {t for n in lengths if n <= len(text) for t in (text[i : i + n] for i in range(len(text) - n + 1)) if t in tokens}


def _points(token: str, found: tuple[set[str], ...], fields: tuple[str, ...]) -> tuple[int, int]:
    """A token's points and body points in an entry that holds it, as in score_of; either is more than 0."""
    title, section, body, flat_title, flat_section, _ = (token in f for f in found)
    own = (26 if fields[0].startswith(token) else 18 if title else 0) + (6 if section else 0)
    if own or body:
        return own, 4 if body else 0
    flat = 22 if fields[3].startswith(token) else 16 if flat_title else 5 if flat_section else 0
    return flat, 0 if flat else 3


def _hits(fields: Iterable[tuple[str, ...]], tokens: set[str]) -> dict[str, np.ndarray]:
    """By token: place, points and body points of the entries that hold it."""
    lengths, by = sorted({len(t) for t in tokens}), {}
    for place, own in enumerate(fields):
        found = tuple(_stand_in(f, tokens, lengths) for f in own)
        for token in set().union(*found):
            by.setdefault(token, []).append((place, *_points(token, found, own)))
    return {token: np.array(rows, np.int32).T for token, rows in by.items()}


def _phrases(texts: Iterable[str], phrases: set[str]) -> dict[str, list[int]]:
    """By phrase: places of the texts that hold it."""
    lengths, by = sorted({len(p) for p in phrases}), {}
    for place, text in enumerate(texts):
        for phrase in _stand_in(text, phrases, lengths):
            by.setdefault(phrase, []).append(place)
    return by


def _best_of_slice(top: int):
    """From a slice of entries and one of searches (search, tokens) to the best `top` entries of each: search, id, score."""

    def best(entries: pd.DataFrame, searches: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values("id")
        ids, n, asked = entries["id"].to_numpy(), len(entries), [[*map(str, t)] for t in searches["tokens"]]
        hits = _hits(zip(*(entries[c] for c in FIELDS)), {t for own in asked for t in own})
        phrases = [" ".join(own) for own in asked]
        titled = _phrases(entries["title"], {p for p in phrases if len(p) > 2})
        joined = _phrases(entries["flat_title"], {p.replace(" ", "") for p in phrases if len(p) > 2})
        more, late = 5 * entries["question"].to_numpy(np.int64), np.arange(n)[::-1]
        out = []
        for search, own, phrase in zip(searches["search"], asked, phrases):
            rows = [hits[t] for t in own if t in hits]
            if not rows:
                continue
            points, body, hit = np.zeros((3, n), np.int64)
            for place, p, b in rows:
                points[place] += p
                body[place] += b
                hit[place] += 1
            if len(phrase) > 2:
                bonus = np.zeros(n, np.int64)
                bonus[joined.get(phrase.replace(" ", ""), [])] = 52
                bonus[titled.get(phrase, [])] = 60
                points += bonus
            score = points + np.minimum(body, 12) + (44 * hit + len(own)) // (2 * len(own)) + more
            at = np.flatnonzero(hit)
            order = score[at] * n + late[at]  # the better score, then the smaller id
            at = at[np.argpartition(order, len(at) - top)[-top:]] if len(at) > top else at
            out.append(pd.DataFrame({"search": search, "id": ids[at], "score": score[at]}))
        return pd.concat(out) if out else pd.DataFrame({"search": [], "id": [], "score": []})

    return best


@dataclass(frozen=True)
class SearchIndex:
    """An index in a folder of any file system that Spark reads: entries by id, lists of ids by run, and the lists' lengths."""

    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, entries: DataFrame, folder: str, key: str = "id", title: str = "title", section: str = "section", body: str = "body", question: str = "question") -> SearchIndex:
        """Writes the index of entries; one in the folder is replaced. Null fields are empty; ids are distinct."""
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        plain = entries.select(F.col(key).cast("long").alias("id"), *[F.lower(text(c)).alias(n) for c, n in ((title, "title"), (section, "section"), (body, "body"))], F.coalesce(F.col(question), F.lit(False)).alias("question"))
        fields = plain.select("*", *[folded(F.col(c)).alias(f"flat_{c}") for c in ("title", "section", "body")])
        fields.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/entries")
        whole = F.array_join(F.array(*map(F.col, FIELDS)), "\n")
        grams = fields.select("id", whole.alias("w")).select("id", F.explode(F.array_distinct(F.concat(*[runs(F.col("w"), n) for n in (1, 2, 3)]))).alias("gram"))
        lists = grams.withColumn("bucket", bucket(F.col("gram")))
        lists.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/lists")
        index = cls(entries.sparkSession, folder)
        index._lists().groupBy("bucket", "gram").agg(F.count("*").alias("n")).repartitionByRange("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/lengths")
        return index

    def _lists(self) -> DataFrame:
        return self.spark.read.schema("id long, gram string, bucket int").parquet(f"{self.folder}/lists")

    def _entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/entries")

    def _rarest(self, queries: DataFrame) -> DataFrame:
        """query, token, gram, n: the rarest run of each token that is on all lists it needs, and its length."""
        tokens = queries.select("query", F.explode(F.array_distinct("tokens")).alias("token")).filter("token <> ''")
        length = F.least(F.length("token"), F.lit(3))
        parts = F.when(length == 1, runs(F.col("token"), 1)).when(length == 2, runs(F.col("token"), 2)).otherwise(runs(F.col("token"), 3))
        needed = tokens.select("query", "token", F.explode(F.array_distinct(parts)).alias("gram"))
        lengths = self.spark.read.schema("gram string, n long, bucket int").parquet(f"{self.folder}/lengths")
        sized = self._pruned(lengths, needed).join(needed, "gram", "right")
        # A run without a list tells that its token is nowhere.
        return sized.groupBy("query", "token").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")

    def candidates(self, queries: DataFrame) -> DataFrame:
        """From (query, tokens) to (query, tokens, id): entries on the list of the rarest run of some token."""
        chosen = self._rarest(queries).select("query", "gram").distinct()
        met = self._pruned(self._lists(), chosen).join(chosen, "gram").select("query", "id").distinct()
        return met.join(queries.select("query", "tokens"), "query")

    def _pruned(self, lists: DataFrame, grams: DataFrame) -> DataFrame:
        """Only the folders that hold one of the runs."""
        named = [r.gram for r in grams.select("gram").distinct().limit(MOST_NAMED + 1).collect()]
        if len(named) > MOST_NAMED:
            return lists
        used = self.spark.createDataFrame([(g,) for g in named], "gram string").select(bucket(F.col("gram"))).distinct().collect()
        if not named:
            return lists.limit(0)
        opened = lists.filter(F.col("bucket").isin([r[0] for r in used]))
        return opened.filter(F.col("gram").isin(named)) if len(named) <= FEW else opened

    def search(self, queries: DataFrame, top: int = 12) -> DataFrame:
        """query, rank, id, score: the best entries of each query (query, tokens) that score more than nothing, ties to the smaller id.

        Tokens are lower-case; their order matters to the phrase only. Empty tokens are left out, and repeated queries are one. Queries with
        the same tokens are searched for once.
        """
        queries = queries.select("query", F.filter("tokens", lambda t: t != "").alias("tokens")).dropDuplicates(["query"]).filter(F.size("tokens") > 0)
        queries = held(queries)
        searches = held(queries.select("tokens").distinct().withColumn("search", F.monotonically_increasing_id()))
        entries, asked = self._entries().count(), searches.count()
        listed = self._rarest(searches.withColumnRenamed("search", "query")).agg(F.sum("n")).first()[0] or 0
        scored = self._from_lists(searches) if listed <= entries else self._from_slices(searches, top, entries, asked)
        order = Window.partitionBy("search").orderBy(F.desc("score"), "id")
        best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return best.join(searches, "search").select("tokens", "rank", "id", "score").join(queries, "tokens").select("query", "rank", "id", "score")

    def _from_lists(self, searches: DataFrame) -> DataFrame:
        """search, id, score of the entries on the searches' lists."""
        met = self.candidates(searches.withColumnRenamed("search", "query")).join(self._entries(), "id")
        return met.select(F.col("query").alias("search"), "id", score_of(F.col("tokens")).alias("score")).filter("score > 0")

    def _from_slices(self, searches: DataFrame, top: int, entries: int, asked: int) -> DataFrame:
        """search, id, score of the best `top` entries of each slice of all entries."""
        wide, deep = max(min(ceil(entries / LEAST_SLICE), SLICES), ceil(entries / MOST_SLICE)), ceil(asked / MOST_ASKED)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = self._entries().withColumn("e", dealt("id", wide)).withColumn("s", every(deep))
        right = searches.withColumn("s", dealt("search", deep)).withColumn("e", every(wide))
        return left.groupBy("e", "s").cogroup(right.groupBy("e", "s")).applyInPandas(_best_of_slice(top), "search long, id long, score int")
