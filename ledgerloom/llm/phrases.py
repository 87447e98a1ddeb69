"""Phrase collocation mining on a weighted de Bruijn graph of words.

A node is three words in a row, an edge four: it leads from its first three words to its last three and weighs as often as it
occurs. Only these longest grams are counted over the corpus. A gram that a piece's end cuts short is counted as it is: that is the
correction at the end, as those words have no edge. The count of fewer words is the flow through them: all edges and cut grams that
begin with them. A word too rare for any phrase ends a gram like a piece does; the words before it keep their counts.

Counted grams are dealt to partitions by their first words, sorted, and added up along the sort order, so all their prefixes have
their flow in one pass. A prefix whose words are so frequent that it could fill a partition is dealt by one word more, and its
parts are added afterwards.

Edges between nodes that pass all their flow on, from one edge to one edge, are compacted into paths. What lies inside a path is
inside a longer phrase of the same count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import shared_folder

LEAST, SHARE, TOP, SCALE = 30, 80, 2_000, 2_000_000
SLAB_BYTES = 2_000_000
#: Words of a task's running counts, beyond which they are given out and started anew.
MOST_HELD = 400_000
#: Frequent words up to this number and size are sent to the tasks; more are looked up block by block, in a join.
SENT_WORDS, SENT_BYTES = 500_000, 32_000_000
#: Words of a block of texts, and of a partition of counted grams.
BLOCK_WORDS, PART_WORDS = 4_000_000, 3_000_000
#: Parts of a language whose best phrases are found side by side.
TOP_PARTS = 64
#: Fewest frequent words to a partition when they are numbered.
RANKED = 100_000
# A-Z in lower case, ends of pieces as line feeds, tabs as spaces, all else as it is.
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 10 if 10 <= c <= 13 or c in b".,;:!?" else 32 if c == 9 else c for c in range(256))
_LOW = 0xFFFFFFFF


def _slabs(langs: list[str], texts: pa.Array) -> Iterator[tuple[str, bytes]]:
    """The texts of a language, some at a time, with ends of pieces between them."""
    rows = defaultdict(list)
    for k, lang in enumerate(langs):
        rows[lang].append(k)
    for lang, own in rows.items():
        parts, held = [], 0
        for k in own:
            parts.append(texts[k].as_py())
            held += len(parts[-1])
            if held > SLAB_BYTES:
                yield lang, b"\n".join(parts).translate(_PIECES)
                parts, held = [], 0
        if parts:
            yield lang, b"\n".join(parts).translate(_PIECES)


def word_counts(docs: DataFrame) -> DataFrame:
    """From (lang, text as bytes) to (lang, word, n)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, words in held.items() for word, n in words.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        for batch in batches:
            for lang, slab in _slabs(batch.column(0).to_pylist(), batch.column(1)):
                held[lang].update(slab.split())
                if sum(map(len, held.values())) > MOST_HELD:
                    yield out()
        yield out()

    return docs.mapInArrow(counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered_words(frequent: DataFrame) -> DataFrame:
    """Adds id to (lang, word, n): 1 is the most frequent word of all. Places are counted by range of n, then inside."""
    ranges = max(1, -(-frequent.count() // RANKED))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(places), part, np.int64)), pa.array(places)], names=["lang", "word", "n", "part", "at"])

    order = (F.desc("n"), "lang", "word")
    placed_rows = frequent.select("lang", "word", "n").repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(placed, "lang string, word binary, n long, part long, at long").checkpoint()
    begins, total = [], 0
    for part, rows in sorted(placed_rows.groupBy("part").count().collect()):  # one row a range
        begins.append((part, total))
        total += rows
    if total >= 1 << 31:
        raise ValueError("more frequent words than 31 bits can number")
    table = frequent.sparkSession.createDataFrame(begins, "part long, begin long")
    return placed_rows.join(F.broadcast(table), "part").select("lang", "word", "n", (F.col("begin") + F.col("at") + 1).alias("id"))


def _grams(slab: bytes, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of the longest gram at each word of a slab: two words a key, 0 where the gram is cut."""
    words = slab.split()
    number = np.fromiter(map(ids.get, words, repeat(0)), np.int64, len(words))
    data = np.frombuffer(slab, np.uint8)
    inside = np.concatenate([[False], (data != 32) & (data != 10)])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    piece = np.cumsum(data == 10)[starts]
    following = [number]
    for k in (1, 2, 3):
        own = np.zeros(len(words), np.int64)
        if len(words) > k:
            own[:-k] = np.where(piece[k:] == piece[:-k], number[k:], 0)
        following.append(np.where(following[-1] > 0, own, 0))
    first, second = following[0] << 32 | following[1], following[2] << 32 | following[3]
    held = number > 0
    return _added(first[held], second[held], np.ones(int(held.sum()), np.int64))


def _added(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((second, first))
    first, second, counts = first[order], second[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])) if len(first) else np.zeros(0, np.int64)
    return first[new], second[new], np.add.reduceat(counts, new) if len(new) else counts


_KEYS = "k1 long, k2 long, n long"


def _gram_batch(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(counts)], names=["k1", "k2", "n"])


def longest_grams(docs: DataFrame, words: DataFrame, total: int, sent_words: int = SENT_WORDS) -> DataFrame:
    """From (lang, text as bytes) and numbered words to (k1, k2, n), counted by slab."""
    size = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word") + F.length("lang")), F.lit(0))).first()
    if size[0] <= sent_words and size[1] <= SENT_BYTES:
        ids: dict[str, dict[bytes, int]] = defaultdict(dict)
        for lang, word, number in words.select("lang", "word", "id").collect():  # checked above
            ids[lang][bytes(word)] = number

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, slab in _slabs(batch.column(0).to_pylist(), batch.column(1)):
                    yield _gram_batch(*_grams(slab, ids.get(lang, {})))

        return docs.mapInArrow(sent, _KEYS)

    blocks = max(1, -(-total // BLOCK_WORDS))
    dealt = docs.withColumn("block", F.floor(F.rand(29) * blocks).cast("long")).checkpoint()

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(2).to_pylist()
            rows = {(numbers[k], lang, w) for k, lang in enumerate(batch.column(0).to_pylist()) for w in set(batch.column(1)[k].as_py().translate(_PIECES).split())}
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["block", "lang", "word"])

    def looked_up(texts: pa.Table, own: pa.Table) -> pa.Table:
        ids: dict[str, dict[bytes, int]] = defaultdict(dict)
        for row in own.to_pylist():
            ids[row["lang"]][row["word"]] = row["id"]
        found = [_gram_batch(*_grams(slab, ids.get(lang, {}))) for lang, slab in _slabs(texts.column("lang").to_pylist(), texts.column("text").combine_chunks())] if texts.num_rows else []
        return pa.Table.from_batches(found, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64())]))

    of_block = dealt.mapInArrow(used, "block long, lang string, word binary").distinct().join(words.select("lang", "word", "id"), ["lang", "word"])
    return dealt.groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(looked_up, _KEYS)


class _Flow:
    """Sums over runs of equal keys in a stream sorted by them; the last run stays open."""

    def __init__(self) -> None:
        self.open: tuple[int, int, int] | None = None

    def push(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(first):
            return first, second, counts
        if self.open:
            first, second, counts = (np.concatenate([[o], x]) for o, x in zip(self.open, (first, second, counts), strict=True))
        new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
        first, second, counts = first[new], second[new], np.add.reduceat(counts, new)
        self.open = int(first[-1]), int(second[-1]), int(counts[-1])
        return first[:-1], second[:-1], counts[:-1]

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.array([x] if self.open else [], np.int64) for x in (self.open or (0, 0, 0)))


def phrase_flows(grams: DataFrame, hot: int, parts: int, least: int) -> DataFrame:
    """All grams of one to four words that occur so often: (k1, k2, f), with 0 for the words that a shorter one lacks.

    hot: words numbered up to this may fill a partition.
    """
    w2, w3 = F.col("k1").bitwiseAND(F.lit(_LOW)), F.shiftright("k2", 32)
    cold = lambda w: (w > hot) | (w == 0)
    key = F.when(cold(w2), F.xxhash64("k1")).when(cold(w3), F.xxhash64("k1", w3)).otherwise(F.xxhash64("k1", "k2"))

    def flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [_Flow() for _ in range(4)]
        open_ = np.int64(~_LOW)

        def kept(length: int, first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            """Whole counts from `least` on, and all parts of counts that other partitions share."""
            w2, w3 = first & _LOW, second >> 32
            shared = (np.ones(len(first), bool), w2 <= hot, (w2 <= hot) & (w3 <= hot), np.zeros(len(first), bool))[length - 1]
            held = shared | (counts >= least)
            return _gram_batch(first[held], second[held], counts[held])

        def pushed(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second, counts = (np.concatenate([b.column(k).to_numpy() for b in waiting]) for k in range(3))
            nothing = np.zeros_like(first)
            for length, (a, b, has) in enumerate(((first & open_, nothing, first > 0), (first, nothing, first & _LOW > 0), (first, second & open_, second > 0), (first, second, second & _LOW > 0)), 1):
                yield kept(length, *levels[length - 1].push(a[has], b[has], counts[has]))

        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows > 200_000:
                yield from pushed(waiting)
                waiting, rows = [], 0
        if waiting:
            yield from pushed(waiting)
        for length, level in enumerate(levels, 1):
            yield kept(length, *level.close())

    summed = grams.repartition(parts, key).sortWithinPartitions("k1", "k2").mapInArrow(flows, _KEYS)
    return summed.groupBy("k1", "k2").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def _word(k: int) -> Column:
    source = F.col("k1" if k <= 2 else "k2")
    return F.shiftright(source, 32) if k % 2 else source.bitwiseAND(F.lit(_LOW))


def _key(*words: Column) -> tuple[Column, Column]:
    """The two key columns of some words."""
    none = F.lit(0).cast("long")
    w = [*words, *[none] * (4 - len(words))]
    return F.shiftleft(w[0], 32).bitwiseOR(w[1]), F.shiftleft(w[2], 32).bitwiseOR(w[3])


def _struct(names: tuple[str, str], key: tuple[Column, Column], *more: Column) -> Column:
    return F.struct(*[k.alias(n) for n, k in zip(names, key, strict=True)], *more)


def compacted_paths(flows: DataFrame) -> DataFrame:
    """The edges of the graph as paths: (words, f), words being ids in order, four or more.

    Two edges follow one another in a path if the node between them passes all its flow from the one to the other, so each edge
    has one edge before and behind it at most, and a path can't be a ring, as pieces end. Edges find the first edge of their path by
    doubling jumps, in rounds that grow with the logarithm of the longest path; each round ends in a checkpoint.
    """
    edges = flows.filter(_word(4) > 0)
    nodes = flows.filter((_word(3) > 0) & (_word(4) == 0)).select(F.col("k1").alias("v1"), F.col("k2").alias("v2"), F.col("f").alias("through"))
    ends = edges.select("k1", "k2", "f", _struct(("v1", "v2"), _key(_word(1), _word(2), _word(3))).alias("from"), _struct(("v1", "v2"), _key(_word(2), _word(3), _word(4))).alias("to"))
    into = ends.select("k1", "k2", "f", "to.*").join(nodes, ["v1", "v2"]).filter("f = through").select("v1", "v2", F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    out = ends.select("k1", "k2", "f", "from.*").join(nodes, ["v1", "v2"]).filter("f = through").select("v1", "v2", "k1", "k2")
    steps = out.join(into, ["v1", "v2"]).select("k1", "k2", "a1", "a2")
    jumps = edges.join(steps, ["k1", "k2"], "left").select("k1", "k2", "f", F.coalesce("a1", "k1").alias("a1"), F.coalesce("a2", "k2").alias("a2"), F.col("a1").isNotNull().cast("long").alias("d")).checkpoint()
    reached = jumps.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
    while True:
        other = jumps.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("d").alias("more"))
        further = jumps.join(other, ["a1", "a2"]).select("k1", "k2", "f", F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("d") + F.col("more")).alias("d")).checkpoint()
        now = further.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
        if now == reached:
            break
        jumps, reached = further, now
    along = jumps.groupBy("a1", "a2").agg(F.sort_array(F.collect_list(F.struct("d", _word(4).alias("w")))).alias("steps"), F.max("f").alias("f"))
    head = along.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), "steps", "f")
    return head.select(F.concat(F.array(_word(1), _word(2), _word(3)), F.col("steps.w")).alias("words"), "f")


def contained(flows: DataFrame, paths: DataFrame) -> DataFrame:
    """For each phrase of two or three words inside a longer one the largest count of such: (k1, k2, longer)."""
    i = lambda k: F.get("words", F.col("i") + k)
    inside = paths.select("words", "f", F.explode(F.sequence(F.lit(0), F.size("words") - 2)).alias("i"))
    pair, triple = _struct(("k1", "k2"), _key(i(0), i(1))), _struct(("k1", "k2"), _key(i(0), i(1), F.coalesce(i(2), F.lit(0).cast("long"))))
    of_paths = inside.select("f", F.explode(F.when(F.col("i") < F.size("words") - 2, F.array(pair, triple)).otherwise(F.array(pair))).alias("s")).select("s.*", "f")
    nodes = flows.filter((_word(3) > 0) & (_word(4) == 0))
    of_nodes = nodes.select("f", F.explode(F.array(_struct(("k1", "k2"), _key(_word(1), _word(2))), _struct(("k1", "k2"), _key(_word(2), _word(3))))).alias("s")).select("s.*", "f")
    return of_paths.unionByName(of_nodes).groupBy("k1", "k2").agg(F.max("f").alias("longer"))


def cut_scores(flows: DataFrame) -> DataFrame:
    """Phrases of two to four words with their lowest-scoring cut: (k1, k2, a, l, r, score).

    Products of counts are decimals of 38 digits, so they are exact.
    """
    phrases = flows.filter(_word(2) > 0)
    cut = lambda k, own: F.array(*[_struct(("p1", "p2"), _key(*side), F.lit(k).alias("cut"), F.lit(n).alias("side")) for n, side in enumerate((own[:k], own[k:]))])
    cuts = lambda m: F.flatten(F.array(*[cut(k, [_word(j) for j in range(1, m + 1)]) for k in range(1, m)]))
    parts = phrases.select("k1", "k2", F.col("f").alias("a"), F.explode(F.when(_word(3) == 0, cuts(2)).when(_word(4) == 0, cuts(3)).otherwise(cuts(4))).alias("c")).select("k1", "k2", "a", "c.*")
    sides = parts.join(flows.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "f"), ["p1", "p2"])
    scored = sides.groupBy("k1", "k2", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    scored = scored.withColumn("score", F.expr(f"({SCALE} * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + r)"))
    return scored.groupBy("k1", "k2", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("k1", "k2", "a", "best.l", "best.r", "best.score")


def _texts(words: DataFrame, ids: DataFrame) -> DataFrame:
    """From rows with a key and an array of ids to (key, lang, phrase)."""
    one = ids.select("key", F.posexplode("ids").alias("at", "id")).filter("id > 0")
    spelled = one.join(words.select("id", "lang", F.col("word").cast("string").alias("word")), "id")
    rows = spelled.groupBy("key").agg(F.max("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    return rows.select("key", "lang", F.array_join("w.word", " ").alias("phrase"))


class PhraseGraph:
    """The graph of a corpus: words with ids and counts, flows, compacted paths. Its tables are checkpointed."""

    def __init__(self, docs: DataFrame, least: int = LEAST, sent_words: int = SENT_WORDS, part_words: int = PART_WORDS, text: str = "text", lang: str = "lang") -> None:
        shared_folder(docs.sparkSession)
        docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
        counts = word_counts(docs).groupBy("lang", F.when(F.col("n") >= least, F.col("word")).alias("word")).agg(F.sum("n").alias("n")).checkpoint()
        self.sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.words = numbered_words(counts.filter("word IS NOT NULL")).checkpoint()
        parts = max(1, -(-total // part_words))
        hot = self.words.filter(F.col("n") > total // parts).count()
        self.flows = phrase_flows(longest_grams(docs, self.words, total, sent_words), hot, parts, least).checkpoint()
        self.paths = compacted_paths(self.flows).checkpoint()

    def passages(self) -> DataFrame:
        """Paths as text: lang, phrase, words (their number) and how often they occur; all of at least four words."""
        rows = self.paths.select(F.monotonically_increasing_id().alias("key"), F.col("words").alias("ids"), "f").checkpoint()
        return _texts(self.words, rows).join(rows, "key").select("lang", "phrase", F.size("ids").alias("words"), F.col("f").alias("n"))

    def collocations(self, share: int = SHARE, top: int = TOP) -> DataFrame:
        """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
        inside = contained(self.flows, self.paths)
        scored = cut_scores(self.flows).join(inside, ["k1", "k2"], "left")
        whole = scored.filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer").cast("decimal(20,0)") < F.lit(share) * F.col("a").cast("decimal(20,0)")))
        rows = whole.select(F.struct("k1", "k2").alias("key"), F.array(*[_word(k) for k in range(1, 5)]).alias("ids"), "a", "l", "r", "score").checkpoint()
        named = _texts(self.words, rows).join(rows.drop("ids"), "key").join(self.sizes, "lang")
        # First the best of each of some parts of a language, then the best of those.
        order = lambda *keys: Window.partitionBy("lang", *keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        parts = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
        best = parts.withColumn("rank", F.row_number().over(order("part"))).filter(F.col("rank") <= top)
        ranked = best.withColumn("rank", F.row_number().over(order())).filter(F.col("rank") <= top)
        return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, **options) -> DataFrame:
    """Phrases of two to four words that occur at least `least` times in their language, by the score of their weakest cut.

    Texts are lower-cased in A-Z and split at [.,;:!?] and line ends; null texts are empty, a null lang is `und`. A phrase inside
    a longer one that has at least `share` hundredths of its count is dropped. Repeated rows count each; an empty table gives
    an empty table; other columns are not looked at.
    """
    return PhraseGraph(docs, least, **options).collocations(share, top)


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
sizes AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM places CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 30),
phrases AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM grams WHERE m >= 2),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM phrases),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1 : c.m], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_places AS (SELECT lang, m, ws, a, unnest(range(1, m)) AS i FROM phrases),
inside AS (
  SELECT lang, array_to_string(ws[i : i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM inner_places CROSS JOIN (VALUES (2), (3)) AS t(s) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
ranked AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
