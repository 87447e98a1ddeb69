"""Source divergence audit over a vocabulary kept as minimal acyclic transducers.

The terms of a language that enough of its documents hold are sorted over all partitions and cut into shards of consecutive
terms. A task builds each shard's minimal acyclic transducer from its sorted terms; an arc's output is the number of terms that
sort before those behind it, so the outputs along a term's path add up to its lexicographic ordinal. Shards of a language are
joined along the terms where they meet. All texts then stream through the transducers once more, all terms of a slab side by side, a
step a byte: a term that ends in a final state is counted under its ordinal, one that finds no arc is not kept.

From the counts come smoothed shares in whole numbers, their divergences between the sources of a language and from the language,
and ranks; ordinals break ties, as they are the terms' order in UTF-8.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import given_back, shared_folder

LEAST_DOCS, TOP, SCALE = 3, 200, 10**9
SHARD_TERMS = 50_000
#: Transducers up to this size in all are sent to the tasks; beyond it the tasks' terms go to the shards instead.
SENT_BYTES = 64_000_000
SLAB_BYTES = 2_000_000
#: Entries of a task's running counts; beyond it they are given out and started anew.
MOST_HELD = 400_000
#: Bytes of terms as they are, A-Z in lower case, all else as spaces.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _named(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    nothing = F.lit("")
    return docs.select(F.coalesce(F.col(lang).cast("string"), nothing).alias("lang"), F.coalesce(F.col(source).cast("string"), nothing).alias("source"), F.coalesce(F.col(text).cast("string"), nothing).cast("binary").alias("text"))


# The vocabulary.


@dataclass
class Transducer:
    """Arcs by state: those of state s are first[s] to first[s + 1], by byte; words[s] counts the terms from s on."""

    first: np.ndarray
    byte: np.ndarray
    next: np.ndarray
    words: np.ndarray
    final: np.ndarray
    roots: dict[str, int]
    _table: tuple = field(default=(), repr=False)

    @property
    def outputs(self) -> np.ndarray:
        """Of each arc: the terms that end in its state or go on with a smaller byte."""
        counts = self.words[self.next].astype(np.int64)
        running = np.cumsum(counts) - counts
        state = np.repeat(np.arange(len(self.final)), np.diff(self.first))
        return running - running[self.first[:-1][state]] + self.final[state] if len(counts) else counts

    def _hashed(self) -> tuple:
        """Arcs in an open hash table by state and byte."""
        state = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first))
        keys = state << 8 | self.byte
        bits = max(4, int(2 * len(keys)).bit_length())
        table, waiting = np.full(1 << bits, -1, np.int64), np.arange(len(keys))
        slots = self._slot(keys, bits)
        while len(waiting):
            free = table[slots[waiting]] < 0
            table[slots[waiting[free]]] = waiting[free]  # of several arcs for a slot one stays
            waiting = waiting[table[slots[waiting]] != waiting]
            slots[waiting] = slots[waiting] + 1 & (1 << bits) - 1
        held = table >= 0
        stored = np.full(len(table), -1, np.int64)
        stored[held] = keys[table[held]]
        following, out = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        following[held], out[held] = self.next[table[held]], self.outputs[table[held]]
        return bits, stored, following, out

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Ordinal of each stretch of bytes, read from its state; -1 for stretches that are no terms and for states below 0."""
        if not self._table:
            self._table = self._hashed()
        bits, stored, following, out = self._table
        found = np.full(len(starts), -1, np.int64)
        rows = np.flatnonzero(states >= 0)
        at, end, state, total = starts[rows], ends[rows], states[rows].astype(np.int64), np.zeros(len(rows), np.int64)
        while len(rows):
            over = at == end
            if over.any():
                ended = over & self.final[state]
                found[rows[ended]] = total[ended]
                rows, at, end, state, total = (x[~over] for x in (rows, at, end, state, total))
            keys = state << 8 | data[at]
            slots = self._slot(keys, bits)
            met = stored[slots]
            far = np.flatnonzero((met != keys) & (met >= 0))
            while len(far):
                slots[far] = slots[far] + 1 & (1 << bits) - 1
                met[far] = stored[slots[far]]
                far = far[(met[far] != keys[far]) & (met[far] >= 0)]
            hit = met == keys
            if not hit.all():
                rows, at, end, slots, total = (x[hit] for x in (rows, at, end, slots, total))
            state, total, at = following[slots], total + out[slots], at + 1
        return found


def minimal_transducer(terms: list[bytes], name: str = "") -> Transducer:
    """The minimal acyclic automaton of distinct terms in byte order, built term by term: what the next term doesn't share is
    finished, and a finished state that equals another is that other."""
    register: dict[tuple, int] = {}
    words: list[int] = []
    path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
    last = b""

    def finish(depth: int) -> None:
        while len(path) > depth:
            ends, arcs = path.pop()
            key = (ends[0], *arcs)
            state = register.get(key)
            if state is None:
                state = register[key] = len(words)
                words.append(ends[0] + sum(words[s] for _, s in arcs))
            if path:
                path[-1][1].append((last[len(path) - 1], state))

    for term in terms:
        shared = 0
        while shared < len(last) and shared < len(term) and last[shared] == term[shared]:
            shared += 1
        finish(shared + 1)
        path.extend(([False], []) for _ in range(len(term) - shared))
        path[-1][0][0] = True
        last = term
    finish(1)
    root = len(words)
    finish(0)
    root = min(root, len(words) - 1)  # the root is new, or equals a state only if there are no terms
    states = list(register)
    first = np.cumsum([0, *[len(s) - 1 for s in states]])
    arcs = np.array([a for s in states for a in s[1:]], np.int64).reshape(-1, 2)
    return Transducer(first, arcs[:, 0].astype(np.uint8), arcs[:, 1], np.array(words), np.array([s[0] for s in states], bool), {name: root})


def joined_transducer(parts: list[tuple[str, Transducer]]) -> Transducer:
    """One transducer of shards (language, shard) in term order: a root a language.

    Only along the terms where two shards meet have both an arc for a byte; there states are joined, with the terms of both.
    """
    if not parts:
        return Transducer(np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), {})
    shift = np.cumsum([0, *[len(t.final) for _, t in parts]])
    arcs = np.cumsum([0, *[len(t.byte) for _, t in parts]])
    first = np.concatenate([t.first[:-1] + a for (_, t), a in zip(parts, arcs, strict=False)])
    byte, following = np.concatenate([t.byte for _, t in parts]), np.concatenate([t.next + s for (_, t), s in zip(parts, shift, strict=False)])
    words, final = np.concatenate([t.words for _, t in parts]), np.concatenate([t.final for _, t in parts])
    lengths = np.diff(np.append(first, len(byte)))
    more: list[tuple[list[tuple[int, int]], int, bool]] = []

    def joined(states: list[int]) -> int:
        if len(states) == 1:
            return states[0]
        by_byte: dict[int, list[int]] = defaultdict(list)
        for s in states:
            for k in range(first[s], first[s] + lengths[s]):
                by_byte[int(byte[k])].append(int(following[k]))
        own = [(b, joined(by_byte[b])) for b in sorted(by_byte)]
        more.append((own, int(sum(words[s] for s in states)), bool(any(final[s] for s in states))))
        return len(final) + len(more) - 1

    roots = defaultdict(list)
    for (name, t), s in zip(parts, shift, strict=False):
        roots[name].append(int(s + t.roots[next(iter(t.roots))]))
    roots = {name: joined(states) for name, states in roots.items()}
    lengths = np.concatenate([lengths, [len(own) for own, _, _ in more]]).astype(np.int64)
    added = np.array([a for own, _, _ in more for a in own], np.int64).reshape(-1, 2)
    return Transducer(
        np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([byte, added[:, 0].astype(np.uint8)]), np.concatenate([following, added[:, 1]]),
        np.concatenate([words, np.array([w for _, w, _ in more], np.int64)]), np.concatenate([final, np.array([f for _, _, f in more], bool)]), roots,
    )


def term_documents(docs: DataFrame) -> DataFrame:
    """From (lang, source, text as bytes) to (lang, term, docs), one row for each task and term at least."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, term, n) for lang, terms in held.items() for term, n in terms.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "term", "docs"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(2)
            for k, lang in enumerate(langs):
                held[lang].update(set(texts[k].as_py().translate(_TERMS).split()))
                if sum(map(len, held.values())) > MOST_HELD:
                    yield out()
        yield out()

    return docs.mapInArrow(given_back(counted), "lang string, term binary, docs long")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The terms that at least so many documents of a language hold: (lang, shard, at, term), term being `at` in its shard.

    Shards hold consecutive terms in byte order. The rows are checkpointed, so shards and places stay.
    """
    shared_folder(docs.sparkSession)
    enough = term_documents(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term").checkpoint()
    shards = max(1, -(-enough.count() // shard_terms))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            places = []
            for lang in batch.column(0).to_pylist():
                places.append(at[lang])
                at[lang] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shard] * len(places), pa.int64()), pa.array(places, pa.int64()), batch.column(1)], names=["lang", "shard", "at", "term"])

    ordered = enough.repartitionByRange(shards, "lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(numbered, "lang string, shard long, at long, term binary").checkpoint()


_ARRAYS = (("first", np.int64), ("byte", np.uint8), ("next", np.int64), ("words", np.int64), ("final", bool))


def _built(rows: pa.Table) -> pa.Table:
    terms = rows.sort_by("at").column("term").to_pylist()
    machine = minimal_transducer(terms)
    arrays = [pa.array([np.asarray(getattr(machine, name), kind).tobytes()], pa.binary()) for name, kind in _ARRAYS]
    return pa.Table.from_arrays([rows.column("lang").slice(0, 1), rows.column("shard").slice(0, 1), pa.array([machine.roots[""]], pa.int64()), *arrays], names=["lang", "shard", "root", *[n for n, _ in _ARRAYS]])


def shard_transducers(kept: DataFrame) -> DataFrame:
    """A row a shard and language with its transducer's arrays."""
    return kept.groupBy("lang", "shard").applyInArrow(_built, "lang string, shard long, root long, " + ", ".join(f"{n} binary" for n, _ in _ARRAYS))


def _loaded(row: dict, name: str) -> Transducer:
    return Transducer(*[np.frombuffer(row[n], k) for n, k in _ARRAYS], {name: row["root"]})


# Counting.


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, bytes, and start, end and row (a number in the list) of each term of some texts of a batch."""
    texts, row = batch.column(2), 0
    while row < batch.num_rows:
        rows, parts, held = [], [], 0
        while row < batch.num_rows and held < SLAB_BYTES:
            parts.append(texts[row].as_py())
            rows.append(row)
            held += len(parts[-1]) + 1
            row += 1
        data = np.frombuffer(b" ".join([*parts, b""]).translate(_TERMS), np.uint8)
        inside = np.concatenate([[False], data != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        ends_of_rows = np.cumsum([len(p) + 1 for p in parts])
        yield rows, data, edges[::2], edges[1::2], np.searchsorted(ends_of_rows, edges[::2], side="right")


class _Tally:
    """Running counts of whole-number keys in sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.rows += len(self.parts[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts] or [np.zeros(0, np.int64)])
        counts = np.concatenate([c for _, c in self.parts] or [np.zeros(0, np.int64)])
        keys, where = np.unique(keys, return_inverse=True)
        return keys, np.bincount(where, counts, len(keys)).astype(np.int64)

    def full(self) -> bool:
        if self.rows > 4 * MOST_HELD:
            self.parts = [self.merged()]
            self.rows = len(self.parts[0][0])
        return self.rows > 2 * MOST_HELD


def _count_rows(keys: np.ndarray, counts: np.ndarray, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array((keys // size).astype(np.int32)), pa.array(keys % size), pa.array(counts)], names=["g", "ordinal", "n"])


_COUNTS = "g int, ordinal long, n long"


def recount_sent(docs: DataFrame, shards: DataFrame, numbers: dict[tuple[str, str], int]) -> DataFrame:
    """Counts (g, ordinal, n) by task: all transducers, whose size was checked, are in every task."""
    machine = joined_transducer([(r["lang"], _loaded(r, r["lang"])) for r in shards.orderBy("lang", "shard").collect()])
    size = int(max([machine.words[r] for r in machine.roots.values()], default=0)) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows, data, starts, ends, row in _slabs(batch):
                roots = np.array([machine.roots.get(langs[r], -1) for r in rows])
                groups = np.array([numbers[langs[r], sources[r]] for r in rows])
                found = machine.ordinals(data, starts, ends, roots[row])
                hit = found >= 0
                tally.add(groups[row[hit]] * size + found[hit])
                if tally.full():
                    yield _count_rows(*tally.merged(), size)
                    tally = _Tally()
        yield _count_rows(*tally.merged(), size)

    return docs.mapInArrow(given_back(counted), _COUNTS)


def recount_dealt(docs: DataFrame, shards: DataFrame, numbers: dict[tuple[str, str], int], begins: dict[str, list[tuple[bytes, int, int]]]) -> DataFrame:
    """The same counts with the texts' terms, added up by slab, dealt to their shard's transducer; no size is too large.

    begins: by language the first term, number and first ordinal of each shard, in term order.
    """
    firsts = {lang: [b[0] for b in rows] for lang, rows in begins.items()}
    names = {n: lang for (lang, _), n in numbers.items()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held: Counter = Counter()
            for k in range(batch.num_rows):
                g = numbers[langs[k], sources[k]]
                held.update((g, t) for t in batch.column(2)[k].as_py().translate(_TERMS).split())
                if len(held) > MOST_HELD or k == batch.num_rows - 1:
                    rows = []
                    for (g, t), n in held.items():
                        lang = names[g]
                        shard = bisect_right(firsts.get(lang, []), t) - 1
                        if shard >= 0:
                            rows.append((lang, begins[lang][shard][1], begins[lang][shard][2], g, t, n))
                    columns = list(zip(*rows, strict=True)) or [[]] * 6
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "shard", "base", "g", "term", "n"])
                    held.clear()

    def counted(rows: pa.Table, shard: pa.Table) -> pa.Table:
        if not rows.num_rows or not shard.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["g", "ordinal", "n"])
        machine = _loaded(shard.to_pylist()[0], "")
        terms = rows.column("term").to_pylist()
        ends = np.cumsum([len(t) for t in terms])
        found = machine.ordinals(np.frombuffer(b"".join(terms) + b" ", np.uint8), ends - [len(t) for t in terms], ends, np.full(len(terms), machine.roots[""]))
        hit = pa.array(found >= 0)
        ordinal = pa.array(found + rows.column("base")[0].as_py())
        return pa.Table.from_arrays([rows.column("g"), ordinal, rows.column("n")], names=["g", "ordinal", "n"]).filter(hit)

    terms = docs.mapInArrow(dealt, "lang string, shard long, base long, g int, term binary, n long").groupBy("lang", "shard", "base", "g", "term").agg(F.sum("n").alias("n"))
    return terms.groupBy("lang", "shard").cogroup(shards.groupBy("lang", "shard")).applyInArrow(counted, _COUNTS)


# Shares and divergences.


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exactly: a long division in three steps of 1000."""
    whole = totals + kept
    quotient, rest = np.divmod(counts + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + digit
    return quotient + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so it holds in 64 bits."""
    return (p - q) * (p - q) // q


@dataclass
class Audit:
    """What a task must know of all groups: by language its groups, their counts, and its number of terms."""

    groups: dict[int, list[int]]
    totals: dict[int, int]
    kept: dict[int, int]

    def dense(self, lang: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Counts of some terms by group of their language, and their shares."""
        own = np.array(self.groups[lang])
        lists = rows.column("held").combine_chunks()
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        counts = np.zeros((len(lists), len(own)), np.int64)
        counts[row, np.searchsorted(own, flat.field("g").to_numpy())] = flat.field("n").to_numpy()
        return counts, shares(counts, np.array([self.totals[g] for g in own]), self.kept[lang])

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        """Rows of a language at a time, so many that a matrix of them by groups stays small."""
        for batch in batches:
            table, langs = pa.Table.from_batches([batch]), batch.column(0).to_numpy()
            for lang in np.unique(langs).tolist():
                own, step = table.take(pa.array(np.flatnonzero(langs == lang))), max(1, 1_000_000 // len(self.groups[lang]))
                for at in range(0, own.num_rows, step):
                    yield lang, own.slice(at, step)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, shard_terms: int = SHARD_TERMS, sent_bytes: int = SENT_BYTES, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The audit: lang, source, part, item, value, rank.

    Part `pair`: the divergence of a source from each other source of its language, summed over all kept terms. Part `term`: the
    terms that a source holds and uses more than its language, the `top` largest by divergence. Null text, lang and source are
    empty strings; every (lang, source) that occurs is a group, also without terms; a language without kept terms has pairs
    of value 0; repeated rows count as documents; an empty table gives an empty table; other columns are not looked at.

    The driver holds a row for each (lang, source), of which the result has all pairs, a row for each shard of terms, and the
    transducers if they are small.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    docs = _named(docs, text, lang, source)
    named = sorted(tuple(r) for r in docs.select("lang", "source").distinct().collect())
    numbers = {name: k for k, name in enumerate(named)}
    langs = {name: k for k, name in enumerate(sorted({a for a, _ in named}))}

    kept = kept_terms(docs, least_docs, shard_terms)
    sizes = kept.groupBy("lang", "shard").agg(F.count("*").alias("terms"), F.min("term").alias("first")).orderBy("lang", "shard").collect()
    begins, base = defaultdict(list), Counter()
    for r in sizes:
        begins[r.lang].append((bytes(r["first"]), r["shard"], base[r.lang]))
        base[r.lang] += r.terms
    machines = shard_transducers(kept).checkpoint()
    weight = machines.agg(F.coalesce(F.sum(sum(F.length(n) for n, _ in _ARRAYS)), F.lit(0))).first()[0]
    counted = recount_sent(docs, machines, numbers) if weight <= sent_bytes else recount_dealt(docs, machines, numbers, begins)
    counts = counted.groupBy("g", "ordinal").agg(F.sum("n").alias("n")).checkpoint()

    totals = dict.fromkeys(numbers.values(), 0) | {r.g: r.n for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    groups = {k: [numbers[n] for n in named if n[0] == name] for name, k in langs.items()}
    audit = Audit(groups, totals, {k: base[name] for name, k in langs.items()})
    group_table = spark.createDataFrame([(numbers[n], langs[n[0]], *n) for n in named], "g int, l int, lang string, source string")
    rows = counts.join(F.broadcast(group_table.select("g", "l")), "g").groupBy("l", "ordinal").agg(F.collect_list(F.struct("g", "n")).alias("held"))

    def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for k, block in audit.blocks(batches):
            _, p = audit.dense(k, block)
            matrix = sums.setdefault(k, np.zeros((p.shape[1], p.shape[1]), np.int64))
            for a in range(p.shape[1]):
                matrix[a] += divergence(p[:, a : a + 1], p).sum(axis=0)
        for k in sums:
            own = audit.groups[k]
            one, two = np.repeat(own, len(own)).astype(np.int32), np.tile(own, len(own)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(sums[k].ravel())], names=["g", "other", "value"])

    def term_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in audit.blocks(batches):
            counts, p = audit.dense(k, block)
            whole = shares(counts.sum(axis=1), np.array(sum(audit.totals[g] for g in audit.groups[k])), audit.kept[k])
            row, column = np.nonzero((counts > 0) & (p > whole[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(audit.groups[k], np.int32)[column]), block.column("ordinal").combine_chunks().take(pa.array(row)), pa.array(divergence(p[row, column], whole[row]))], names=["g", "ordinal", "value"])

    one, other = group_table.select("g", "l", "lang", "source"), group_table.select(F.col("g").alias("other"), "l", F.col("source").alias("item"))
    summed = rows.mapInArrow(pair_sums, "g int, other int, value long").groupBy("g", "other").agg(F.sum("value").alias("value"))
    pairs = one.join(other, "l").filter("g <> other").join(summed, ["g", "other"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    ranked = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    by_ordinal = Window.partitionBy("g").orderBy(F.desc("value"), "ordinal")
    best = rows.mapInArrow(term_values, "g int, ordinal long, value long").withColumn("rank", F.row_number().over(by_ordinal)).filter(F.col("rank") <= top)
    best = best.join(F.broadcast(group_table), "g")
    shard_table = spark.createDataFrame([(name, s, b) for name, own in begins.items() for _, s, b in own], "lang string, shard long, base long")
    words = kept.join(shard_table, ["lang", "shard"]).select("lang", (F.col("base") + F.col("at")).alias("ordinal"), F.col("term").cast("string").alias("item"))
    terms = best.join(words, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
held AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
by_doc AS (SELECT r, lang, source, term, count(*) AS n FROM held GROUP BY ALL),
kept AS (SELECT lang, term FROM by_doc GROUP BY ALL HAVING count(*) >= 3),
kept_number AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM by_doc SEMI JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM every LEFT JOIN counts USING (lang, source) GROUP BY ALL),
own AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v) AS p
  FROM totals t JOIN kept_number USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON (c.lang, c.source, c.term) = (t.lang, t.source, k.term)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) USING (lang) JOIN kept_number USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN own x ON (x.lang, x.source) = (a.lang, a.source) LEFT JOIN own y ON (y.lang, y.source, y.term) = (b.lang, b.source, x.term)
  GROUP BY ALL),
terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
