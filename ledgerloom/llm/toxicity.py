"""Toxicity from a lexicon that is found in spite of misspelling and read in context.

The lexicon (whole words, and stems written "stem*") is learned from labelled rows and kept as a trie. A word of a text is
run against it by a Levenshtein automaton: a walk down the trie that keeps, for each number of edits, how far into the
word the match has come, and drops a branch when no state is left. Each hit is scored by the window around it: quotation
marks, reporting verbs and plain attribution lower it; address ("you") and further hits raise it. Sums of the hit scores
by kind are the features of a logistic model.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import given_back, shared_folder
from ledgerloom.llm.tokens import text_slices
from ledgerloom.llm.words import LOWER, SLICE_BYTES, hashes, mix

FEATURES = ("plain", "quoted", "misspelled", "addressed", "kinds")
WINDOW = 8
#: Bounds of the labelled sample that the lexicon and the model are learned from, by class.
SAMPLE_ROWS = 6_000
#: Words whose walk of the trie is remembered, in a dictionary of some 10 MB.
_MEMORY = 100_000
# Signs of quotation and of address.
REPORTING = frozenset("said says called calls wrote quote quoted quotes word term insult dit écrit sagte nannte wort dijo llamó palabra".split())
ADDRESS = frozenset("you your youre yourself u du dich dein ihr tu te toi vous votre usted tú eres".split())


def edits_allowed(term: str) -> int:
    """Edits by length of the term: none up to 4 letters, one up to 8, else two; a stem must be met exactly up to 6."""
    n = len(term.rstrip("*"))
    if term.endswith("*"):
        return 0 if n <= 6 else 1
    return 0 if n <= 4 else 1 if n <= 8 else 2


class Trie:
    """Terms as nested nodes; a node's term ends there."""

    def __init__(self, terms: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.terms = terms
        for k, term in enumerate(terms):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                node = self.next[node][c]
            if self.term[node] < 0 or term.endswith("*"):
                self.term[node] = k
        self.limit = [edits_allowed(t) for t in terms]
        self.below = [0] * len(self.next)  # most edits that a term at or below a node allows
        for term, limit in zip(terms, self.limit):
            node = 0
            for c in ("", *term.rstrip("*")):
                node = self.next[node][c] if c else node
                self.below[node] = max(self.below[node], limit)
        self.most = max(self.limit, default=0)
        #: Characters of a word that decide: a term is no longer with its edits, and a word of one more is too long for it.
        self.reach = max((len(t.rstrip("*")) + e for t, e in zip(terms, self.limit)), default=0) + 1
        self.letters = [int(np.bitwise_or.reduce(_bits()[list(t.rstrip("*").encode())], initial=0)) for t in terms]

    def possible(self, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether some term may match a word with these letters (bits of _bits()) and characters.

        Exact as a bound: an edit takes away one letter of a term at most, adds one at most, and changes the length by one
        at most. Words of which this is false need no walk.
        """
        out = np.zeros(len(letters), bool)
        for term, limit, mine in zip(self.terms, self.limit, self.letters):
            size, mine = len(term.rstrip("*")), np.uint64(mine)
            near = (lengths >= size - limit) & (np.bitwise_count(mine & ~letters) <= limit)
            out |= near if term.endswith("*") else near & (lengths <= size + limit) & (np.bitwise_count(letters & ~mine) <= limit)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """Term and edits of the closest term (ties: the first), or None.

        The automaton's states are sets of positions in the word, as bits of one number for each number of edits: those that
        the node's letters reach with so many edits or fewer. A branch is left when no position is, at the most edits that any
        of its terms allows and that would be better than what is found.
        """
        best: tuple[int, int] | None = None
        n = len(word)
        at: dict[str, int] = {}
        for p, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << p
        whole, end = (2 << n) - 1, 1 << n
        stack = [(0, [((2 << e) - 1) & whole for e in range(self.most + 1)])]
        while stack:
            node, states = stack.pop()
            k = self.term[node]
            if k >= 0:
                goal = whole if self.terms[k].endswith("*") else end
                edits = next((e for e, held in enumerate(states) if held & goal), 99)
                if edits <= self.limit[k] and (best is None or (edits, k) < (best[1], best[0])):
                    best = (k, edits)
            cap = len(states) - 1 if best is None else min(len(states) - 1, best[1])
            for c, child in self.next[node].items():
                same = at.get(c, 0)
                held = (states[0] & same) << 1
                moved = [held]
                for e in range(1, min(cap, self.below[child]) + 1):
                    # A letter met, a letter of the term more, another letter, a letter of the word more.
                    held = ((states[e] & same) << 1 | states[e - 1] | states[e - 1] << 1 | held << 1) & whole
                    moved.append(held)
                if held:
                    stack.append((child, moved))
        return best


@functools.cache
def _bits() -> np.ndarray:
    """A bit for each ASCII digit and small letter; none for other bytes."""
    table = np.zeros(256, np.uint64)
    for k, byte in enumerate([*range(48, 58), *range(97, 123)]):
        table[byte] = 1 << k
    return table


def _letter_sets(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each stretch of bytes, as bits, and its characters; no stretch is empty."""
    lengths = ends - starts
    begins = np.cumsum(lengths) - lengths
    data = low[np.arange(lengths.sum()) + np.repeat(starts - begins, lengths)]
    return np.bitwise_or.reduceat(_bits()[data], begins), np.add.reduceat((data & 0xC0) != 0x80, begins, dtype=np.int64)


@functools.cache
def _wordy() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return table


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and row of each run of letters and digits; typographic signs are gaps."""
    low = LOWER[data].copy()
    if len(low) > 1:
        accented = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[accented] += 0x20
    inside = _wordy()[low]
    if len(low) > 1:
        marks = np.flatnonzero((low[:-1] == 0xC2) & (low[1:] < 0xC0))
        inside[marks] = inside[marks + 1] = False
    if len(low) > 2:
        marks = np.flatnonzero((low[:-2] == 0xE2) & (low[1:-1] == 0x80))
        inside[marks] = inside[marks + 1] = inside[marks + 2] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


@dataclass
class Scanner:
    """Finds lexicon hits in slices of texts; remembers what it found for words it has walked the trie with."""

    trie: Trie
    memory: dict[int, int] = field(default_factory=dict)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, float, bool, bool]]:
        """Row, byte offsets in the text, term, edits, window score, quoted, addressed."""
        low, starts, ends, rows = _tokens(data, offsets)
        if not len(starts) or not self.trie.terms:
            return
        if len(self.memory) > _MEMORY:
            self.memory.clear()
        keys, first, which = np.unique(hashes(low, starts, ends), return_index=True, return_inverse=True)
        codes = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(self.trie.possible(*_letter_sets(low, starts[first], ends[first]))).tolist():
            key, k = int(keys[i]), first[i]
            code = self.memory.get(key)
            if code is None:
                found = self.trie.match(low[starts[k] : min(ends[k], starts[k] + 4 * self.trie.reach)].tobytes().decode("utf-8", "replace"))
                code = self.memory[key] = -1 if found is None else found[0] * 4 + found[1]
            codes[i] = code
        code = codes[which]
        at = np.flatnonzero(code >= 0)
        first_word = np.searchsorted(rows, np.arange(len(offsets)))
        for k in at.tolist():
            a, b = max(0, k - WINDOW), min(len(starts), k + WINDOW + 1)
            a, b = max(a, int(first_word[rows[k]])), min(b, int(first_word[rows[k] + 1]))
            near = [j for j in range(a, b) if j != k]
            words = {low[starts[j] : ends[j]].tobytes().decode("utf-8", "replace") for j in near}
            top, bottom = int(offsets[rows[k]]), int(offsets[rows[k] + 1])
            # Quotation marks count inside the same window: from the end of the last word before it to the first behind it.
            left = data[int(ends[a - 1]) if a and rows[a - 1] == rows[k] else top : starts[k]].tobytes()
            right = data[ends[k] : int(starts[b]) if b < len(starts) and rows[b] == rows[k] else bottom].tobytes()
            quoted = any(left.count(q) % 2 == 1 and q in right for q in (b'"', b"`")) or any(left.rfind(o) > left.rfind(c) and c in right for o, c in ((b"\xe2\x80\x9c", b"\xe2\x80\x9d"), (b"\xc2\xab", b"\xc2\xbb"), (b"\xe2\x80\x9e", b"\xe2\x80\x9c")))
            reported = bool(words & REPORTING)
            addressed = bool(words & ADDRESS)
            others = sum(code[j] >= 0 for j in near)
            score = (0.2 if quoted else 0.5 if reported else 1.0) * (1 + 0.5 * addressed + 0.25 * min(others, 4))
            yield int(rows[k]), int(starts[k]) - top, int(ends[k]) - top, int(code[k] >> 2), int(code[k] & 3), score, quoted, addressed

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """FEATURES of each text, all zero without hits."""
        out = np.zeros((len(offsets) - 1, len(FEATURES)))
        kinds: dict[int, set[int]] = {}
        for row, _, _, term, edits, score, quoted, addressed in self.hits(data, offsets):
            out[row, 1 if quoted else 2 if edits else 0] += score
            out[row, 3] += addressed and not quoted
            if not quoted and not edits:
                kinds.setdefault(row, set()).add(term)
        for row, terms in kinds.items():
            out[row, 4] = len(terms)
        return np.log1p(out)


@functools.lru_cache(maxsize=1)
def scanner(terms: tuple[str, ...]) -> Scanner:
    """One scanner for all tasks of a Python worker."""
    return Scanner(Trie(list(terms)))


@dataclass(frozen=True)
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ self.weights + self.bias)))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Texts of about `rows` labelled documents of each class at most, chosen by a hash of the id: the same in every run.

    A document labelled twice is toxic if one label says so; of several texts under one id the smallest stands. The chosen labels are that few, so they go to all tasks and no
    other text moves.
    """
    shared_folder(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    share = F.when(F.col("toxic") == 1, rows / max(rows, sizes.get(1, 0))).otherwise(rows / max(rows, sizes.get(0, 0)))
    chosen = labels.filter(draw < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).checkpoint()


def _items(labelled: DataFrame, wanted: list[str] | None) -> DataFrame:
    """item, context: words and stems of 4 to 7 letters with a hash of the neighbouring words; for wanted items only, once a text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if wanted is None else set(wanted)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), SLICE_BYTES):
                low, starts, ends, rows = _tokens(data, offsets)
                hashed = hashes(low, starts, ends)
                near = mix(np.concatenate([[0], hashed[:-1]]).astype(np.uint64)) + np.concatenate([hashed[1:], [0]]).astype(np.uint64) if len(hashed) else hashed
                seen: dict[tuple[str, int], None] = {}
                for k in range(len(starts)):
                    word = low[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")
                    if len(word) < 3:
                        continue
                    context = int(near[k]) if only is None else int(rows[k])
                    for item in (word, *[word[:n] + "*" for n in range(4, min(8, len(word) + 1))]):
                        if only is None or item in only:
                            seen[item, context] = None
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in seen]), pa.array(np.array([c for _, c in seen], np.uint64).view(np.int64))], names=["item", "context"])

    return labelled.select(F.col("text").cast("string")).mapInArrow(given_back(emit), "item string, context long")


def choose_terms(support: dict[str, int]) -> list[str]:
    """The terms to keep of those that mark toxic rows, with their support; sorted.

    A term falls away only for a chosen wider stem that covers it, and a stem only for a longer term that says as much; what
    the longer one leaves open stays a candidate of its own.
    """
    chosen: list[str] = []
    for item in sorted(support, key=lambda i: (-support[i], -len(i), i)):
        stem = item.rstrip("*")
        if any(c.endswith("*") and stem.startswith(c[:-1]) for c in chosen):
            continue
        if item.endswith("*") and any(support[i] >= support[item] / 1.05 for i in support if i != item and i.startswith(stem)):
            continue
        chosen.append(item)
    return sorted(chosen)


def learn_lexicon(sample: DataFrame, most_contexts: int = 12, precision: float = 0.97) -> list[str]:
    """Terms that mark toxic rows, from labelled rows (doc_id, text, toxic) of a bounded sample.

    A term must occur in the toxic rows in so many different surroundings, so words of one text that was copied often don't
    count, and in half as many rows, so words of one long text don't; and nearly never in the others. How many follows the
    toxic rows, one in 50, from 4 to `most_contexts`. What is sent to the driver is bounded by the sample's words over that.
    """
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    least = max(4, min(most_contexts, sizes.get(1, 0) // 50))
    toxic, clean = sample.filter("toxic = 1").select("text"), sample.filter("toxic = 0").select("text")
    often = _items(toxic, None).groupBy("item").agg(F.count_distinct("context").alias("n")).filter(F.col("n") >= least).collect()
    support = {r.item: r.n for r in often}
    if not support:
        return []
    inside, there = ({r.item: r.n for r in _items(rows, sorted(support)).groupBy("item").agg(F.count("*").alias("n")).collect()} for rows in (toxic, clean))
    scale = max(1, sizes.get(1, 0)) / max(1, sizes.get(0, 0))
    return choose_terms({i: n for i, n in support.items() if 2 * inside[i] >= least and inside[i] / (inside[i] + there.get(i, 0) * scale) >= precision})


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, penalty: float = 1.0) -> ToxicityModel:
    """Lexicon and logistic weights from documents (doc_id, text) and labels (doc_id, toxic); about `rows` of each class.

    Rows with a null id or label are left out; null texts are empty. Weights of hit features are not negative. Without
    labelled rows the lexicon is empty and every score is below one half.
    """
    sample = _sample(docs, labels, rows)
    terms = learn_lexicon(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(tuple(terms))
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(0), SLICE_BYTES):
                found = scan.features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(start, end - start), *[pa.array(np.ascontiguousarray(c)) for c in found.T]], names=["toxic", *FEATURES])

    measured = sample.select("text", "toxic").mapInArrow(given_back(measure), "toxic int, " + ", ".join(f"{f} double" for f in FEATURES))
    table = measured.groupBy("toxic", *[F.round(f, 3).alias(f) for f in FEATURES]).count().collect()  # at most the sample
    if not table:
        return ToxicityModel([], np.zeros(len(FEATURES)), -2.0)
    y, x, n = np.array([r[0] for r in table], float), np.array([r[1:-1] for r in table], float), np.array([r[-1] for r in table], float)
    weights, bias = np.zeros(x.shape[1]), 0.0
    design = np.hstack([x, np.ones((len(x), 1))])
    solution, ridge = np.zeros(x.shape[1] + 1), np.diag([penalty] * x.shape[1] + [0.01])
    for _ in range(60):  # Newton steps, halved where they overshoot
        p = 1 / (1 + np.exp(-np.clip(design @ solution, -30, 30)))
        gradient = design.T @ (n * (p - y)) + ridge @ solution
        hessian = (design * (n * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        solution -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        solution[:-1] = np.maximum(solution[:-1], 0)
        if np.abs(step).max() < 1e-8:
            break
    weights, bias = solution[:-1], float(solution[-1])
    return ToxicityModel(terms, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds toxicity (0 to 1) of each whole text; null and empty texts have the score of a text without hits.

    No shuffle; the model is a few terms and weights. Repeated rows and other columns stay; a column named toxicity is
    replaced.
    """
    docs = docs.drop("toxicity")
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias("toxicity")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(tuple(model.terms))
        for batch in batches:
            parts = [model.score(scan.features(data, offsets)) for _, _, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text)), SLICE_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*kept, "toxicity"])

    return docs.mapInArrow(given_back(score), schema)


def toxic_spans(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a hit: doc_id, begin and end (bytes of the UTF-8 text), term, edits, window_score, quoted, addressed."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(tuple(model.terms))
        for batch in batches:
            for start, _, data, offsets in text_slices(batch.column(1)):
                found = list(scan.hits(data, offsets))
                columns = list(zip(*found)) if found else [[]] * 8
                ids = batch.column(0).take(pa.array([start + r for r in columns[0]], pa.int64()))
                types = (pa.int64(), pa.int64(), None, pa.int32(), pa.float64(), pa.bool_(), pa.bool_())
                arrays = [pa.array([model.terms[t] for t in c], pa.string()) if kind is None else pa.array(list(c), kind) for c, kind in zip(columns[1:], types)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", "begin", "end", "term", "edits", "window_score", "quoted", "addressed"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(spans, "doc_id long, begin long, end long, term string, edits int, window_score double, quoted boolean, addressed boolean")
