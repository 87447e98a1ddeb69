"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point alone, so every task has the same one. A trigram's
vector binds (multiplies) its letters' vectors, the first rotated by two places and the second by one; a text's vector
bundles (adds) those of its trigrams. A language's prototype bundles all its training texts, and a text gets the language
whose prototype has the largest cosine. Bundling is a sum, so each task sends one partial sum per language.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import text_slices

DIMENSIONS = 512
UNKNOWN = "und"
_EDGE = 32  # the space at a word's edges
#: Trigrams whose vectors are in memory at once, and texts whose bundles are.
BLOCK, KNOWN, TEXTS = 20_000, 60_000, 2_000
MOST_LANGUAGES = 2_000


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, the space for all else."""
    table = np.full(0x110000, _EDGE, np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


@functools.lru_cache(maxsize=20_000)
def _letter_vector(cp: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=cp)).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1


def _vectors(codes: np.ndarray) -> np.ndarray:
    """Vectors of packed trigrams."""
    out = np.ones((len(codes), DIMENSIONS), np.float32)
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        letters, which = np.unique((codes >> shift) & 0x1FFFFF, return_inverse=True)
        out *= np.stack([np.roll(_letter_vector(int(cp)), turn) for cp in letters])[which] if len(letters) else 1
    return out


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and packed code of each trigram with a letter in its middle; texts and runs of other signs end in one space.

    Broken UTF-8 is read with replacement characters, which are no letters.
    """
    try:
        read = data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        whole = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:])]
        read, data, offsets = b"".join(whole).decode(), np.frombuffer(b"".join(whole), np.uint8), np.cumsum([0, *map(len, whole)])
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    text = np.frombuffer(read.encode("utf-32-le"), np.uint32)
    letters = _letters()[text]
    # A space before and after each text, and no two spaces in a row.
    n = len(offsets) - 1
    rows = np.concatenate([rows, np.arange(n), np.arange(n)])
    letters = np.concatenate([letters, np.full(2 * n, _EDGE)])
    order = np.lexsort((np.concatenate([np.arange(len(text)), np.full(n, -1), np.full(n, len(text))]), rows))
    rows, letters = rows[order], letters[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (letters[1:] != _EDGE) | (letters[:-1] != _EDGE) | (rows[1:] != rows[:-1])
    rows, letters = rows[keep], letters[keep]
    codes = letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:]
    good = (rows[:-2] == rows[2:]) & (letters[1:-1] != _EDGE)
    return rows[1:-1][good], codes[good]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # a row of length one for each language


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes of all languages that occur; rows with a null text or language say nothing.

    Sends languages x DIMENSIONS numbers to the driver: MOST_LANGUAGES at most, more are an error.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(name: str, codes: np.ndarray, n: np.ndarray) -> None:
            if name in counts:
                codes, n = np.concatenate([counts[name][0], codes]), np.concatenate([counts[name][1], n])
            codes, which = np.unique(codes, return_inverse=True)
            counts[name] = codes, np.bincount(which, n)

        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for start, end, data, offsets in text_slices(batch.column(0)):
                rows, codes = _trigrams(data, offsets)
                own = names[start:end][rows]
                for name in set(names[start:end]):
                    add(name, *np.unique(codes[own == name], return_counts=True))
        for name, (codes, n) in counts.items():
            total = np.zeros(DIMENSIONS)
            for k in range(0, len(codes), BLOCK):
                total += n[k : k + BLOCK] @ _vectors(codes[k : k + BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], names=["lang", "dim", "value"])

    known = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sums = known.mapInArrow(bundle, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).limit((MOST_LANGUAGES + 1) * DIMENSIONS).collect()
    languages = sorted({r.lang for r in sums})
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    vectors = np.zeros((len(languages), DIMENSIONS))
    place = {name: i for i, name in enumerate(languages)}
    for r in sums:
        vectors[place[r.lang], r.dim] = r.value
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles(languages, vectors / np.where(lengths > 0, lengths, 1))


class Memory:
    """Vectors of the trigrams met so far, KNOWN at most."""

    def __init__(self) -> None:
        self.known, self.table = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32)

    def _vectors(self, found: np.ndarray) -> np.ndarray:
        new = found[~np.isin(found, self.known, assume_unique=True)]
        if len(self.known) + len(new) > KNOWN:
            self.known, self.table, new = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32), found
        if len(new):
            known, table = np.concatenate([self.known, new]), np.concatenate([self.table, _vectors(new)])
            order = np.argsort(known)
            self.known, self.table = known[order], table[order]
        return self.table[np.searchsorted(self.known, found)]

    def bundles(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row a text, zero without trigrams. The trigrams of all texts are taken BLOCK different ones at a time."""
        rows, codes = _trigrams(data, offsets)
        out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
        found, which = np.unique(codes, return_inverse=True)
        if not len(found):
            return out
        pairs, n = np.unique(rows * len(found) + which, return_counts=True)
        row, code, n = pairs // len(found), pairs % len(found), n.astype(np.float32)
        for k in range(0, len(found), BLOCK):
            table = self._vectors(found[k : k + BLOCK])
            here = np.flatnonzero((code >= k) & (code < k + BLOCK)) if len(found) > BLOCK else np.arange(len(code))
            own, cut = code[here] - k, np.searchsorted(row[here], np.arange(len(out) + 1))
            for i in np.flatnonzero(np.diff(cut)):
                a, b = cut[i], cut[i + 1]
                out[i] += n[here[a:b]] @ table[own[a:b]]
        return out


def predict_language(docs: DataFrame, profiles: Profiles, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred and score, the cosine with the prototype, at least 0. Ties go to the first language by name.

    A null text, one without letters, or any text where no language was learned gets `und` with score 0. Whole texts
    are read; no shuffle. Columns that have one of the new names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    languages, prototypes = [*profiles.languages], profiles.vectors.astype(np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            names, scores = [], []
            for start, end, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                for a in range(0, end - start, TEXTS):
                    b = min(end - start, a + TEXTS)
                    for bundle in memory.bundles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        length = float(np.linalg.norm(bundle))
                        if not languages or length == 0:
                            names.append(UNKNOWN)
                            scores.append(0.0)
                            continue
                        cosines = prototypes @ bundle / length
                        best = int(cosines.argmax())
                        names.append(languages[best])
                        scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1; not for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
