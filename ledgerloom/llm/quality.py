"""Quality by weak supervision: rules vote, their accuracies come from the votes alone.

Each rule says good (1), bad (-1) or abstains (0). In the model a rule that speaks is right with its own accuracy,
independently of the others given the true quality; abstaining says nothing. Expectation maximisation finds the
accuracies and the share of good documents; a document's log odds are then a sum over its votes. Most rules know one
kind of junk and speak only there: a "good" vote from each rule that merely found nothing would, all together, drown
the one that did. Only the number of documents with each vector of votes matters, so the fit reads one count table of
at most 3 to the number of rules rows, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import given_back, shared_folder
from ledgerloom.llm.tokens import text_slices
from ledgerloom.llm.words import SLICE_BYTES, hashes, mix, per_row, spans, windows

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_distinct_words", "n_letter_bytes", "n_word_bytes")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Least log(distinct words) / log(words) of a text that isn't said to repeat its words. This measure hardly falls with length:
#: a text whose vocabulary grows with the square root of its words stays above one half at any length.
LEAST_VARIETY = 0.6
_CLOSERS = np.zeros(256, bool)
_CLOSERS[[ord(c) for c in ".!?\"':;)"]] = True


def _is_letter(data: np.ndarray) -> np.ndarray:
    """Bytes of letters: ASCII ones, and all of other scripts but signs, box drawing, dingbats and emoji."""
    out = _LETTERS[data]
    if data.size and data.max() >= 0xC2:
        after = np.append(data[1:], 0)
        # Lead bytes of U+0080 to U+00BF, of U+2000 to U+2BFF, of U+3000 to U+303F and of U+1F000 to U+1FFFF.
        for size, signs in ((2, data == 0xC2), (3, (data == 0xE2) & (after < 0xB0) | (data == 0xE3) & (after == 0x80)), (4, (data == 0xF0) & (after == 0x9F))):
            at = np.flatnonzero(signs)
            for k in range(size):
                out[np.minimum(at + k, len(data) - 1)] = False
    return out


def _features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = spans(data, offsets)
    word_hash = hashes(data, starts, ends)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    row_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[starts] += 1
    np.subtract.at(in_word, ends, 1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)

    # Lines: a text without a newline is one line.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_rows = np.sort(np.concatenate([np.arange(n), row_of_byte[breaks]]))
    line_ends = np.sort(np.concatenate([offsets[1:], breaks]))
    first = np.searchsorted(starts, line_starts)
    worded = np.append(starts, len(data) + 1)[first] < line_ends
    line_starts, line_ends, line_rows = line_starts[worded], line_ends[worded], line_rows[worded]
    line_hash = hashes(data, line_starts, line_ends) ^ salt[line_rows] if len(line_starts) else np.zeros(0, np.uint64)
    _, seen = np.unique(line_hash, return_index=True)
    repeated = np.ones(len(line_hash), bool)
    repeated[seen] = False
    last_word = np.searchsorted(ends, line_ends, side="right") - 1
    closed = _CLOSERS[data[ends[last_word] - 1]] if len(line_starts) else np.zeros(0, bool)

    found, at = windows(word_hash, rows, 3)
    _, group, count = np.unique(found ^ salt[rows[at]], return_inverse=True, return_counts=True)
    at = at[count[group] > 1] if len(found) else at
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[at + k] = True
    _, distinct = np.unique(word_hash ^ salt[rows], return_index=True)

    return {
        "n_words": per_row(rows, n),
        "word_chars": per_row(row_of_byte[in_word & ((data & 0xC0) != 0x80)], n),
        "n_symbols": per_row(row_of_byte[_SYMBOLS[data]], n),
        "n_dup_lines": per_row(line_rows[repeated], n),
        "n_repeat_words": per_row(rows[covered], n),
        "n_lines": per_row(line_rows, n),
        "n_closed_lines": per_row(line_rows[closed], n),
        "n_distinct_words": per_row(rows[distinct], n),
        "n_letter_bytes": per_row(row_of_byte[_is_letter(data)], n),
        "n_word_bytes": per_row(row_of_byte[in_word], n),
    }


def text_features(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds the counts in FEATURES, of whole texts; no shuffle. Null texts count as empty, all counts 0.

    Repeated rows and other columns stay; columns that have one of the new names are replaced.
    """
    docs = docs.drop(*FEATURES)
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(0).cast("long").alias(c) for c in FEATURES]).schema

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_features(data, offsets) for _, _, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text)), SLICE_BYTES)]
            columns = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64)) for c in FEATURES]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + columns, names=[*kept, *FEATURES])

    shared_folder(docs.sparkSession)
    return docs.mapInArrow(given_back(measured), schema)


def votes() -> dict[str, Column]:
    """The rules over FEATURES; a document without words gets bad or no vote."""
    words, share = F.col("n_words"), lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))

    def rule(bad: Column, good: Column | None = None) -> Column:
        vote = F.when(bad, -1) if good is None else F.when(bad, -1).when(good, 1)
        return vote.otherwise(0).cast("int")

    symbols, repeats, lines = share("n_symbols", "n_words"), share("n_repeat_words", "n_words"), F.col("n_lines")
    length, closed = share("word_chars", "n_words"), share("n_closed_lines", "n_lines")
    variety = F.log(F.greatest("n_distinct_words", F.lit(1))) / F.log(F.greatest("n_words", F.lit(2)))
    letters = share("n_letter_bytes", "n_word_bytes")
    return {
        "symbols": rule(symbols > 0.1),
        "repeats": rule(repeats > 0.4),
        "lines": rule((lines >= 3) & (F.col("n_dup_lines") > 0.5 * lines)),
        "word_length": rule((words == 0) | (length < 2.5) | (length > 14)),
        "variety": rule((words >= 30) & (variety < LEAST_VARIETY)),
        "letters": rule(letters < 0.9, letters > 0.93),
        "prose": rule((lines >= 3) & (closed < 0.1), (closed >= 0.6) & (symbols < 0.02)),
    }


@dataclass(frozen=True)
class RuleModel:
    prior: float
    accuracy: dict[str, float]


def fit_rules(featured: DataFrame, rounds: int = 300, start: float = 0.8) -> RuleModel:
    """Accuracies and the prior by expectation maximisation over the counts of all vote vectors.

    Accuracies stay between 0.5 and 0.99: a rule is never worse than a coin and never beyond doubt, which also fixes
    which of the two classes is the good one. Without documents the start values are returned.
    """
    rules = votes()
    table = featured.groupBy(*[vote.alias(name) for name, vote in rules.items()]).count().collect()  # at most 3 ** len(rules) rows
    prior, accuracy = start, np.full(len(rules), start)
    if table:
        vote, n = np.array([row[:-1] for row in table], float), np.array([row[-1] for row in table], float)
        for _ in range(rounds):
            good = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + vote @ np.log(accuracy / (1 - accuracy)))))
            right = np.where(vote > 0, good[:, None], np.where(vote < 0, 1 - good[:, None], 0))
            fresh = np.clip((n @ right + start) / (n @ np.abs(vote) + 1), 0.5, 0.99)
            prior = float(np.clip(n @ good / n.sum(), 0.05, 0.95))
            moved, accuracy = np.abs(fresh - accuracy).max(), fresh
            if moved < 1e-9:
                break
    return RuleModel(prior, dict(zip(rules, map(float, accuracy))))


def quality_probability(model: RuleModel) -> Column:
    """Posterior probability that a document with these features is good."""
    log_odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for name, vote in votes().items():
        log_odds = log_odds + vote * F.lit(float(np.log(model.accuracy[name] / (1 - model.accuracy[name]))))
    return 1 / (1 + F.exp(-log_odds))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def score_quality(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds FEATURES, base_failed, quality (posterior) and kept.

    A document that fails the base rules is not kept; otherwise it is kept if its posterior is at least one half. Texts that
    are not wanted back are read once, and the counts checkpointed; else they are read twice, to fit and to score, as the
    texts themselves are not copied.
    """
    featured = text_features(docs, text, keep_text).drop("base_failed", "quality", "kept")
    if keep_text:
        model = fit_rules(text_features(docs.select(text), text, False))
    else:
        shared_folder(docs.sparkSession)
        featured = featured.checkpoint()
        model = fit_rules(featured)
    scored = featured.withColumn("base_failed", base_failed()).withColumn("quality", quality_probability(model))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
