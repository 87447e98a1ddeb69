"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions.

A source's documents are a queue of tokens. A window is a sequence of CAPACITY tokens. At its end each queue should have given
its target, which grows with the windows in proportion to the source's weight; what it lacks is its deficit. The queues take
turns in a ring: one whose deficit has reached TURN tokens gives them, others wait and keep their deficit for the next window.
If that leaves room, the queue with the largest deficit lends tokens, and its deficit is negative afterwards. Documents are cut
where a turn or a window ends, so no window is padded; the tokens after the last full window are cut into powers of two.

Windows are one line of tokens over all partitions. A partition holds those pieces of each queue that are due in its
stretch of the line; it starts with the deficits of the partition before, which follow from the tokens that each queue has given so
far, and where its stretch begins inside a window, it fills the window's rest. So partitions are worked on side by side, and a
piece's sequence and offset are its place in the line.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import given_back, remove_folder, shared_folder
from ledgerloom.llm.tokens import LONG_BYTES, MergeTransducer

END_OF_TEXT = 2
CAPACITY = 4096
#: The least that a queue gives in a turn, unless it or the window ends.
TURN = 256
#: Tokens of a partition; with their ids some 8 MB.
PART_TOKENS = 4_000_000
#: Sources, one row each, go to the driver and to the tasks. A window can't hold the proportions of more.
MOST_SOURCES = 1_000_000
#: Rows of (task, source) that are sent to the tasks; more are joined by a shuffle.
MOST_STARTS = 200_000
#: Stretches of text whose ids are remembered, twice so many at most, in some 100 MB, and the longest of them.
MEMORY, LONGEST = 200_000, 64
SLAB_BYTES = 2_000_000
#: Added to deficits, as a target that is a whole number may come out a little less in floating point.
ROUNDING = 0.01
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
QUEUED = "doc_id long, source string, queue string, start long, length long, doc_tokens long, ids binary, task int, before long"


class WordEndTransducer(MergeTransducer):
    """The merge rules of a vocabulary that marks the ends of words, for words of a to z and the small letters from ß to ÿ.

    What ends its word is another symbol, here its byte with the high bit turned, so the rules are those of plain bytes.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        mark = model["end_of_word_suffix"]
        # Byte-level files write bytes as printable characters: printable Latin-1 as itself, the rest from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}

        def raw(token: str) -> bytes | None:
            core = bytes(byte_of[c] for c in token.removesuffix(mark))
            ends = token.endswith(mark)
            if not core or not _WORDY[list(core)].all() or ends and core[-1] == 0xC3:
                return None
            return core[:-1] + bytes([core[-1] ^ ends << 7])

        self.token_of = {r: i for t, i in model["vocab"].items() if not t.startswith("<|") and (r := raw(t))}
        self.bytes_of = {i: t for t, i in self.token_of.items()}
        pairs = [(raw(a), raw(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.merge_rank = {(self.token_of[a], self.token_of[b]): (rank, self.token_of[a + b]) for rank, (a, b) in enumerate(pairs) if a in self.token_of and b in self.token_of and a + b in self.token_of}
        self.prefixes = {t[:k] for t in self.token_of for k in range(1, len(t) + 1)}
        self.length = np.zeros(max(self.bytes_of) + 1, np.int32)
        for i, t in self.bytes_of.items():
            self.length[i] = len(t)
        self.split = {}
        for (left, right), (rank, token) in self.merge_rank.items():
            self.split.setdefault(token, (rank, left, right))
        self.fits, self.whole = {}, {}
        self._reset()

    def last_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, and the place of each id's last byte."""
        marked = data.copy()
        marked[ends - 1] ^= 128
        _, last = self.run(marked, starts, ends, True)
        ids, floor, pos = np.full(len(data), -1, np.int64), starts, ends - 1
        while pos.size:
            ids[pos] = last[pos]
            pos = pos - self.length[last[pos]]
            going = pos >= floor
            pos, floor = pos[going], floor[going]
        where = np.flatnonzero(ids >= 0)
        return ids[where], where


#: Bytes of words that the transducer reads; kinds of bytes: a gap, of a word, a sign or digit of its own, all else.
_WORDY = np.array([97 <= c <= 122 or c == 0xC3 or 0x9F <= c <= 0xBF and c != 0xB7 for c in range(256)])
_GAP, _WORD, _SINGLE, _OTHER = 0, 1, 2, 3
_KIND = np.array([_GAP if c == 32 or 9 <= c <= 13 else _WORD if 97 <= c <= 122 else _SINGLE if 33 <= c <= 126 and c != 39 else _OTHER for c in range(256)], np.uint8)


class StretchIds:
    """Ids of whole texts of a vocabulary that drops white space and case and splits letters, single digits and runs of other signs.

    Such a vocabulary never looks across white space, so the ids of a text are those of its stretches in a row. Most stretches are
    words of letters with single signs or digits among them: their words all run through the transducer side by side. Any
    other stretch, one with an apostrophe or other letters or two signs together, is given to the library once and remembered.
    Case is lowered here in A-Z and À-Þ only, and only in texts without marks that combine with a letter (U+0300 to
    U+036F, whose first byte is CC or CD) and without `<|`, which begins special tokens; other texts are stretches for the library. That
    the vocabulary is of this kind is tried once on a sample; another vocabulary is given whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        whole, parts = "Some  WÖRDS,\tit's\r\n57: é. \x0b\x0c?! ok!? a-b c_d", ["some", "wörds", ",", "it's", "5", "7", ":", "é", ".", "?!", "ok", "!?", "a", "-", "b", "c", "_", "d"]
        self.splits = self._ids([whole])[0] == b"".join(self._ids(parts))
        if self.splits:
            self.merges = WordEndTransducer(path)
            own = self._ids([chr(c) for c in range(128)])
            self.single = np.array([np.frombuffer(i, self.kind)[0] if len(i) == self.kind.itemsize else -1 for i in own] + [-1] * 128, np.int64)
            self.kinds = np.where((_KIND == _SINGLE) & (self.single < 0), _OTHER, _KIND).astype(np.uint8)
        self.known: dict[bytes, np.ndarray] = {}
        self.before: dict[bytes, np.ndarray] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes of `kind`. Broken UTF-8 is read with replacement characters."""
        if not self.splits:
            return self._ids([t.decode("utf-8", "replace") for t in texts])
        plain = [b"<|" not in t and b"\xcc" not in t and b"\xcd" not in t for t in texts]
        data = np.frombuffer(bytearray(b"\n".join(t.lower() if p else t for t, p in zip(texts, plain, strict=True)) + b"\n"), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        kinds = self.kinds[data]
        pair = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        capital = pair[data[pair + 1] <= 0x9E]
        for text in np.flatnonzero(~np.array(plain)):  # texts for the library as they are
            kinds[ends[text] - 1 - len(texts[text]) : ends[text] - 1] = np.where(kinds[ends[text] - 1 - len(texts[text]) : ends[text] - 1] == _GAP, _GAP, _OTHER)
        whole = np.repeat(np.array(plain), np.diff(np.concatenate([[0], ends])))
        pair, capital = pair[whole[pair]], capital[whole[capital]]
        data[capital + 1] += 0x20
        kinds[pair] = kinds[pair + 1] = _WORD

        # Stretches, and which of them hold what the transducer does not read.
        filled = np.concatenate([[False], kinds != _GAP, [False]])
        edges = np.flatnonzero(filled[1:] != filled[:-1])
        starts, stops = edges[::2], edges[1::2]
        if not len(starts):
            return [b""] * len(texts)
        odd = kinds == _OTHER
        odd[:-1] |= (kinds[:-1] == _SINGLE) & (kinds[1:] == _SINGLE) & ~(_DIGIT[data[:-1]] | _DIGIT[data[1:]])
        letters = np.concatenate([[False], kinds == _WORD, [False]])
        turns = np.flatnonzero(letters[1:] != letters[:-1])
        begin, end = turns[::2], turns[1::2]
        odd[begin[end - begin > LONG_BYTES]] = True
        strange = np.logical_or.reduceat(odd, starts)
        of_word = np.searchsorted(starts, begin, side="right") - 1
        clean = ~strange[of_word]
        ids, places = self.merges.last_bytes(data, begin[clean], end[clean])
        signs = np.flatnonzero(kinds == _SINGLE)
        signs = signs[~strange[np.searchsorted(starts, signs, side="right") - 1]]
        parts, at = [ids, self.single[data[signs]]], [places, signs]
        if strange.any():
            rest = np.flatnonzero(strange)
            raw = data.tobytes()
            found = self._meet([raw[a:b] for a, b in zip(starts[rest].tolist(), stops[rest].tolist(), strict=True)])
            parts.append(np.concatenate(found).astype(np.int64))
            at.append(np.repeat(starts[rest], [len(f) for f in found]))
        where = np.concatenate(at)
        order = np.argsort(where, kind="stable")
        flat = np.concatenate(parts)[order].astype(self.kind).tobytes()
        cuts = (np.searchsorted(where[order], np.concatenate([[0], ends])) * self.kind.itemsize).tolist()
        return [flat[a:b] for a, b in pairwise(cuts)]

    def _meet(self, stretches: list[bytes]) -> list[np.ndarray]:
        """Ids of each of these. Once enough are remembered, they are those of the time before, which go unless met again."""
        new = []
        for stretch in set(stretches).difference(self.known):
            ids = self.before.get(stretch)
            if ids is None:
                new.append(stretch)
            else:
                self.known[stretch] = ids
        for stretch, ids in zip(new, self._ids([s.decode("utf-8", "replace") for s in new]), strict=True):
            self.known[stretch] = np.frombuffer(ids, self.kind)
        found = [self.known[s] for s in stretches]
        if len(self.known) > MEMORY:
            self.known, self.before = {}, {s: i for s, i in self.known.items() if len(s) <= LONGEST} if len(self.known) <= 2 * MEMORY else {}
        return found


@functools.cache
def stretch_ids(path: str) -> StretchIds:
    return StretchIds(path)


def queued_pieces(docs: DataFrame, tokenizer_path: str, most: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pieces of at most `most` tokens in the order of their queues: doc_id, source, queue, start, length, doc_tokens, ids, task, before.

    before counts the tokens of the same queue that the same task made before. queue is the source with a letter in front, so the
    null source has a name too. Null texts have the end-of-text id alone. No shuffle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, task, given = stretch_ids(tokenizer_path), TaskContext.get().partitionId(), {}
        step = most * machine.kind.itemsize
        end = np.array([END_OF_TEXT], machine.kind).tobytes()
        for batch in batches:
            names, sources = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            column, row = batch.column(1), 0
            while row < batch.num_rows:
                texts, held, first = [], 0, row
                while row < batch.num_rows and held < SLAB_BYTES:
                    value = column[row].as_buffer() if column[row].is_valid else None
                    texts.append(value.to_pybytes() if value is not None else b"")
                    held += len(texts[-1])
                    row += 1
                rows = []
                for k, ids in enumerate(machine.encode(texts), first):
                    ids += end
                    queue = "n" if sources[k] is None else "s" + sources[k]
                    before, total = given.get(queue, 0), len(ids) // machine.kind.itemsize
                    for at in range(0, len(ids), step):
                        part = ids[at : at + step]
                        length = len(part) // machine.kind.itemsize
                        rows.append((names[k], sources[k], queue, at // machine.kind.itemsize, length, total, part, task, before))
                        before += length
                    given[queue] = before
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "queue", "start", "length", "doc_tokens", "ids", "task", "before"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), F.col(source).cast("string").alias("source"))
    return given.mapInArrow(given_back(cut), QUEUED)


class Mixture:
    """Targets: tokens each queue should have given by a place in the line of all tokens.

    The line runs through virtual time: a queue of weight w gives w tokens in a unit of it until it ends; then the others go on.
    """

    def __init__(self, sizes: dict[str, int], weights: dict[str | None, float] | None) -> None:
        self.names = sorted(sizes)
        self.size = np.array([sizes[n] for n in self.names], float)
        self.total = sum(sizes.values())
        # Without weights: the proportions of all tokens, so that all queues end together.
        self.weight = self.size if weights is None else np.array([float(weights.get(None if n == "n" else n[1:], 1)) for n in self.names])
        if (self.weight <= 0).any():
            raise ValueError("weights must be positive, as every document is packed")
        ends = np.divide(self.size, self.weight)
        order = np.argsort(ends, kind="stable")
        self.times = np.concatenate([[0.0], ends[order]])
        rates = np.concatenate([np.cumsum(self.weight[order][::-1])[::-1], [0.0]])
        self.places = np.concatenate([[0.0], np.cumsum(np.diff(self.times) * rates[:-1])])

    def place(self, queue: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Where in the line a queue's token number `given` is due."""
        return np.interp(given / self.weight[queue], self.times, self.places)

    def targets(self, queues: np.ndarray, place: float) -> np.ndarray:
        return np.minimum(self.size[queues], self.weight[queues] * np.interp(place, self.places, self.times))


def window_ends(first: int, last: int, total: int, capacity: int) -> list[tuple[int, int, int]]:
    """Windows that meet [first, last) of a line of `total` tokens: number, first and last token. The rest of the line after its
    last full window is cut into windows of powers of two."""
    full, found = total // capacity, []
    for number in range(first // capacity, min(full, -(-last // capacity))):
        found.append((number, number * capacity, (number + 1) * capacity))
    number, at = full, full * capacity
    while at < total and last > at:
        size = 1 << (total - at).bit_length() - 1
        if first < at + size:
            found.append((number, at, at + size))
        number, at = number + 1, at + size
    return found


def round_robin(left: np.ndarray, served: np.ndarray, mixture: Mixture, queues: np.ndarray, windows: list[tuple[int, int, int]], first: int, last: int, turn: int) -> Iterator[tuple[int, int, int, int]]:
    """Turns (queue, tokens, sequence, offset) that use up `left`, the tokens of each queue here; `served` is what each gave before."""
    left, served, at_ring = left.copy(), served.astype(float), 0
    for number, begin, end in windows:
        place, stop = max(begin, first), min(end, last)
        room, offset = stop - place, place - begin
        deficit = mixture.targets(queues, stop) - served + ROUNDING
        ring = np.roll(np.arange(len(queues)), -at_ring)
        for q in ring[(deficit[ring] >= turn) & (left[ring] > 0)].tolist():
            take = min(room, int(left[q]), int(deficit[q]))
            yield q, take, number, offset
            left[q] -= take
            served[q] += take
            deficit[q] -= take
            room, offset, at_ring = room - take, offset + take, q + 1
            if not room:
                break
        while room:
            q = int(np.argmax(np.where(left > 0, deficit, -np.inf)))
            take = min(room, int(left[q]), max(turn, int(deficit[q])))
            yield q, take, number, offset
            left[q] -= take
            served[q] += take
            deficit[q] -= take
            room, offset = room - take, offset + take


def mix_pack(docs: DataFrame, tokenizer_path: str, weights: dict[str | None, float] | None = None, capacity: int = CAPACITY, turn: int = TURN, part_tokens: int = PART_TOKENS, keep_ids: bool = True, **columns: str) -> DataFrame:
    """Pieces of all documents: doc_id, source, start, length, doc_tokens, ids_crc32, sequence_id, offset and, if asked, ids.

    weights: target proportions by source (others 1); none: those of all tokens. Every document is packed, so where a queue
    ends the others keep their proportions. Each token lies in one piece; sequences hold `capacity` tokens but for the last
    ones, which are powers of two. A document is its ids and an end-of-text id; null texts are empty; null sources are one source.
    Repeated rows have pieces of their own; an empty table gives an empty table; other columns are not looked at.

    The token ids are written once into the checkpoint folder and shuffled once. With keep_ids=False the result is
    checkpointed and the ids removed.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/queues-{uuid.uuid4().hex}"
    queued_pieces(docs, tokenizer_path, min(capacity, CAPACITY), **columns).write.option("compression", "zstd").parquet(folder)
    pieces = spark.read.schema(QUEUED).parquet(folder)
    given = pieces.groupBy("task", "queue").agg(F.sum("length").alias("tokens")).checkpoint()
    rows = given.groupBy("queue").agg(F.sum("tokens").alias("tokens")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    mixture = Mixture({r.queue: r.tokens for r in rows}, weights)
    number = {name: k for k, name in enumerate(mixture.names)}

    @F.pandas_udf("long")
    def part_of(queue, at):
        codes = queue.map(number).to_numpy()
        return pd.Series(np.floor(mixture.place(codes, at.to_numpy().astype(float)) / part_tokens).astype("int64"))

    so_far = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = given.select("task", "queue", F.coalesce(F.sum("tokens").over(so_far), F.lit(0)).alias("begin"))
    starts = F.broadcast(starts) if given.count() <= MOST_STARTS else starts
    dealt = pieces.join(starts, ["task", "queue"]).withColumn("at", F.col("before") + F.col("begin")).drop("task", "before", "begin")
    dealt = dealt.withColumn("part", part_of("queue", "at"))

    # What each queue gave before a partition, and where the partition begins in the line: sums over blocks of partitions, then inside.
    held = dealt.groupBy("part", "queue").agg(F.sum("length").alias("tokens"), F.min("at").alias("served"))
    held = held.withColumn("block", F.expr("part div 1024")).checkpoint()
    before = lambda *keys: Window.partitionBy(*keys).orderBy(F.col("part" if keys else "block")).rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("block", "part").agg(F.sum("tokens").alias("tokens"))
    blocks = parts.groupBy("block").agg(F.sum("tokens").alias("tokens")).select("block", F.coalesce(F.sum("tokens").over(before()), F.lit(0)).alias("base"))
    lines = parts.join(blocks, "block").select("part", (F.col("base") + F.coalesce(F.sum("tokens").over(before("block")), F.lit(0))).alias("line"), F.col("tokens").alias("part_tokens"))
    states = held.select("part", "queue", "served").join(lines, "part")

    kinds = {"doc_id": "long", "source": "string", "start": "long", "length": "long", "doc_tokens": "long", "ids_crc32": "long", "sequence_id": "long", "offset": "long"} | ({"ids": "array<int>"} if keep_ids else {})
    arrow = [pa.int64(), pa.string(), *[pa.int64()] * 6] + [pa.list_(pa.int32())] * keep_ids
    total = mixture.total

    def place(rows: pa.Table, state: pa.Table) -> pa.Table:
        out = [[] for _ in kinds]
        if rows.num_rows:
            state = {r["queue"]: r for r in state.to_pylist()}
            names = sorted(state)
            queues = np.array([number[n] for n in names])
            line, tokens = next((r["line"], r["part_tokens"]) for r in state.values())
            rows = rows.sort_by([("queue", "ascending"), ("at", "ascending")])
            queue = rows.column("queue").to_pylist()
            docs_, sources, begins, totals = (rows.column(c).to_pylist() for c in ("doc_id", "source", "start", "doc_tokens"))
            lengths = rows.column("length").to_numpy()
            ids = rows.column("ids").combine_chunks()
            first = {n: k for k, n in reversed(list(enumerate(queue)))}
            cursor = [first[n] for n in names]  # the piece that a queue gives next, and how much of it is gone
            gone = [0] * len(names)
            place_of = {n: k for k, n in enumerate(names)}
            left = np.bincount([place_of[n] for n in queue], lengths, len(names)).astype(np.int64)
            served = np.array([state[n]["served"] for n in names])
            kind = "<u2" if len(ids[0].as_buffer()) == 2 * lengths[0] else "<u4"
            for q, take, sequence, offset in round_robin(left, served, mixture, queues, window_ends(line, line + tokens, total, capacity), line, line + tokens, turn):
                while take:
                    k = cursor[q]
                    length = min(take, int(lengths[k]) - gone[q])
                    own = np.frombuffer(ids[k].as_buffer(), kind)[gone[q] : gone[q] + length].astype("<u4")
                    row = (docs_[k], sources[k], begins[k] + gone[q], length, totals[k], zlib.crc32(own.tobytes()), sequence, offset)
                    for column, value in zip(out, (*row, own.astype(np.int32)) if keep_ids else row, strict=True):
                        column.append(value)
                    take, offset, gone[q] = take - length, offset + length, gone[q] + length
                    if gone[q] == lengths[k]:
                        cursor[q], gone[q] = k + 1, 0
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, arrow, strict=True)], names=list(kinds))

    packed = dealt.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(place, ", ".join(f"{c} {t}" for c, t in kinds.items()))
    if keep_ids:
        return packed
    packed = packed.checkpoint()
    remove_folder(spark, folder)
    return packed
