"""Best-fit packing of token sequences with swap-based local search.

Documents longer than a sequence are cut; full pieces fill a sequence alone. The rest is dealt by a hash into shards of
about SHARD_PIECES pieces, and each shard is packed by itself: best fit, longest first, then local search among bins
that are not full. A search step exchanges one piece for one, or two for one, or moves a piece, so that the sum of
squared fills grows; the emptiest bin is the one that gives, so it shrinks until it is gone. A shard ends with about one
bin that is not nearly full, so the loss against packing all at once falls with the shard's size.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import give_back, given_back, shared_folder
from ledgerloom.llm.tokens import text_slices, transducer

END_OF_TEXT = 2
CAPACITY = 1024
SHARD_PIECES = 8_000


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Pieces by bin: longest first, each into the fullest bin that has room."""
    rooms: list[tuple[int, int]] = []  # free tokens and bin, sorted
    bins: list[list[int]] = []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        k = bisect_left(rooms, (need, -1))
        if k == len(rooms):
            bins.append([piece])
            free, place = capacity - need, len(bins) - 1
        else:
            free, place = rooms.pop(k)
            bins[place].append(piece)
            free -= need
        if free:
            insort(rooms, (free, place))
    return bins


class LocalSearch:
    """Bins that are not full, pieces findable by length; empties the emptiest bins into the others."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.bins = bins
        self.fill = [int(sum(lengths[p] for p in b)) for b in bins]

    def _steps(self, source: int, others: list[int]) -> bool:
        """One improving step from the source bin: true if the other bin's fill grew."""
        free = sorted((self.capacity - self.fill[b], b) for b in others)
        rooms = [f for f, _ in free]
        mine: dict[int, list[int]] = {}
        for p in self.bins[source]:
            mine.setdefault(int(self.lengths[p]), []).append(p)
        # Move: the longest piece that fits somewhere goes to the tightest place.
        for length in sorted(mine, reverse=True):
            k = bisect_left(rooms, length)
            if k < len(rooms):
                self._exchange(source, [mine[length][0]], free[k][1], [])
                return True
        # One of mine for one of theirs, and two of mine for one of theirs: the other bin must grow and still hold. All pairs
        # are here, one for each sum: a bin has few different lengths, as they add up to a sequence at most.
        give = {length: [own[0]] for length, own in mine.items()}
        for long, first in mine.items():
            for short, second in mine.items():
                if short < long or short == long and len(first) > 1:
                    give.setdefault(long + short, [first[-1], second[0]])
        sums, best = sorted(give), None
        for room, other in reversed(free):
            if room == 0 or best and best[0] >= room:
                break  # no bin from here on can gain more
            for piece in self.bins[other]:
                # The most that fits for this piece of theirs: gain from 1 to room.
                theirs = int(self.lengths[piece])
                k = bisect_left(sums, theirs + room + 1) - 1
                gain = sums[k] - theirs if k >= 0 else 0
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, give[sums[k]], other, [piece])
        if best:
            self._exchange(source, best[1], best[2], best[3])
            return True
        return False

    def _exchange(self, one: int, out: list[int], two: int, back: list[int]) -> None:
        for p in out:
            self.bins[one].remove(p)
        for p in back:
            self.bins[two].remove(p)
        self.bins[one] += back
        self.bins[two] += out
        moved = int(sum(self.lengths[p] for p in out)) - int(sum(self.lengths[p] for p in back))
        self.fill[one] -= moved
        self.fill[two] += moved

    def run(self) -> list[list[int]]:
        """Steps until none helps or no bin can be saved any more.

        Each step raises the sum of squared fills, as tokens go from the emptiest bin to a fuller one; so it ends. A bin that
        is stuck is offered again in the next round if a step changed another bin since.
        """
        spare = lambda some: sum(self.capacity - self.fill[b] for b in some)
        open_ = lambda some: [b for b in some if self.bins[b] and self.fill[b] < self.capacity]
        changed = True
        while changed and spare(open_(range(len(self.bins)))) >= self.capacity:
            changed, waiting = False, open_(range(len(self.bins)))
            while len(waiting) > 1 and spare(waiting) >= self.capacity:
                source = min(waiting, key=lambda b: self.fill[b])
                if self._steps(source, [b for b in waiting if b != source]):
                    changed, waiting = True, open_(waiting)
                else:
                    waiting.remove(source)
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run() if len(lengths) else []


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, and before them the rest, if any."""
    return [total % capacity] * (total % capacity > 0) + [capacity] * (total // capacity)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked, the token ids.

    A document is its ids and an end-of-text id; a null text is empty and has the end alone. Repeated rows have
    repeated pieces. No shuffle.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for batch in batches:
            names = batch.column(0)
            for start, end, data, offsets in text_slices(batch.column(1)):
                flat, at = machine.encode(data, offsets)
                rows, numbers, starts, lengths, crcs, all_ids = [], [], [], [], [], []
                for row in range(end - start):
                    ids = np.append(flat[at[row] : at[row + 1]], END_OF_TEXT).astype("<u4")
                    begin = 0
                    for number, length in enumerate(cut_lengths(len(ids), capacity)):
                        rows.append(start + row)
                        numbers.append(number)
                        starts.append(begin)
                        lengths.append(length)
                        crcs.append(zlib.crc32(ids[begin : begin + length].tobytes()))
                        if keep_ids:
                            all_ids.append(ids[begin : begin + length].astype(np.int32))
                        begin += length
                doc = names.take(pa.array(rows, pa.int64()))
                columns = [doc, pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                names_ = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names_.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names_)

    shared_folder(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(given_back(cut), schema)


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces; bins have consecutive, gapless offsets.

    The pieces are written to the checkpoint folder and counted. Full pieces are a sequence of their own, with a negative
    number, and don't move. The others are dealt at random (seeded, over fixed files) into shards of about shard_pieces, so a
    shard's columns, token ids included, have a size bound; a sequence_id is the shard times 2 ** 40 plus a number in it.
    """
    shared_folder(cut.sparkSession)
    cut = cut.checkpoint()
    shards = max(1, -(-cut.agg(F.count_if(F.col("length") < capacity)).first()[0] // shard_pieces))
    columns = cut.columns
    full = cut.filter(F.col("length") >= capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = cut.filter(F.col("length") < capacity).withColumn("shard", F.floor(F.rand(11) * shards).cast("long"))

    def place(batch: pa.Table) -> pa.Table:
        lengths = batch.column("length").to_numpy()
        base = int(batch.column("shard")[0].as_py()) << 40 if len(lengths) else 0
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, members in enumerate(pack(lengths, capacity)):
            sequence[members] = base + k
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        give_back()
        return batch.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").applyInArrow(place, full.schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, **columns: str) -> DataFrame:
    """Packs all documents into sequences: pieces with sequence_id and offset. An empty table gives an empty table."""
    return pack_pieces(pieces(docs, tokenizer_path, capacity, keep_ids=keep_ids, **columns), capacity)
