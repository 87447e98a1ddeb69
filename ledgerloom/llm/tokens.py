"""Token counts and ids by compiled finite-state transducers.

Two deterministic machines read a text.

* The splitter reads character classes and says where a pre-token starts. It has nine states, so a chunk of
  text is a map from entry state to exit state; the maps of all chunks compose by a parallel prefix scan, and
  each chunk is then read once from its known entry state.
* The merge transducer reads the bytes of a pre-token. After any prefix, the last token of the prefix's encoding
  is fixed by the last tokens at the few positions inside the longest suffix that begins a vocabulary entry; that
  window is the state. A transition carries the number of tokens it adds (negative where a longer token replaces
  shorter ones), so the sum along the path is the token count. States are compiled when first met, and the table
  starts anew at a fixed size, as memory must not grow with the corpus.

Both machines restart at a pre-token, so all pre-tokens of a batch run side by side, one array step a byte.

A pre-token of more than LONG_BYTES is cut into chunks that run side by side too. A chunk starts WARM_UP bytes early as if
its word began there; its map sends one entry, the window of last tokens it has by its first byte, to its exit. The maps
compose in order: where a chunk's entry is the exit of the chunk before, as is nearly always so, its result stands; else it
runs again from the true entry, and equal chunks with equal entries are run once. These long stretches meet few states
twice, so their steps are computed from the merge rules directly and nothing is compiled for them.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Character classes of the splitter; CUT marks the first character of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANKS, LAST, CUT = 0, 1, 2, 3, 4, 5, 6, 7, 8
# Splitter states.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, AFTER_SPACE, ONE_LEFT, TWO_LEFT, N_STATES = 0, 1, 2, 3, 4, 5, 6, 7, 8
CHUNK = 2048
STATE_LIMIT = 400_000
BATCH_BYTES = 2_000_000
LONG_BYTES, LONG_CHUNK, LANES, REMEMBERED = 256, 1024, 1024, 512
_SHIFT, _BIAS = 7, 96


@functools.cache
def _class_table() -> np.ndarray:
    """Class of each code point, without what depends on its neighbours."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    # Code points of the White_Space property.
    for cp in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[cp] = BLANKS
    return table


@functools.cache
def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a pre-token starts here", by state and class (classes from CUT on: first of a text)."""
    after = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT: ONE_LEFT, LONG: TWO_LEFT, SPACE: AFTER_SPACE, BLANKS: IN_BLANKS, LAST: FRESH}
    joins = {(IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_BLANKS, BLANKS)} | {(s, c) for s in (IN_OTHER, AFTER_SPACE) for c in (OTHER, SHORT, LONG)} | {(AFTER_SPACE, LETTER), (AFTER_SPACE, NUMBER)}
    state, starts = np.zeros((N_STATES, 16), np.uint8), np.zeros((N_STATES, 16), bool)
    for s in range(N_STATES):
        for c in range(8):
            if s == TWO_LEFT:
                state[s, c], starts[s, c] = ONE_LEFT, False
            elif s == ONE_LEFT:
                state[s, c], starts[s, c] = FRESH, False
            elif (s, c) in joins:
                state[s, c], starts[s, c] = (IN_OTHER if c in (OTHER, SHORT, LONG) else after[c]), False
            else:
                state[s, c], starts[s, c] = after[c], True
            state[s, c + CUT], starts[s, c + CUT] = after[c], True
    return state, starts


def _classes(data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all characters and their classes, given what follows each."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[at].astype(np.int32)
    wide = np.flatnonzero(cp >= 0x80)
    if wide.size:
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        p, lead = at[wide], cp[wide]
        b1, b2, b3 = padded[p + 1] & 63, padded[p + 2] & 63, padded[p + 3] & 63
        two, three = (lead & 31) << 6 | b1, (lead & 15) << 12 | b1 << 6 | b2
        cp[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, ((lead & 7) << 18 | b1 << 12 | b2 << 6 | b3) & 0x1FFFFF))
    kind = _class_table()[np.minimum(cp, 0x10FFFF)]
    first = np.zeros(len(at) + 1, bool)
    first[np.searchsorted(at, text_starts)] = True
    first[-1] = True
    blank = np.append(kind == BLANKS, True)
    ends_run = (kind == BLANKS) & ~blank[1:] & ~first[1:]
    kind[ends_run] = LAST
    kind[ends_run & (cp == 32)] = SPACE
    # The contractions 's 't 'm 'd and 're 've 'll.
    quotes = np.flatnonzero(cp == 39)
    if quotes.size:
        after = np.concatenate([cp, [0, 0]])
        n1 = np.where(first[quotes + 1], 0, after[quotes + 1])
        n2 = np.where(first[np.minimum(quotes + 2, len(at))], 0, after[quotes + 2])
        kind[quotes[np.isin(n1, [ord(c) for c in "stmd"])]] = SHORT
        kind[quotes[((n1 == ord("r")) | (n1 == ord("v"))) & (n2 == ord("e")) | (n1 == ord("l")) & (n2 == ord("l"))]] = LONG
    kind[first[:-1]] += CUT
    return at, kind


def _pretoken_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Byte offsets of all pre-tokens: chunk state maps, their prefix scan, then one pass over the chunks."""
    at, kind = _classes(data, text_starts)
    n = len(kind)
    chunks = -(-n // CHUNK)
    lanes = np.zeros(chunks * CHUNK, np.uint8)
    lanes[:n] = kind
    columns = np.ascontiguousarray(lanes.reshape(chunks, CHUNK).T)
    state, starts = (t.ravel() for t in _splitter())
    state = state.astype(np.intp) * 16
    # The map of each chunk: exit state by entry state; once all entries agree, one of them stands for all.
    maps = np.repeat(np.arange(N_STATES)[:, None] * 16, chunks, 1)
    for j in range(CHUNK):
        maps = state[maps + columns[j]]
        if j % 16 == 15 and maps.shape[0] > 1 and (maps == maps[0]).all():
            maps = maps[:1]
    maps = np.broadcast_to(maps, (N_STATES, chunks)) if maps.shape[0] == 1 else maps
    # Hillis-Steele scan: after it, column k maps the entry of chunk 0 to the exit of chunk k.
    scanned, step = maps.copy(), 1
    while step < chunks:
        scanned[:, step:] = np.take_along_axis(scanned[:, step:], scanned[:, :-step] // 16, 0)
        step *= 2
    entry = np.zeros(chunks, np.intp)
    entry[1:] = scanned[FRESH, :-1]
    flags = np.empty((CHUNK, chunks), bool)
    for j in range(CHUNK):
        index = entry + columns[j]
        flags[j] = starts[index]
        entry = state[index]
    return at[np.flatnonzero(flags.T.ravel()[:n])]


class MergeTransducer:
    """The merge rules of a byte-level vocabulary as a lazily compiled transducer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        # Byte-level files write bytes as printable characters: printable Latin-1 as itself, the rest from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.token_of = {raw(t): i for t, i in model["vocab"].items() if t not in added}
        self.special = {t.encode(): i for t, i in added.items()}
        self.bytes_of = {i: t for t, i in self.token_of.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge_rank = {(self.token_of[raw(a)], self.token_of[raw(b)]): (rank, self.token_of[raw(a) + raw(b)]) for rank, (a, b) in enumerate(pairs)}
        self.prefixes = {t[:k] for t in self.token_of for k in range(1, len(t) + 1)}
        self.length = np.zeros(max([*self.bytes_of, *self.special.values()]) + 1, np.int32)
        for i, t in self.bytes_of.items():
            self.length[i] = len(t)
        self.split: dict[int, tuple[int, int, int]] = {}  # the merge that makes each token: rank, left, right
        for (left, right), (rank, token) in self.merge_rank.items():
            self.split.setdefault(token, (rank, left, right))
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self._reset()
        # The same as arrays, for stretches that run without states: tokens as a trie by node * 256 + byte, merges by
        # left * size + right, and the merge that makes each token.
        self.size, self.longest = len(self.length), max(map(len, self.bytes_of.values()))
        node_of = {b"": 0} | {t: i for i, t in enumerate(sorted(self.prefixes), 1)}
        edges = sorted((node_of[t[:-1]] * 256 + t[-1], node) for t, node in node_of.items() if t)
        self.edge_key, self.edge_node = (np.array(c, np.int64) for c in zip(*edges))
        self.token_at = np.full(len(node_of), -1, np.int32)
        for t, i in self.token_of.items():
            self.token_at[node_of[t]] = i
        merges = sorted((left * self.size + right, rank) for (left, right), (rank, _) in self.merge_rank.items())
        self.merge_key, self.merge_order = (np.array(c, np.int64) for c in zip(*merges))
        self.made = np.full((3, self.size), -1, np.int64)  # rank, left and right
        for token, made in self.split.items():
            self.made[:, token] = made

    def _reset(self) -> None:
        """State 0 is the start. Transitions stand in an open-addressing table by state * 256 + byte."""
        self.keys: list[bytes] = []
        self.index: dict[bytes, int] = {}
        self.last = np.zeros(4096, np.int32)
        self.bits, self.used = 16, 0
        self.slots, self.values = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int32)
        self._state(b"", (-1,), (0,))

    def _state(self, window: bytes, lasts: tuple, counts: tuple) -> int:
        n = len(lasts)
        key = struct.pack(f"<{n}i{n}b", *lasts, *counts) + window
        found = self.index.get(key)
        if found is None:
            found = self.index[key] = len(self.keys)
            self.keys.append(key)
            if found >= len(self.last):
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            self.last[found] = lasts[-1]
        return found

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """Values of the transitions, -1 where one is not compiled yet."""
        slot = self._slot(keys)
        held = self.slots[slot]
        out = np.where(held == keys, self.values[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slots[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        while (self.used + len(keys)) * 2 > 1 << self.bits:
            old = self.slots >= 0
            old_keys, old_values = self.slots[old], self.values[old]
            self.bits, self.used = self.bits + 1, 0
            self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
            self._insert(old_keys, old_values)
        self.used += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.slots[slot] < 0
            self.slots[slot[free]], self.values[slot[free]] = keys[free], values[free]
            lost = self.slots[slot] != keys  # taken, or claimed by two at once
            self.values[slot[~lost]] = values[~lost]
            keys, values, slot = keys[lost], values[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def encode_directly(self, text: bytes) -> list[int]:
        """Merge by merge, lowest rank first; only for compiling and tests."""
        parts = [self.token_of[text[i : i + 1]] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [(self.merge_rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.merge_rank]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [self.merge_rank[parts[i], parts[i + 1]][1]]
        return parts

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether the two, side by side, stay two tokens.

        Undoing the younger of the two outermost merges again and again gives each pair of pieces that ever meets at
        the seam; the two merge only if such a pair has a merge older than the step that ends its meeting.
        """
        got = self.fits.get((before, token))
        if got is not None:
            return got
        left, right, limit, got = before, token, 1 << 30, True
        while True:
            merge = self.merge_rank.get((left, right))
            if merge is not None and merge[0] < limit:
                got = False
                break
            a, b = self.split.get(left), self.split.get(right)
            if a is None and b is None:
                break
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]
        if len(self.fits) > 500_000:
            self.fits.clear()
        self.fits[before, token] = got
        return got

    def _reachable(self, token: int) -> bool:
        got = self.whole.get(token)
        if got is None:
            got = self.whole[token] = self.encode_directly(self.bytes_of[token]) == [token]
        return got

    def _compile(self, state: int, byte: int) -> int:
        """The transition on a byte. A state is (window, last tokens, counts): the last token and the token count at
        each position from the window's start to here, counts relative to here, -1 for no token before."""
        key = self.keys[state]
        n = (len(key) + 1) // 6  # n last tokens of 4 bytes, n counts, n - 1 bytes of window
        lasts, counts = struct.unpack_from(f"<{n}i", key), struct.unpack_from(f"<{n}b", key, 4 * n)
        grown = key[5 * n :] + bytes([byte])
        for start in range(n):
            token = self.token_of.get(grown[start:])
            if token is not None and (self._may_follow(lasts[start], token) if lasts[start] >= 0 else self._reachable(token)):
                break
        else:
            raise ValueError(f"no token ends with {grown!r}")
        added = counts[start] + 1
        keep = next(k for k in range(n + 1) if k == n or grown[k:] in self.prefixes)
        target = self._state(grown[keep:], (*lasts[keep:], token), (*[c - added for c in counts[keep:]], 0))
        if not -_BIAS < added < 128 - _BIAS:
            raise ValueError("a transition adds too many tokens")
        return target << _SHIFT | (added + _BIAS)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep_last: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Token count of each pre-token and, if asked, the last token at each byte."""
        if len(self.keys) > STATE_LIMIT:
            self._reset()
        lengths = ends - starts
        counts, last = np.zeros(len(starts), np.int64), np.zeros(len(data), np.int32) if keep_last else None
        short = np.flatnonzero(lengths <= LONG_BYTES)
        order = short[np.argsort(lengths[short].astype(np.uint16), kind="stable")[::-1]]  # radix sort
        at, left = starts[order], lengths[order]
        active = np.searchsorted(-left, -np.arange(1, (left[0] if left.size else 0) + 1), side="right")
        state, total = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        unfinished = np.zeros(0, np.int64)
        for j, n in enumerate(active):
            here = at[:n] + j
            index = (state[:n].astype(np.int64) << 8) | data[here]
            moved = self._lookup(index)
            if (gaps := moved < 0).any():
                keys = np.unique(index[gaps])
                if len(self.keys) + len(keys) > 2 * STATE_LIMIT:  # these stretches fill the table: what is left goes on without
                    unfinished, order, total = order[:n], order[n:], total[n:]
                    break
                self._insert(keys, np.array([self._compile(k >> 8, k & 255) for k in keys.tolist()], np.int32))
                moved = self._lookup(index)
            state[:n] = moved >> _SHIFT
            total[:n] += (moved & ((1 << _SHIFT) - 1)) - _BIAS
            if keep_last:
                last[here] = self.last[state[:n]]
        counts[order] = total
        rest = np.concatenate([unfinished, np.flatnonzero(lengths > LONG_BYTES)])
        if rest.size:
            counts[rest] = self._long(data, starts[rest], ends[rest], last)
        return counts, last

    def _stay(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """_may_follow of many pairs; where there is no token before (-1), whether the token is its own encoding."""
        out = np.ones(len(token), bool)
        for i in np.flatnonzero(before < 0):
            out[i] = self._reachable(int(token[i]))
        at = np.flatnonzero(before >= 0)
        left, right, limit = before[at].astype(np.int64), token[at].astype(np.int64), np.full(len(at), 1 << 40)
        while at.size:
            key = left * self.size + right
            place = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
            merged = (self.merge_key[place] == key) & (self.merge_order[place] < limit)
            out[at[merged]] = False
            a, b = self.made[0, left], self.made[0, right]
            go = ~merged & ((a >= 0) | (b >= 0))
            at, left, right, a, b = at[go], left[go], right[go], a[go], b[go]
            undo_left = (b < 0) | (a > b)
            limit = np.where(undo_left, a, b + 1)
            left, right = np.where(undo_left, self.made[2, left], left), np.where(undo_left, right, self.made[1, right])
        return out

    def _ending(self, data: np.ndarray, floor: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that end at each byte, longest first, and where each byte's begin; all within their own stretch."""
        stop = np.repeat(ends, ends - floor)
        at, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        where, tokens = [], []
        for k in range(self.longest):
            inside = at + k < stop[at]
            at, node = at[inside], node[inside]
            if not at.size:
                break
            key = node * 256 + data[at + k]
            place = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            hit = self.edge_key[place] == key
            at, node = at[hit], self.edge_node[place[hit]]
            token = self.token_at[node]
            where.append((at + k)[token >= 0])
            tokens.append(token[token >= 0])
        where, tokens = np.concatenate(where[::-1]), np.concatenate(tokens[::-1])
        order = np.argsort(where, kind="stable")
        return tokens[order], np.searchsorted(where[order], np.arange(len(data) + 1))

    def _lanes(self, begins: np.ndarray, stops: np.ndarray, known: np.ndarray, width: int, tokens: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Last tokens of lanes, one step a byte for all: lane i from begins[i] to stops[i], behind `width` known columns
        (-1: the lane's word starts at its first byte; what lies further back is not asked for)."""
        steps = int((stops - begins).max())
        out = np.full((len(begins), width + steps), -1, np.int32)
        out[:, :width] = known
        lane_of, reach = np.arange(len(begins)), width - (known >= 0).sum(1)  # first column a token may start behind
        for j in range(steps):
            open_ = lane_of[begins + j < stops]
            pick = cut[begins[open_] + j]
            while open_.size:
                token = tokens[pick]
                column = width + j - self.length[token]  # where the token before ends
                inside = column >= reach[open_] - 1
                before = np.where(column >= reach[open_], out[open_, np.maximum(column, 0)], -1)
                fits = inside.copy()
                fits[inside] = self._stay(before[inside], token[inside])
                out[open_[fits], width + j] = token[fits]
                open_, pick = open_[~fits], pick[~fits] + 1
                if open_.size and (pick >= cut[begins[open_] + j + 1]).any():
                    raise ValueError("no token ends here")
        return out[:, width:]

    def _stretch(self, data: np.ndarray, slices: list[tuple[int, int, int]], tails: list[np.ndarray]) -> list[np.ndarray]:
        """Last tokens of the bytes from `first` on of each slice (start, first, stop), side by side.

        Up to `first`, the tail says them; a slice without a tail starts with its word.
        """
        window, warm_up = self.longest, 2 * self.longest
        own = np.concatenate([data[a:b] for a, _, b in slices])
        stop = np.cumsum([b - a for a, _, b in slices])
        floor = stop - np.array([b - a for a, _, b in slices])
        first = floor + np.array([f - a for a, f, _ in slices])
        tokens, cut = self._ending(own, floor, stop)
        chunks = -(-(stop - first) // LONG_CHUNK)
        word = np.repeat(np.arange(len(slices)), chunks)
        begin = first[word] + LONG_CHUNK * (np.arange(len(word)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
        end = np.minimum(begin + LONG_CHUNK, stop[word])
        early = np.maximum(begin - warm_up, floor[word])
        found = np.full(len(own), -1, np.int32)
        for k, tail in enumerate(tails):
            found[floor[k] : first[k]] = tail
        entry = np.full((len(word), window), -1, np.int32)  # each chunk's window before its first byte
        lanes = self._lanes(early, end, np.full((len(word), 1), -1, np.int32), 1, tokens, cut)
        for i, lane in enumerate(lanes):
            shift = int(begin[i] - early[i])
            found[begin[i] : end[i]] = lane[shift : shift + int(end[i] - begin[i])]
            back = min(shift, window)
            entry[i, window - back :] = lane[shift - back : shift]
        # Compose: a chunk stands if its entry is what the chunk before really leaves.
        seen: dict[bytes, np.ndarray] = {}
        for c in np.flatnonzero(begin > floor[word]).tolist():
            back = min(window, int(begin[c] - floor[word[c]]))
            true = np.full(window, -1, np.int32)
            true[window - back :] = found[begin[c] - back : begin[c]]
            if (true == entry[c]).all():
                continue
            key = own[begin[c] - back : end[c]].tobytes() + true.tobytes()
            if key not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[key] = self._lanes(begin[c : c + 1], end[c : c + 1], true[None, :], window, tokens, cut)[0].copy()
            found[begin[c] : end[c]] = seen[key]
        return [found[a:b] for a, b in zip(first, stop)]

    def _long(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray | None) -> np.ndarray:
        """Token counts of long pre-tokens; writes the last token at each byte into `last`, if given.

        As many as fill the lanes run together; one that is longer goes in parts, each with the tail of the part before.
        """
        counts, most, warm_up = np.zeros(len(starts), np.int64), LANES * LONG_CHUNK, 2 * self.longest
        group = np.cumsum(ends - starts) // most
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            small = [i for i in mine if ends[i] - starts[i] <= most]
            paths = dict(zip(small, self._stretch(data, [(starts[i], starts[i], ends[i]) for i in small], [])) if small else ())
            for i in set(mine.tolist()) - set(small):
                parts = [np.zeros(0, np.int32)]
                for a in range(int(starts[i]), int(ends[i]), most):
                    tail = parts[-1][-warm_up:]
                    parts += self._stretch(data, [(a - len(tail), a, min(a + most, int(ends[i])))], [tail])
                paths[i] = np.concatenate(parts)
            for i, path in paths.items():
                pos, step = len(path) - 1, self.length[path].tolist()  # plain numbers: the walk back has one step a token
                while pos >= 0:
                    counts[i] += 1
                    pos -= step[pos]
                if last is not None:
                    last[starts[i] : ends[i]] = path
        return counts

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Where the stretches between special strings start and end, and the special strings: (row, byte, id)."""
        found = []
        if self.special:
            raw = data.tobytes()
            if any(s in raw for s in self.special):
                for m in re.finditer(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))), raw):
                    row = int(np.searchsorted(offsets, m.start(), side="right")) - 1
                    if m.end() <= offsets[row + 1]:
                        found.append((row, m.start(), m.end(), self.special[m[0]]))
        starts, ends = offsets[:-1], offsets[1:]
        if found:
            starts = np.sort(np.concatenate([starts, [e for _, _, e, _ in found]]))
            ends = np.sort(np.concatenate([ends, [s for _, s, _, _ in found]]))
        full = ends > starts
        return starts[full], ends[full], [(row, s, i) for row, s, _, i in found]

    def _pretokens(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, special = self.pieces(data, offsets)
        if not starts.size:
            empty = np.zeros(0, np.int64)
            return empty, empty, special
        if special:  # the splitter must see neither the special strings nor what lies beyond them
            keep = np.zeros(len(data) + 1, np.int32)
            np.add.at(keep, starts, 1)
            np.add.at(keep, ends, -1)
            kept = np.flatnonzero(np.cumsum(keep[:-1]))
            first = kept[_pretoken_starts(data[kept], np.searchsorted(kept, starts))]
        else:
            first = _pretoken_starts(data, starts)
        after = np.append(first[1:], len(data))
        return first, np.minimum(after, ends[np.searchsorted(ends, first, side="right")]), special

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; text i is data[offsets[i]:offsets[i + 1]]."""
        out = np.zeros(len(offsets) - 1, np.int64)
        first, after, special = self._pretokens(data, offsets)
        if first.size:
            counts, _ = self.run(data, first, after, False)
            running = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            cut = np.searchsorted(first, offsets)
            out += running[cut[1:]] - running[cut[:-1]]
        for row, _, _ in special:
            out[row] += 1
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin and the last ones end."""
        first, after, special = self._pretokens(data, offsets)
        ids = np.full(len(data), -1, np.int32)  # a token stands at its last byte
        if first.size:
            _, last = self.run(data, first, after, True)
            floor, pos = first, after - 1
            while pos.size > 64 or pos.size and (pos - floor).max() < LONG_BYTES:
                token = last[pos]
                ids[pos] = token
                pos = pos - self.length[token]
                going = pos >= floor
                pos, floor = pos[going], floor[going]
            for end, low in zip(pos.tolist(), floor.tolist()):  # few long ones: token by token
                path = last[low : end + 1]
                step, k, marks = self.length[path].tolist(), end - low, []
                while k >= 0:
                    marks.append(k)
                    k -= step[k]
                ids[low + np.array(marks)] = path[marks]
        for _, start, token in special:
            ids[start] = token
        where = np.flatnonzero(ids >= 0)
        return ids[where], np.searchsorted(where, offsets)


@functools.cache
def transducer(path: str) -> MergeTransducer:
    return MergeTransducer(path)


def text_slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of a text column of about `limit` bytes: first row, end row, bytes, offsets. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", bytes_column: str = "n_bytes", tokens_column: str = "n_tokens") -> DataFrame:
    """Adds the UTF-8 length and the token count of each whole text.

    No shuffle: each task counts its own rows. Null texts count as empty (0 bytes, 0 tokens). Repeated rows and all
    other columns are kept; columns that have one of the two new names are replaced. Strings of added special tokens
    count as one token, as the vocabulary's library has it. An empty table gives an empty table.
    """
    docs = docs.drop(bytes_column, tokens_column)
    schema = docs.select("*", F.lit(0).cast("long").alias(bytes_column), F.lit(0).cast("long").alias(tokens_column)).schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for batch in batches:
            n_bytes, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for start, end, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                n_bytes[start:end] = np.diff(offsets)
                n_tokens[start:end] = machine.count(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_bytes), pa.array(n_tokens)], names=[*batch.schema.names, bytes_column, tokens_column])

    return docs.mapInArrow(counted, schema)
