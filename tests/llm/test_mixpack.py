import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm.mixpack import Mixture, StretchIds, mix_pack, round_robin, window_ends

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string"


def checked(rows, got, capacity=4096, path=PATH):
    """Every id of every text lies once, in order, and sequences are full but for powers of two."""
    library = Tokenizer.from_file(path)
    parts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(parts[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert len(parts) == len({i for i, _, _ in rows})
    sizes = []
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == np.cumsum([0, *[r.length for r in members]])[:-1].tolist()
        sizes.append(sum(r.length for r in members))
    short = [s for s in sizes if s != capacity]
    assert all(s & (s - 1) == 0 and s < capacity for s in short) and len(set(short)) == len(short)
    return bins


def made(n, seed):
    rng = random.Random(seed)
    words = ["the", "Tion", "é", "x1", "漢字", "hello,", "it's", "cóte", "ΑΣ", "a b", "<|endoftext|>", "ﬁ", "\x1c"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 700))), rng.choice(["hot"] * 6 + ["b", "c", None])) for i in range(n)]


@pytest.mark.parametrize("part_tokens", [4_000_000, 20_000])
def test_every_token_once_and_no_padding(spark, part_tokens):
    rows = made(150, 3) + [(900, None, "b"), (901, "", None), (902, "\t\n ", "rare"), (903, "word " * 30_000, "c"), (904, "q" * 100_000, "b"), (None, "no name", "b")]
    got = mix_pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, part_tokens=part_tokens).collect()
    checked(rows, got)


def test_windows_hold_the_proportions_of_the_sources(spark):
    rows = made(600, 5)
    got = mix_pack(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH, capacity=1024, turn=64, part_tokens=30_000).collect()
    bins = checked(rows, got, 1024)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.length
    total, given = sum(sizes.values()), Counter()
    for k in range(total // 1024):
        here = Counter()
        for r in bins[k]:
            here[r.source] += r.length
        given += here
        for source, size in sizes.items():
            due = size * (k + 1) * 1024 / total
            assert abs(given[source] - due) <= 3 * 1024 + 64  # a piece of each other queue that reaches over a partition's end, and a turn
    inside = sum(len({r.source for r in bins[k]}) >= 3 for k in range(total // 1024))
    assert inside > 0.9 * (total // 1024)


def test_weights_hold_until_a_queue_ends(spark):
    rows = [(i, "word " * 499, "a" if i % 2 else "b") for i in range(200)]
    got = mix_pack(spark.createDataFrame(rows, SCHEMA), PATH, weights={"a": 3, "b": 1}, part_tokens=40_000, keep_ids=False).collect()
    by = defaultdict(Counter)
    for r in got:
        by[r.sequence_id][r.source] += r.length
    full = 100_000 // 4096
    assert sum(by[k]["a"] for k in range(8)) == pytest.approx(8 * 4096 * 0.75, rel=0.1)
    assert by[full - 2]["a"] == 0 and by[full - 2]["b"] == 4096
    assert sum(r.length for r in got) == 100_000
    with pytest.raises(ValueError):
        Mixture({"sa": 5}, {"a": 0})


def plain_windows(sizes, capacity, turn):
    """The whole line in one go, without partitions: turn by turn."""
    names, total = sorted(sizes), sum(sizes.values())
    given, left, out, at = dict.fromkeys(names, 0), dict(sizes), [], 0
    ring = list(names)
    while at < total:
        room = capacity if total - at >= capacity else 1 << ((total - at).bit_length() - 1)
        at += room
        owed = {n: sizes[n] * at / total - given[n] + 0.01 for n in names}
        order, last = [n for n in ring if owed[n] >= turn and left[n]], None

        def serve(n, take):
            out.append((n, take))
            given[n] += take
            left[n] -= take
            owed[n] -= take

        for n in order:
            if room:
                take = min(room, left[n], int(owed[n]))
                serve(n, take)
                room -= take
                last = n
        if last is not None:
            k = names.index(last) + 1
            ring = names[k:] + names[:k]
        while room:
            n = max((n for n in names if left[n]), key=lambda n: (owed[n], -names.index(n)))
            take = min(room, left[n], max(turn, int(owed[n])))
            serve(n, take)
            room -= take
    return out


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=7), st.sampled_from([64, 100, 512]), st.sampled_from([1, 16, 90]))
@settings(max_examples=80, deadline=None)
def test_turns_are_those_of_a_plain_ring(sizes, capacity, turn):
    sizes = {f"s{k}": n for k, n in enumerate(sizes)}
    mixture, total = Mixture(sizes, None), sum(sizes.values())
    n = len(sizes)
    got = list(round_robin(np.array([sizes[k] for k in mixture.names]), np.zeros(n), mixture, np.arange(n), window_ends(0, total, total, capacity), 0, total, turn))
    assert sum(g[1] for g in got) == total and all(g[1] > 0 for g in got)
    # Targets meet whole numbers in another order of operations there and here: totals by window are compared, turns by count.
    plain = plain_windows(sizes, capacity, turn)
    assert sum(t for _, t in plain) == total
    per = lambda turns: {k: sum(t for q, t in turns if q == k) for k in mixture.names}
    assert per([(mixture.names[q], t) for q, t, _, _ in got]) == per(plain) == sizes
    assert abs(len(got) - len(plain)) <= max(2, len(plain) // 10)


@given(st.integers(1, 10**7), st.sampled_from([7, 64, 4096]), st.data())
@settings(max_examples=60, deadline=None)
def test_windows_of_parts_are_those_of_the_line(total, capacity, data):
    total = min(total, 50 * capacity + total % capacity)
    whole = window_ends(0, total, total, capacity)
    assert [w[1] for w in whole] == [0, *[w[2] for w in whole]][:-1] and whole[-1][2] == total
    cut = data.draw(st.integers(1, total))
    assert {*window_ends(0, cut, total, capacity), *window_ends(cut, total, total, capacity)} == set(whole)


def test_stretches_have_the_ids_of_the_library():
    machine, library = StretchIds(PATH), Tokenizer.from_file(PATH)
    assert machine.splits and not StretchIds(public_tokenizers.path("byte_bpe_50k.json")).splits
    texts = [t for _, t, _ in made(60, 9)] + ["<|endoftext|>x <|startoftext|>", "Ä ̈á", "ΟΔΟΣ ΟΔΟΣ", "İstanbul ǅ", "'s ' s can't", "a\x85b c　d", "w" * 5000]
    for text, ids in zip(texts, machine.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, machine.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert machine.encode([b"ab\xff cd"]) == machine.encode(["ab� cd".encode()])


def test_words_of_letters_have_the_ids_of_the_library():
    rng, library = random.Random(4), Tokenizer.from_file(PATH)
    machine = StretchIds(PATH)
    syllables = ["th", "er", "ing", "a", "qu", "xz", "tion", "o", "ss", "berg", "aaa", "zq", "é", "ü", "ß", "ÿ", "Ñ", "À", "T"]
    joints = [" "] * 12 + [". ", ", ", "-", "'", "_", "5", "12 ", "\n", "×", "÷", "€", " ?!", "..", "Œ", "ª", "Þ", "@"]
    texts = ["".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) + rng.choice(joints) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["a" * 64, "a" * 300 + " b", "é" * 200, "\xc3".encode("latin-1").decode("latin-1"), "", " ", "5", "--", "x"]
    for text, ids in zip(texts, machine.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, machine.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_whole_texts_of_a_vocabulary_that_keeps_white_space(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "some words\n\n of a text " * i, "a") for i in range(40)]
    checked(rows, mix_pack(spark.createDataFrame(rows, SCHEMA), path).collect(), path=path)


def test_empty_table_repeated_rows_other_columns(spark):
    assert mix_pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    twice = spark.createDataFrame([(1, "a b", "s", 5), (1, "a b", "s", 6)], SCHEMA + ", queue int")
    got = mix_pack(twice, PATH, keep_ids=False).collect()
    assert sum(r.length for r in got) == 6 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
