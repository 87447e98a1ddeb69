import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm.tokens import count_tokens, text_slices, transducer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(3)
    parts = [*"  \t\n'stmdrelvl!?.é漢字12٣²ß-—abcdefghij👍\x1c\x85", "'s", "'re", "<|endoftext|>", "   ", " '", "the ", " tion", "-" * 16]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(600)]
    return made + ["", " ", "  ", "'", "x'", "a" * 5000, "-" * 3000, " " * 5000 + "x", "<|endoftext|>" * 3, "<|endoftext|", "ab " * 4000]


def test_counts_and_ids_equal_the_library(library):
    import pyarrow as pa

    texts = _texts()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    machine, counts, ids = transducer(PATH), [], []
    for _, _, data, offsets in text_slices(pa.array(texts), 3000):
        counts += machine.count(data, offsets).tolist()
        flat, cut = machine.encode(data, offsets)
        ids += [flat[a:b].tolist() for a, b in zip(cut, cut[1:])]
    assert ids == want
    assert counts == [len(w) for w in want]


def test_state_table_can_start_anew(library, monkeypatch):
    import pyarrow as pa

    from ledgerloom.llm import tokens

    monkeypatch.setattr(tokens, "STATE_LIMIT", 50)
    machine = tokens.MergeTransducer(PATH)
    for text in _texts()[:60]:
        for _, _, data, offsets in text_slices(pa.array([text])):
            assert machine.count(data, offsets).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


def test_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "hello world", 9), (1, "hello world", 9), (2, None, 8), (3, "", 7), (None, "é", 6)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH)
    assert sorted((r.doc_id or 0, r.text, r.n_bytes, r.n_tokens) for r in got.collect() if r.text is not None) == [(0, "é", 2, 1), (1, "hello world", 11, 2), (1, "hello world", 11, 2), (3, "", 0, 0)]
    assert [(r.n_bytes, r.n_tokens) for r in got.filter("text is null").collect()] == [(0, 0)]
    assert got.filter("doc_id = 99").count() == 0


def _ids(machine, texts):
    import pyarrow as pa

    ids, counts = [], []
    for _, _, data, offsets in text_slices(pa.array(texts)):
        counts += machine.count(data, offsets).tolist()
        flat, cut = machine.encode(data, offsets)
        ids += [flat[a:b].tolist() for a, b in zip(cut, cut[1:])]
    assert counts == [len(i) for i in ids]
    return ids


@pytest.mark.parametrize("lanes", [2, 1024])
def test_long_words_run_in_chunks(library, monkeypatch, lanes):
    from ledgerloom.llm import tokens

    monkeypatch.setattr(tokens, "LANES", lanes)
    rng = random.Random(6)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [word(5000, "abcdefXYZ"), word(2600, "漢字éß"), "ab" * 1600, "-" * 2100, word(700, "token"), "x " + word(300, "ab") + "<|endoftext|>" + word(300, "ab"), word(257, "é")]
    assert _ids(transducer(PATH), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_very_long_word_needs_neither_states_nor_minutes(library):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(1_500_000))
    machine = transducer(PATH)
    before = len(machine.keys)
    assert _ids(machine, [text]) == [library.encode(text, add_special_tokens=False).ids]
    assert len(machine.keys) < before + 100


def test_words_that_fill_the_table_go_on_without_it(library, monkeypatch):
    from ledgerloom.llm import tokens

    monkeypatch.setattr(tokens, "STATE_LIMIT", 200)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 60))) for _ in range(12)) for _ in range(60)]
    machine = tokens.MergeTransducer(PATH)
    assert _ids(machine, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(machine.keys) <= 401
