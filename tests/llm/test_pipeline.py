"""The pipeline's stages against plain versions, on rows with nulls, empty texts, repeats and copies."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm.quality import score_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def _held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def _rows(n=160):
    rng = random.Random(5)
    words = ["".join(rng.choice("tionhersal") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(55, 120))) + "."
    texts = [prose() for _ in range(n)]
    for i in range(0, n, 4):  # toxic ones
        own = texts[i].split()
        for _ in range(4):
            own.insert(rng.randrange(len(own)), rng.choice(["grumbolo", "vexxing", "zorkish"]))
        texts[i] = " ".join(own)
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [(500 + i, texts[2 * i + 1], "en", "a", 1) for i in range(6)]  # exact copies
    rows += [(600 + i, texts[2 * i + 1].replace(" ", "  ") + " end", None, None, None) for i in range(6)]  # near ones
    rows += [(700, None, "en", "a", None), (701, "", None, "b", 0), (702, "too short", "en", "b", 9), (703, "### *** " * 60, "en", "c", 1)]
    return [*rows, rows[3], rows[3], (None, texts[7] + " more words here", "en", "a", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made = tmp_path_factory.mktemp("tables")
    rows = _rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{made}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{made}/labels.parquet")
    return str(made)


def _docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_quality_keeps_clean_texts(spark, folder):
    docs = _docs(spark, _rows())
    kept = STAGES["quality rules"](spark, docs, folder)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    want = Counter(r.doc_id for r in score_quality(docs).filter("kept").collect())
    got = Counter(r.doc_id for r in kept.collect())
    assert got == want and not {700, 701, 702, 703} & set(got) and all(got[i] for i in range(160))


def test_toxic_texts_go(spark, folder):
    kept = {r.doc_id for r in STAGES["toxicity"](spark, _docs(spark, _rows()), folder).collect()}
    for i in range(160):
        assert (i in kept) == (i % 4 != 0), (i, _held_out(i))
    assert {700, 701, None} <= kept


def test_one_of_each_group_of_copies_stays(spark, folder):
    from tests.llm.test_neardup import brute

    rows = _rows()
    got = [r for r in STAGES["near duplicates"](spark, _docs(spark, rows), folder).collect()]
    component = brute([(i, t) for i, t, *_ in rows if i is not None], 5, 80)
    want = Counter(i for i, c in component.items() if i == c)
    assert Counter(r.doc_id for r in got if r.doc_id is not None) == want and sum(r.doc_id is None for r in got) == 1
    assert {500 + i for i in range(6)} & {r.doc_id for r in got} == set()


def test_the_mix_uses_its_budget(spark, folder):
    rows = _rows()
    got = STAGES["mixing"](spark, _docs(spark, rows), folder).collect()
    size = lambda t: len((t or "").split())
    times, copies, total = Counter((r.doc_id, r.text) for r in got), Counter((i, t) for i, t, *_ in rows), sum(size(t) for _, t, *_ in rows)
    assert all(n <= 2 * copies[k] for k, n in times.items()) and set(times) <= set(copies)
    mixed = sum(size(r.text) for r in got)
    assert 1.5 * total - max(size(t) for _, t, *_ in rows) < mixed <= 1.5 * total


def test_packed_sequences_hold_every_token(spark, folder):
    rows = _rows()
    got = STAGES["packing"](spark, _docs(spark, rows), folder).collect()
    library, pieces, bins = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length <= 1024 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.piece, r.ids))
        bins[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for i, t, *_ in rows:
        want[i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    assert Counter((i, tuple(ids)) for i, own in pieces.items() for _, ids in own) == want  # all shorter than a sequence
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_the_whole_run_and_an_empty_table(spark, folder, tmp_path):
    product = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in product}
    assert ids and not {700, 701, 702, 703} & ids and not {i for i in range(0, 160, 4)} & ids and not set(range(500, 506)) & ids
    _docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
