import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import neighbours
from ledgerloom.llm.neighbours import Search, Tree, nearest_neighbours, tree_order


def _brute(rows, query_rows, k):
    out = {}
    for q, v in query_rows:
        scored = sorted((-(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))).round(12), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [i for _, i in scored[:k]]
    return out


def _points(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    return [(i, (centres[i % 6] + 0.3 * rng.normal(size=d)).tolist()) for i in range(n)]


def test_exact_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_NUMBERS", 8 * 70)
    monkeypatch.setattr(neighbours, "PIVOTS", 5)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    rows = _points(600) + [(1000 + i, _points(1)[0][1]) for i in range(40)]
    bad = [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [None]), (2003, [float("nan")] * 8), (2004, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2005, [1.0] * 3), (2006, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(nearest_neighbours(df, df.filter("vec_id % 50 = 0")).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = _brute(rows, [(i, v) for i, v in rows if i % 50 == 0], 5)
    assert got == want


def _tree(points, leaf):
    order, split, middle = tree_order(points, leaf)
    return Tree(points[order], split, middle, order.astype(np.int64), np.arange(len(points) + 1))


def test_relaxation_prunes_and_one_is_exact():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(3000, 4))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree, queries, none = _tree(points, 16), points[:50], np.full(50, -1)
    true = np.sort(-(queries @ points.T), 1)[:, :5]
    exact, loose = Search(tree, none, queries, 5, 1.0), Search(tree, none, queries, 5, 4.0)
    assert -exact.score == pytest.approx(true)
    assert loose.compared < exact.compared < 50 * 3000
    assert (loose.score <= exact.score + 1e-12).all()


@pytest.mark.parametrize(("relaxation", "recall", "share"), [(1.0, 1.0, 1.0), (4.0, 0.9, 1.0), (16.0, 0.0, 0.6)])
def test_recall_and_share_compared_on_the_embeddings(relaxation, recall, share):
    """The figures of the README: exact search of these 64-dimensional vectors compares nearly all of them."""
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    ids, vectors = np.array(rows["vec_id"]), np.array(rows["embedding"], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    order, split, middle = tree_order(unit)
    asked = ids % 50 == 0
    found = Search(Tree(vectors[order], split, middle, ids[order], np.arange(len(ids) + 1)), ids[asked], vectors[asked], 5, relaxation)
    cosine = unit[asked] @ unit.T
    cosine[ids[asked][:, None] == ids[None, :]] = -2
    true = ids[np.argsort(-cosine, 1, kind="stable")[:, :5]]
    hit = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.id.tolist(), true.tolist())])
    print(f"relaxation {relaxation}: recall {hit:.3f}, share compared {found.compared / asked.sum() / len(ids):.3f}")
    assert hit >= recall and found.compared <= share * asked.sum() * len(ids)


def test_few_candidates_ties_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, df.filter("vec_id = 0")).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 2, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    assert nearest_neighbours(df.limit(0), df).count() == 0 and nearest_neighbours(df, df.limit(0)).count() == 0


def test_lengths_whose_squares_overflow_or_vanish(spark):
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(60, 5))
    scales = [1e200, 1e-200, 1.0, 1e300, 3e-310]
    rows = [(k, (v * scales[k % 5]).tolist()) for k, v in enumerate(plain)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    assert len(got) == 15
    unit = plain / np.sqrt((plain * plain).sum(1))[:, None]
    for q in (0, 20, 40):
        best = [k for k in np.argsort(-(unit @ unit[q]), kind="stable").tolist() if k != q][:5]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == best
