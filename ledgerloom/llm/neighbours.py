"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

On unit vectors the distance d is a metric and d * d = 2 - 2 cos, so the nearest are those of largest cosine. A node splits
its vectors at the median distance from a vantage point. A query that has k neighbours within t so far may skip the far
side if the split lies further than t from its own distance to the vantage point: at t / relaxation instead, a relaxation
above one skips more and may miss some; one is exact. Queries go down a tree together, as arrays.

1. Equal vectors stand once, with the k + 1 smallest of their ids: no query can want more of them.
2. Vectors are dealt to the nearest of at most PIVOTS pivots; a cell of more than SHARD_NUMBERS numbers is cut into several
   shards by a hash. Each shard's tree is built once and stored as its rows in tree order: a node's first row is its vantage
   point with the split distance, then come the inside and the outside.
3. Each query searches one shard of its own cell. The distance of its k-th best there and the cells' radii say which
   other cells may hold something as near; it goes to the shards of those alone.
4. A shard's task reads the tree and then the queries as a stream, so it holds one shard and one batch, however many
   queries come. Only queries are multiplied, never the vectors. The best of all shards are merged by a window over query
   and rank.

In many dimensions exact search prunes little (see README for figures); what step 3 saves depends on how clustered the
vectors are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import shared_folder

#: Numbers (vectors x dimensions) of a shard: 16 MB as doubles.
SHARD_NUMBERS = 2_000_000
#: Bounds of what the driver collects and each task is sent: pivots, and numbers in all of them.
PIVOTS, PIVOT_NUMBERS = 256, 1_000_000
LEAF, PAIRS = 64, 100_000
# Rounding of cosines, and of distances, whose error near zero is its square root.
_SLACK, _FAR_SLACK = 1e-12, 1e-6


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component near one: squares then neither overflow nor vanish, and
    as only exponents change, cosines are those of the vectors as they were."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def tree_order(points: np.ndarray, leaf: int = LEAF, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit vectors in tree order, and of the first row of each node its split distance and where its outside begins.

    A leaf's first row has no split (nan): it has at most `leaf` rows, or rows that all lie at one distance.
    """
    rng = np.random.default_rng(seed)
    order, split, middle = np.arange(len(points)), np.full(len(points), np.nan), np.zeros(len(points), np.int32)
    nodes = [(0, len(points))]
    while nodes:
        low, high = nodes.pop()
        if high - low <= leaf:
            continue
        pick = low + int(rng.integers(high - low))
        order[[low, pick]] = order[[pick, low]]
        rest = order[low + 1 : high]
        away = _distance(points[rest] @ points[order[low]])
        cut = float(np.median(away))
        inside = away <= cut
        if inside.all():
            continue
        order[low + 1 : high] = np.concatenate([rest[inside], rest[~inside]])
        split[low], middle[low] = cut, low + 1 + int(inside.sum())
        nodes += [(low + 1, int(middle[low])), (int(middle[low]), high)]
    return order, split, middle


class Tree:
    """A shard in tree order; `ids[cut[i]:cut[i + 1]]` are the ids of row i, each as often as it counts."""

    def __init__(self, vectors: np.ndarray, split: np.ndarray, middle: np.ndarray, ids: np.ndarray, cut: np.ndarray) -> None:
        vectors = _scaled(vectors)
        self.vectors, self.split, self.middle, self.ids, self.cut = vectors, split, middle, ids, cut
        self.lengths = np.sqrt((vectors * vectors).sum(1))
        self.unit = vectors / self.lengths[:, None]


class Search:
    """The k best (score, id) of a tree for each query, larger scores and then smaller ids first; -inf where there are fewer.

    `floor` is a score that a query's k-th best is known to reach elsewhere: less is not looked for.
    """

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, relaxation: float, floor: np.ndarray | None = None) -> None:
        queries = _scaled(queries)
        self.tree, self.own, self.queries, self.k, self.relaxation = tree, ids, queries, k, relaxation
        self.lengths = np.sqrt((queries * queries).sum(1))
        self.unit = queries / self.lengths[:, None]
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.score, self.id = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        self.compared = 0
        self._visit(0, len(tree.vectors), np.arange(len(queries)))

    def _least(self, active: np.ndarray) -> np.ndarray:
        """The score that is worth a look: that of the k-th best so far."""
        return np.maximum(self.score[active, -1], self.floor[active])

    def _reach(self, active: np.ndarray) -> np.ndarray:
        least = self._least(active)
        return np.where(np.isinf(least), np.inf, _distance(np.where(np.isinf(least), 0, least)) / self.relaxation) + _FAR_SLACK

    def _offer(self, low: int, high: int, active: np.ndarray, cosine: np.ndarray) -> None:
        """Takes in what may be among the k best, by its exact score on the original vectors."""
        self.compared += cosine.size
        query, row = np.nonzero(cosine >= self._least(active)[:, None] - _SLACK)
        for a in range(0, len(query), PAIRS):
            self._merge(active[query[a : a + PAIRS]], low + row[a : a + PAIRS])

    def _merge(self, query: np.ndarray, row: np.ndarray) -> None:
        tree = self.tree
        score = (tree.vectors[row] * self.queries[query]).sum(1) / (tree.lengths[row] * self.lengths[query])
        times = tree.cut[row + 1] - tree.cut[row]
        start = np.repeat(tree.cut[row] - (np.cumsum(times) - times), times)
        found = tree.ids[start + np.arange(len(start))]
        query, score = np.repeat(query, times), np.repeat(score, times)
        keep = found != self.own[query]
        query, score, found = query[keep], score[keep], found[keep]
        touched = np.unique(query)
        query, score, found = np.concatenate([np.repeat(touched, self.k), query]), np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), found])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        first = np.searchsorted(query, touched)
        best = first[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = score[best], found[best]

    def _visit(self, low: int, high: int, active: np.ndarray) -> None:
        if not len(active) or low == high:
            return
        tree, split, middle = self.tree, self.tree.split[low], int(self.tree.middle[low])
        if np.isnan(split):
            for a in range(low, high, LEAF):
                b = min(high, a + LEAF)
                self._offer(a, b, active, self.unit[active] @ tree.unit[a:b].T)
            return
        cosine = self.unit[active] @ tree.unit[low]
        self._offer(low, low + 1, active, cosine[:, None])
        away = _distance(cosine)
        near = away <= split
        self._visit(low + 1, middle, active[near])
        self._visit(middle, high, active[~near])
        # The far side only where it may hold something as near as the k-th best.
        self._visit(middle, high, active[near & (split - away <= self._reach(active))])
        self._visit(low + 1, middle, active[~near & (away - split <= self._reach(active))])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v (array of double) and n, its length, of the rows that take part."""
    df = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(finite & F.exists("v", lambda x: x != 0)).withColumn("n", F.size("v"))


def distinct_points(base: DataFrame, k: int) -> DataFrame:
    """n, v, ids: each vector once, with the k + 1 smallest ids that have it, an id k times at most.

    Rows are counted by (v, id) before they move, and each task passes on k + 1 ids of a vector at most, so a vector or a
    row that a third of the table repeats is no large group.
    """
    counted = base.groupBy("n", "v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("n", "v").orderBy("id"))).filter(F.col("place") <= k + 1)
    listed = first.groupBy("n", "v").agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("found"))  # k + 1 at most
    return listed.select("n", "v", F.flatten(F.transform("found", lambda f: F.array_repeat(f["id"], f["times"]))).alias("ids"))


class Cells:
    """Pivots by vector length; rows of `unit` are unit vectors. Small enough to be sent to all tasks."""

    def __init__(self, pivots: list[list[float]]) -> None:
        self.unit: dict[int, np.ndarray] = {n: _unit(np.array([p for p in pivots if len(p) == n])) for n in {len(p) for p in pivots}}

    def away(self, vectors: np.ndarray) -> np.ndarray | None:
        """Distance of each vector to each pivot; None if no pivot has this length: all are in cell 0."""
        pivots = self.unit.get(vectors.shape[1])
        return None if pivots is None else _distance(_unit(vectors) @ pivots.T)

    def nearest(self, df: DataFrame) -> DataFrame:
        """Adds cell and away, the distance to its pivot."""
        columns = df.columns
        schema = df.select(*columns, F.lit(0).alias("cell"), F.lit(0.0).alias("away")).schema

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                n = batch.column(columns.index("n")).to_numpy()
                for size in np.unique(n):
                    rows = np.flatnonzero(n == size)
                    far = self.away(_matrix(batch.column(columns.index("v")).take(pa.array(rows))))
                    if far is not None:
                        cell[rows], away[rows] = far.argmin(1), far.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*columns, "cell", "away"])

        return df.mapInArrow(deal, schema)


def stored_trees(points: DataFrame, cells: Cells, shard_rows: int) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, float]]]:
    """The trees, a row a vector (n, cell, part, position, v, ids, split, middle), checkpointed; and shards and radius of each
    cell, at most PIVOTS of each vector length."""
    dealt = cells.nearest(points).checkpoint()
    sizes = dealt.groupBy("n", "cell").agg(F.count("*").alias("rows"), F.max("away").alias("radius")).collect()
    known = {(r.n, r.cell): (-(-r.rows // shard_rows), r.radius) for r in sizes}
    parts = [r for r in known if known[r][0] > 1]
    count = F.element_at(F.create_map(*[F.lit(x) for n, c in parts for x in (f"{n}:{c}", known[n, c][0])]), F.concat_ws(":", "n", "cell")) if parts else F.lit(1)
    part = F.pmod(F.xxhash64("v"), F.coalesce(count, F.lit(1))).cast("int")

    def build(shard: pa.Table) -> pa.Table:
        order, split, middle = tree_order(_unit(_matrix(shard["v"])))
        rows = shard.take(pa.array(order)).select(["n", "cell", "part", "v", "ids"])
        return rows.append_column("position", pa.array(np.arange(len(order), dtype=np.int32))).append_column("split", pa.array(split)).append_column("middle", pa.array(middle))

    schema = "n int, cell int, part int, v array<double>, ids array<long>, position int, split double, middle int"
    trees = dealt.withColumn("part", part).select("n", "cell", "part", "v", "ids").groupBy("n", "cell", "part").applyInArrow(build, schema)
    return trees.checkpoint(), known


_KEYS = ("n", "cell", "part")
_FOUND = "id long, v array<double>, n int, vec_id long, score double"


def _search(trees: DataFrame, asked: DataFrame, k: int, relaxation: float) -> DataFrame:
    """Up to k rows (id, v, n, vec_id, score) for each row of asked (id, v, n, cell, part, floor), from its one shard."""
    blank = lambda kind: F.lit(None).cast(kind)
    tree_rows = trees.select(*_KEYS, "position", "v", "ids", "split", "middle", blank("long").alias("id"), blank("double").alias("floor"))
    query_rows = asked.select(*_KEYS, F.lit(1 << 30).alias("position"), "v", F.array().cast("array<long>").alias("ids"), blank("double").alias("split"), blank("int").alias("middle"), "id", "floor")
    together = tree_rows.unionByName(query_rows).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "position")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            is_query = batch.column(3).to_numpy() == 1 << 30
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (is_query[1:] != is_query[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if not b:
                    continue
                if tuple(keys[a]) != shard:
                    shard, parts, tree = tuple(keys[a]), [], None
                rows = batch.slice(a, b - a)
                if not is_query[a]:
                    parts.append(rows)
                    continue
                if tree is None:
                    if not parts:
                        continue  # a query that came to a shard without vectors
                    own = pa.Table.from_batches(parts).combine_chunks()
                    lists = own["ids"].combine_chunks()
                    cut = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                    tree, parts = Tree(_matrix(own["v"]), own["split"].to_numpy(), own["middle"].to_numpy(), lists.flatten().to_numpy(), cut), []
                ids, v = rows.column("id").to_numpy(), _matrix(rows.column("v"))
                found = Search(tree, ids, v, k, relaxation, rows.column("floor").to_numpy(zero_copy_only=False))
                query, place = np.nonzero(found.score > -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[query]), rows.column("v").take(pa.array(query)), rows.column("n").take(pa.array(query)), pa.array(found.id[query, place]), pa.array(found.score[query, place])],
                    names=["id", "v", "n", "vec_id", "score"],
                )

    return together.mapInArrow(search, _FOUND)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, relaxation: float = 1.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): the k nearest of `vectors` for each row of `queries`.

    Ties go to the smaller vec_id, however many vectors tie. A row with a query's id is not its neighbour. Vectors that are
    null, zero, or hold null or non-finite components, and rows without an id, take no part; vectors of other lengths than a
    query's neither. Repeated rows are one candidate each; a query row that repeats is one query, and an id with several
    vectors has one ranking over all of them. Columns other than the two named are not looked at.
    """
    shared_folder(vectors.sparkSession)
    points = distinct_points(_usable(vectors, vec_id, embedding), k).checkpoint()
    asked = _usable(queries, vec_id, embedding).dropDuplicates(["id", "v"])
    total, longest = points.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
    # No shard above the bound, and shards enough for the session's cores.
    shard_rows = max(LEAF, min(SHARD_NUMBERS // longest, -(-total // vectors.sparkSession.sparkContext.defaultParallelism)))
    pivots = points.orderBy(F.xxhash64("v"), "v").select("v").limit(max(1, min(PIVOTS, PIVOT_NUMBERS // longest, -(-total // shard_rows)))).collect()
    cells = Cells([r.v for r in pivots])
    trees, known = stored_trees(points, cells, shard_rows)

    def shards_of(n: Column, cell: Column) -> Column:
        table = [F.lit(x) for (size, c), (parts, _) in known.items() for x in (f"{size}:{c}", parts)]
        return F.coalesce(F.element_at(F.create_map(*table), F.concat_ws(":", n, cell)), F.lit(0)) if table else F.lit(0)

    # First one shard of the nearest cell, for a bound.
    home = cells.nearest(asked).withColumn("shards", shards_of(F.col("n"), F.col("cell"))).filter("shards > 0")
    home = home.select("id", "v", "n", "cell", F.pmod(F.xxhash64("v", "id"), F.col("shards")).cast("int").alias("part"), F.lit(float("-inf")).alias("floor")).checkpoint()
    near = _search(trees, home, k, relaxation).checkpoint()
    kth = near.groupBy("id", "v", "n").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    bounded = home.join(kth, ["id", "v", "n"], "left").select("id", "v", "n", "cell", "part", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))

    def cells_to_visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, floor = batch.column("n").to_numpy(), batch.column("floor").to_numpy()
            lists: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for size in np.unique(n):
                rows = np.flatnonzero(n == size)
                there = sorted(c for s, c in known if s == size)
                far = cells.away(_matrix(batch.column("v").take(pa.array(rows))))
                reach = np.where(np.isinf(floor[rows]), np.inf, _distance(np.where(np.isinf(floor[rows]), 0, floor[rows])) / relaxation) + _FAR_SLACK
                for c in there:
                    ok = np.ones(len(rows), bool) if far is None else far[:, c] - known[size, c][1] <= reach
                    for i in rows[ok]:
                        lists[i].append(c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    routed = bounded.withColumnsRenamed({"cell": "home", "part": "home_part"})
    routed = routed.mapInArrow(cells_to_visit, routed.select("*", F.array().cast("array<int>").alias("cells")).schema)
    sent = routed.select("id", "v", "n", "floor", "home", "home_part", F.explode("cells").alias("cell"))
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), shards_of(F.col("n"), F.col("cell")) - 1)).alias("part")).filter("NOT (cell = home AND part = home_part)")
    found = near.unionByName(_search(trees, sent.drop("home", "home_part"), k, relaxation))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
