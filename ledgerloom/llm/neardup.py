"""Near-duplicate classes by an inverted join over MinHash coordinates.

1. Each text becomes a set of hashed word shingles and a signature of COORDINATES minima. Texts with equal sets are one
   class member from here on, so groups of copies never multiply.
2. Signatures are posted under (coordinate, value). A value that only one member has can't collide; a member with fewer
   than MATCHES shared values has no partner and leaves.
3. Two members that agree in MATCHES coordinates share one of the rarest `shared - MATCHES + 1` values of each (prefix);
   only these are joined. A pair is made once, under its first common value, and only if the set sizes allow the
   similarity. The other postings are skipped: collisions of the surviving pairs are counted from the signatures.
4. A value that more than HOT members share is not expanded into pairs: its members join one family by a star. Families
   are the connected components of the candidate pairs and stars.
5. Links are confirmed on full sets inside families, in cells of at most two blocks of BLOCK members. In a family of more
   blocks, all blocks are compared with the first and with themselves; then only members outside the family's largest
   class are compared with all others, as pairs within a class can add nothing. Cells return spanning links, so their
   output is linear in the members. Classes are the connected components of the links.

With 64 coordinates and 34 matches, a pair at similarity 0.8 is missed with probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components, given_back, shared_folder
from ledgerloom.llm.tokens import text_slices
from ledgerloom.llm.words import LOWER, SLICE_BYTES, hashes, mix, spans, windows

COORDINATES, MATCHES = 64, 34
HOT = 32
BLOCK = 256
#: Values with more than one in HOT_KEYS of all postings; there are no more than this, so their table may go to all tasks.
HOT_KEYS = 20_000
_MULTIPLIERS = np.random.Generator(np.random.PCG64(71)).integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.random.Generator(np.random.PCG64(72)).integers(1, 1 << 63, COORDINATES, np.uint64)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of all texts, ordered by text and value, and where each text's begin and the last end.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text of fewer words than `width` has its whole sequence as one
    shingle; one without words has none.
    """
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, rows = spans(data, offsets)
    word = hashes(data, starts, ends)
    found, at = windows(word, rows, width)
    found, own = [found], [rows[at]]
    count = np.bincount(rows, minlength=n)
    for few in range(1, width):
        some = np.flatnonzero(count[rows] == few) if (count == few).any() else np.zeros(0, np.int64)
        whole, first = windows(word[some], rows[some], few)
        found.append(mix(whole + np.uint64(few)))
        own.append(rows[some][first])
    found, own = np.concatenate(found), np.concatenate(own)
    order = np.lexsort((found, own))
    found, own = found[order], own[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
    found, own = found[fresh], own[fresh]
    return found, np.searchsorted(own, np.arange(n + 1))


def _signed(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc, n_shingles, a 128-bit digest of the set (two longs) and the signature, null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                found, cut = shingle_sets(data, offsets, width)
                size = np.diff(cut)
                full = np.flatnonzero(size > 0)
                one, two = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                signature = np.zeros((len(full), COORDINATES), np.uint64)
                if full.size:
                    begins = cut[:-1][full]
                    one[full] = np.add.reduceat(mix(found), begins)
                    two[full] = np.add.reduceat(mix(found ^ _TOP), begins)
                    for k in range(COORDINATES):
                        signature[:, k] = np.minimum.reduceat((found ^ _SALTS[k]) * _MULTIPLIERS[k], begins)
                    signature = mix(signature ^ _SALTS)  # equal values under different coordinates are different keys
                place = np.full(len(size) + 1, 0, np.int32)
                place[1:] = np.cumsum(size > 0) * COORDINATES
                lists = pa.ListArray.from_arrays(pa.array(place, mask=np.append(size == 0, False)), pa.array(signature.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["doc", "n_shingles", "d1", "d2", "signature"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(given_back(sign), "doc long, n_shingles long, d1 long, d2 long, signature array<long>")


def _by_key(rows: DataFrame, table: DataFrame, often: int) -> DataFrame:
    """Rows joined with a table (key, n, ...) of their keys. Keys with n above `often` go to the rows, which stay where they
    are; the others meet in a shuffle, where no key is a large share of it."""
    hot = table.filter(F.col("n") > often)
    usual = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(table.filter(F.col("n") <= often), "key")
    return rows.join(F.broadcast(hot), "key").unionByName(usual)


def _candidates(members: DataFrame, share: int) -> DataFrame:
    """Edges (a, b) of candidate families: colliding pairs under rare values, stars under hot ones."""
    posted = members.select("doc", "n_shingles", F.explode("signature").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").checkpoint()
    often = max(HOT, (shared.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    kept = _by_key(posted, shared, often).groupBy("doc", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))  # COORDINATES at most
    kept = kept.filter(F.size("keys") >= MATCHES).select("doc", "n_shingles", F.slice("keys", 1, F.size("keys") - MATCHES + 1).alias("keys")).checkpoint()
    prefix = kept.select("doc", "n_shingles", F.col("keys.key").alias("prefix"), F.explode("keys").alias("e")).select("doc", "n_shingles", "prefix", "e.key", "e.n")

    rare = prefix.filter(F.col("n") <= HOT).drop("n")
    left, right = rare.select(F.col("doc").alias("a"), F.col("n_shingles").alias("na"), F.col("prefix").alias("pa"), "key"), rare.select(F.col("doc").alias("b"), F.col("n_shingles").alias("nb"), F.col("prefix").alias("pb"), "key")
    may = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= share * F.greatest("na", "nb")) & (F.element_at(F.array_intersect("pa", "pb"), 1) == F.col("key"))
    pairs = left.join(right, "key").filter(may).select("a", "b")
    signatures = members.select("doc", "signature")
    agreed = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    pairs = pairs.join(signatures.select(F.col("doc").alias("a"), F.col("signature").alias("sa")), "a").join(signatures.select(F.col("doc").alias("b"), F.col("signature").alias("sb")), "b").filter(agreed >= MATCHES).select("a", "b")

    hot = prefix.filter(F.col("n") > HOT)
    centres = hot.groupBy("key").agg(F.min("doc").alias("b"), F.max("n").alias("n"))
    stars = _by_key(hot.select("key", "doc"), centres, often).filter("doc <> b").select(F.col("doc").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def _confirm(cells: DataFrame, share: int) -> DataFrame:
    """Spanning links (a, b) between the sets of each cell (family, cell, doc, shingles)."""

    def links(docs: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        size = np.array([len(s) for s in sets], np.int64)
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        common = count[column] > 1
        row, column = row[common], (np.cumsum(count > 1) - 1)[column[common]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [k, k + width])
            dense = np.zeros((len(sets), width), np.float32)
            dense[row[a:b], column[a:b] - k] = 1
            overlap += dense @ dense.T
        overlap = overlap.astype(np.int64)
        union = size[:, None] + size[None, :] - overlap
        linked = 100 * overlap >= share * union
        unseen = np.ones(len(sets), bool)
        for i in range(len(sets)):
            if not unseen[i]:
                continue
            unseen[i], reach = False, np.array([i])
            while reach.size:
                new = np.flatnonzero(linked[reach].any(0) & unseen)
                unseen[new], reach = False, new
                for j in new:
                    if docs[i] != docs[j]:
                        yield docs[i], docs[j]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, sets, out = None, [], [], []
        for batch in batches:
            family, cell, doc = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(3)
            flat, cut = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                if (family[i], cell[i]) != key:
                    if len(docs) > 1:
                        out.extend(links(docs, sets))
                    key, docs, sets = (family[i], cell[i]), [], []
                docs.append(doc[i])
                sets.append(flat[cut[i] : cut[i + 1]].copy())
        if len(docs) > 1:
            out.extend(links(docs, sets))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return cells.select("family", "cell", "doc", "shingles").repartition("family", "cell").sortWithinPartitions("family", "cell").mapInArrow(given_back(confirm), "a long, b long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Replaces `text` by `shingles`, the full set as sorted hashes."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest, F.array(F.lit(0).cast("long")).alias("shingles")).schema

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            for start, end, data, offsets in text_slices(batch.column(batch.schema.get_field_index("text")), SLICE_BYTES):
                found, cut = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([*[c.slice(start, end - start) for c in others], pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(found.view(np.int64)))], names=[*rest, "shingles"])

    return docs.mapInArrow(given_back(shingle), schema)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, share: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Two documents are linked if 100 * intersection >= share * union of their sets of `width`-word shingles. Null and
    wordless texts have an empty set and no links. Rows that share a doc_id count as one document with several texts.
    Rows without a doc_id take no part: their component_id is null and they are kept. Other columns are not returned.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    signed = _signed(docs, doc_id, text, width).checkpoint()
    classes = signed.filter("doc IS NOT NULL AND n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    classes = classes.checkpoint()
    members = classes.select(F.col("rep").alias("doc"), "n_shingles", "signature")
    families = connected_components(_candidates(members, share)).select(F.col("node").alias("doc"), F.col("component").alias("family")).checkpoint()

    # The texts of the members, each once, and the members' blocks.
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).join(families, "doc")
    size = families.groupBy("family").agg(F.count("*").alias("n"))
    shuffled = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / BLOCK)).cast("int")
    placed = _sets(texts.join(size, "family").withColumn("block", shuffled), width)
    large = size.filter(F.col("n") > BLOCK).count() > 0
    if large:
        placed = placed.checkpoint()
    # The first round: each block with itself and the first block, a family of one block once.
    first = placed.withColumn("cell", F.explode(F.when(F.col("n") <= BLOCK, F.array(F.lit(0))).when(F.col("block") == 0, F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)).otherwise(F.array("block"))))
    links = _confirm(first, share)
    if large:
        links = links.checkpoint()
        so_far = connected_components(links).select(F.col("node").alias("doc"), "component")
        big = placed.filter(F.col("n") > BLOCK).join(so_far, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        main = big.groupBy("family", "component").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
        big = big.join(main, "family").withColumn("outside", F.col("component") != F.col("main")).checkpoint()
        some = big.filter("outside").groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
        big = big.join(some, "family")
        own = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("groups")).cast("int")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        # Cell (group of outsiders, block of all): outsiders go to a row of cells, everyone to a column.
        across = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: own * blocks + j)).otherwise(F.array().cast("array<int>"))
        down = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda i: i * blocks + F.col("block"))
        second = big.withColumn("cell", F.explode(F.array_union(across, down)))
        links = links.unionByName(_confirm(second, share))
    found = connected_components(links)
    reps = classes.select("d1", "d2", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc", "n_shingles", "d1", "d2")
    lone = (F.col("n_shingles") > 0) & F.col("doc").isNotNull()
    out = rows.filter(lone).join(reps, ["d1", "d2"]).select("doc", "n_shingles", "component").unionByName(rows.filter(~F.coalesce(lone, F.lit(False))).select("doc", "n_shingles", F.col("doc").alias("component")))
    return out.select(F.col("doc").alias(doc_id), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, d.doc_id) AS component_id, coalesce(r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
