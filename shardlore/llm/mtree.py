r"""Exact top-k inner products by M-trees searched best first.

Inner product becomes a metric by one more coordinate: with M the largest norm
in a tree, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have
|q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>, so the nearest x' has the largest score.
All scores that decide are integers; distances only prune, with a margin
``EPS`` far above their rounding error, and equal bounds are not pruned.

An M-tree (Ciaccia, Patella, Zezula, 1997) is a tree of pages.  A routing entry
has a router, a covering radius and the distance to the parent's router; a leaf
entry has a vector and that distance.  The search takes the page of the smallest
lower bound first; with the stored distances it discards entries by
|d(q, parent) - d(entry, parent)| - radius > d_k before computing d(q, entry).

Vectors are dealt by id to trees of at least about ``tree_rows`` and queries to
blocks of about ``block_rows``; trees are files in the shared folder, each (tree,
block) pair is one bounded piece of work, and the trees' best k are merged by a
window that trims before its shuffle.  Equal vectors of a tree are one entry
that keeps its k + 1 smallest ids: no more can be in a result, so the answer
stays exact with any number of copies.

Scores are exact whatever the components: where doubles can't hold them, inner
products are summed from products of 21-bit limbs.  A score beyond 64 bits is
ranked by its true value and given as the nearest 64-bit number.

Edge cases: vectors that are null, empty, or hold a null or non-finite
component take no part, and neither do null ids.  Scaled components beyond 64
bits count as the nearest 64-bit number.  A query meets candidates of
its own length only.  Exactly repeated rows count once.  Ties go to the smaller
id.  Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, scratch, staged, staged_path
from .files import map_bytes, write_arrays

TOP = 20
SCALE = 64
QUERY_STEP = 20
#: Vectors of a tree: at least the first, at most the second (some 70 MB with 64 components), with 64 trees in between.
TREE_ROWS, MOST_TREE_ROWS, TREES = 8192, 65_536, 64
BLOCK_ROWS = 4096
PAGE = 128
FANOUT = 16
EPS = 1e-6
#: Scores times entries below this are exact in doubles and fit keys of 64 bits.
SAFE = 2.0**53
#: Bits of a limb, and components whose products of limbs a double can sum.
LIMB, LIMB_COMPONENTS = 21, 1024
MOST, LEAST = 2**63 - 1, -(2**63)


class MTree:
    """points: (n, d) distinct integer vectors; ids: for each, its smallest ids, ascending.

    Routers are points of the tree, so a distance takes one inner product:
    |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>.
    """

    def __init__(self, points: np.ndarray, ids: list[np.ndarray], page: int = PAGE, fanout: int = FANOUT) -> None:
        self.whole = points.astype(np.int64)
        self.points = points.astype(np.float64)
        self.squares = (self.points**2).sum(axis=1)
        self.top_square = float(self.squares.max()) if len(points) else 0.0
        self.page, self.fanout = page, max(2, fanout)
        #: Leaves: (start, stop, distances to the router); others: (children, routers, radii, distances to the router).
        self.pages: list[tuple] = []
        self._leaves: list[np.ndarray] = []
        self.root_router = self.points[:1]
        self.root = self._grow(np.arange(len(points)), 0) if len(points) else -1
        # entries lie in the order of the leaves, so a leaf is a slice
        order = np.concatenate(self._leaves) if self._leaves else np.zeros(0, np.int64)
        del self._leaves
        self.points, self.squares = self.points[order], self.squares[order]
        # whole numbers are needed only where doubles may not hold them
        self.whole = self.whole[order] if self.top_square * max(1, len(order)) >= SAFE else None
        self.counts = np.array([len(ids[i]) for i in order], np.int64)
        self.ids = np.concatenate([ids[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        first = self.ids[self.starts] if len(order) else self.ids
        #: Entries by smallest id, best first, and each entry's place among them counted from the end.
        self.by_id = np.argsort(first, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[self.by_id] = np.arange(len(order))[::-1]
        self.computed = 0

    def _far(self, rows: np.ndarray, router: int) -> np.ndarray:
        lift = lambda r: np.sqrt(np.maximum(self.top_square - self.squares[r], 0))
        return np.sqrt(((self.points[rows] - self.points[router]) ** 2).sum(axis=1) + (lift(rows) - lift(router)) ** 2)

    def _grow(self, rows: np.ndarray, router: int) -> int:
        away = self._far(rows, router)
        at = len(self.pages)
        if len(rows) <= self.page:
            start = sum(map(len, self._leaves))
            self._leaves.append(rows)
            self.pages.append((start, start + len(rows), away))
            return at
        # k-centre: each further pivot is the row farthest from those so far
        n = min(self.fanout, -(-len(rows) // self.page) + 1)
        near, owner, pivots = away.copy(), np.zeros(len(rows), np.int64), []
        for k in range(n):
            pivots.append(int(rows[int(np.argmax(near))]))
            d = self._far(rows, pivots[-1])
            better = d < near if k else np.ones(len(rows), bool)
            owner[better], near[better] = k, d[better]
        groups = [rows[owner == k] for k in range(n)]
        if max(map(len, groups)) == len(rows):  # nothing was told apart: cut by position
            groups = np.array_split(rows, n)
            pivots = [int(g[0]) for g in groups]
        kept = [(g, p) for g, p in zip(groups, pivots, strict=True) if len(g)]
        routers = np.array([p for _, p in kept])
        radii = np.array([self._far(g, p).max() for g, p in kept])
        stored = self._far(routers, router)
        self.pages.append(())
        children = np.array([self._grow(g, p) for g, p in kept])
        self.pages[at] = (children, self.points[routers], radii, stored)
        return at

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, scores), each (queries, k), unordered, -1 where there are fewer: the k best by score, then smallest id.

        Each query has its own queue of pages by lower bound and takes the best
        one first.  Queries that take the same page in a round share its matrix
        product, which leaves out all entries that the stored distances discard
        for every one of them.
        """
        n, m = len(self.points), len(queries)
        width = min(k, n)
        none = np.full((m, k), -1, np.int64)
        if not width or not m:
            return none, none.copy()
        q = queries.astype(np.float64)
        squares = (q**2).sum(axis=1)
        if max(self.top_square, float(squares.max())) * n >= SAFE:
            return self._search_exactly(queries, k)
        worst_of = np.iinfo(np.int64).min
        best = np.full((m, width), worst_of)  # score * n + place; the first is the least
        limit = np.full(m, np.inf)
        low, away = np.full((m, len(self.pages)), np.inf), np.zeros((m, len(self.pages)))
        low[:, self.root] = 0.0
        away[:, self.root] = self._from(q, squares, self.root_router)[:, 0]
        active = np.arange(m)
        while len(active):
            page = low[active].argmin(axis=1)
            bound = low[active, page]
            going = (bound <= limit[active]) & (bound < np.inf)
            active, page, bound = active[going], page[going], bound[going]
            low[active, page] = np.inf
            order = np.argsort(page, kind="stable")
            names, heads = np.unique(page[order], return_index=True)
            for at, part in zip(names.tolist(), np.split(order, heads[1:]) if len(order) else [], strict=True):
                rows = active[part]
                entry = self.pages[at]
                gap = np.abs(away[rows, at][:, None] - entry[-1])
                if len(entry) == 3:
                    start, stop, _ = entry
                    cols = np.flatnonzero((gap <= limit[rows][:, None]).any(axis=0))
                    if not len(cols):
                        continue
                    cols = slice(start, stop) if len(cols) == stop - start else start + cols
                    points = self.points[cols]
                    self.computed += len(rows) * len(points)
                    keys = np.rint(q[rows] @ points.T).astype(np.int64) * n + self.place[cols]
                    hit = (keys > best[rows, :1]).any(axis=1)
                    rows = rows[hit]
                    merged = np.concatenate([best[rows], keys[hit]], axis=1)
                    cut = merged.shape[1] - width
                    best[rows] = np.partition(merged, cut, axis=1)[:, cut:]
                    least = best[rows, 0]
                    reach = np.sqrt(np.maximum(0.0, squares[rows] + self.top_square - 2.0 * (least // n))) + EPS
                    limit[rows] = np.where(least > worst_of, reach, np.inf)
                else:
                    children, routers, radii, _ = entry
                    todo = gap - radii <= limit[rows][:, None]
                    cols = np.flatnonzero(todo.any(axis=0))
                    self.computed += len(rows) * len(cols)
                    far = self._from(q[rows], squares[rows], routers[cols])
                    lower = np.maximum(np.maximum(bound[part][:, None], far - radii[cols] - EPS), 0.0)
                    into = rows[:, None], children[cols]
                    low[into] = np.where(todo[:, cols] & (lower <= limit[rows][:, None]), lower, np.inf)
                    away[into] = far
        found = best > worst_of
        none[:, :width] = np.where(found, self.by_id[n - 1 - best % n], -1)
        scores = np.full((m, k), -1, np.int64)
        scores[:, :width] = best // n
        return none, scores

    def _from(self, q: np.ndarray, squares: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, squares[:, None] + self.top_square - 2.0 * (q @ points.T)))

    def _search_exactly(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Components so large that doubles aren't exact: all of the tree by whole numbers of any size, as objects."""
        entries, scores = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -1, object)
        points = self.points.astype(np.int64) if self.whole is None else self.whole
        for row, query in enumerate(queries):
            exact = whole_products(query[None, :], points)[0]
            order = np.lexsort((-self.place, np.unique(-exact, return_inverse=True)[1]))[:k]
            entries[row, : len(order)], scores[row, : len(order)] = order, exact[order]
        return entries, scores

    def best(self, queries: np.ndarray, query_ids: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of the k best of each query id other than itself; owner: its row of queries. Scores may be objects."""
        entries, scores = self.search(queries, k + 1)
        if scores.dtype == object:  # go on with places among the scores
            values, places = np.unique(scores, return_inverse=True)
            query, found, place = self._best(entries, places.reshape(scores.shape), query_ids, owner, k)
            return query, found, values[place]
        return self._best(entries, scores, query_ids, owner, k)

    def _best(self, entries: np.ndarray, scores: np.ndarray, query_ids: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at = np.nonzero(entries >= 0)
        entry, score = entries[row, at], scores[row, at]
        counts = self.counts[entry]
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = self.ids[np.repeat(self.starts[entry], counts) + inner]
        row, score = np.repeat(row, counts), np.repeat(score, counts)
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        good = place <= k
        table, points = np.zeros((2, len(entries), k + 1), np.int64)
        held = np.zeros((len(entries), k + 1), bool)
        table[row[good], place[good]], points[row[good], place[good]], held[row[good], place[good]] = ids[good], score[good], True
        other = held[owner] & (table[owner] != query_ids[:, None])
        other &= np.cumsum(other, axis=1) <= k
        return np.repeat(query_ids, other.sum(axis=1)), table[owner][other], points[owner][other]


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each usable vector, exact repeats once."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")).dropDuplicates()


def whole_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of 64-bit whole numbers as objects, exact: sums of limb products stay below 2^53."""

    def limbs(x: np.ndarray) -> list[np.ndarray]:
        mask = (1 << LIMB) - 1
        return [(x & mask).astype(np.float64), (x >> LIMB & mask).astype(np.float64), (x >> 2 * LIMB).astype(np.float64)]

    out = np.zeros((len(left), len(right)), object)
    for k in range(0, left.shape[1], LIMB_COMPONENTS):
        for i, a in enumerate(limbs(left[:, k : k + LIMB_COMPONENTS])):
            for j, b in enumerate(limbs(right[:, k : k + LIMB_COMPONENTS])):
                out += (a @ b.T).astype(np.int64).astype(object) << LIMB * (i + j)
    return out


def order_key(score: int) -> bytes | None:
    """Bytes that sort as scores do, of those at or beyond the 64-bit bounds."""
    return None if LEAST < score < MOST else (score + (1 << 159)).to_bytes(20, "big")


def plant(rows: DataFrame, trees: int, k: int, base: str) -> DataFrame:
    """(tree, dim): an M-tree for each piece of the vectors, stored as a file below base."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(frame["v"].to_numpy()).astype(np.int64)
        every, owner = np.unique(points, axis=0, return_inverse=True)
        order = np.lexsort((frame["id"].to_numpy(), owner))
        ids = frame["id"].to_numpy()[order]
        heads = np.searchsorted(owner[order], np.arange(len(every)))
        tree = MTree(every, [part[: k + 1] for part in np.split(ids, heads[1:])])
        number, dim = int(frame["tree"].iloc[0]), points.shape[1]
        write_arrays(base, f"tree-{number}-{dim}", [np.frombuffer(pickle.dumps(tree, 5), np.uint8)])
        return pd.DataFrame({"tree": [number], "dim": [dim]})

    dealt = rows.withColumn("tree", F.expr(f"pmod(xxhash64(id), {trees})")).withColumn("dim", F.size("v"))
    return dealt.groupBy("tree", "dim").applyInPandas(run, "tree long, dim int")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, query_step: int = QUERY_STEP, tree_rows: int = TREE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score, computed): the k best of every row whose id is divisible by query_step.

    computed: distances that the trees computed for the query's block, a query.
    """
    spark = vectors.sparkSession
    rows = staged(usable_vectors(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    # every query goes to every tree, so trees are large where that still leaves work for all executors
    trees = max(1, -(-n // max(tree_rows, min(MOST_TREE_ROWS, n // TREES))))
    blocks = max(1, -(-n // (query_step * block_rows)))
    base = staged_path(spark, "m-trees")
    forest = staged(plant(rows, trees, k, base), "m-forest")
    queries = rows.filter(F.col("id") % query_step == 0).withColumn("dim", F.size("v"))
    # a block has a bounded number of queries; each goes to every tree of its length
    queries = queries.withColumn("block", F.expr(f"pmod(xxhash64(id, 1), {blocks})")).groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    queries = queries.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("tree", F.col("tree").cast("long"))
    # the blocks of one tree come one after the other, so a worker reads it once
    work = queries.join(forest.hint("shuffle_hash"), ["tree", "dim"]).sortWithinPartitions("tree", "dim").select("tree", "dim", F.col("queries.id").alias("ids"), F.flatten("queries.v").alias("flat"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                wanted = f"tree-{batch.column(0)[i].as_py()}-{batch.column(1)[i].as_py()}"
                if wanted != name:
                    name, tree = wanted, pickle.loads(map_bytes(base, wanted))
                ids = np.asarray(batch.column(2)[i].values)
                vectors = np.asarray(batch.column(3)[i].values).reshape(len(ids), -1)
                every, owner = np.unique(vectors, axis=0, return_inverse=True)
                tree.computed = 0
                query, found, score = tree.best(every, ids, owner.reshape(-1), k)
                keys = [order_key(x) for x in score] if score.dtype == object else [None] * len(score)
                shown = pa.array(np.clip(score, LEAST, MOST).astype(np.int64) if score.dtype == object else score)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), shown, pa.array(keys, pa.binary()), pa.array(np.full(len(query), tree.computed / len(ids)))], ["query_id", "vec_id", "score", "beyond", "computed"])

    found = work.mapInArrow(run, "query_id long, vec_id long, score long, beyond binary, computed double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "computed")


def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return staged(top_k(read_table(spark, sf_dir, "embeddings")).drop("computed"), "mtree-top", keep=True)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
