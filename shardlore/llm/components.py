"""Connected components of an edge table, without a driver-side graph.

Tasks of about ``FOREST`` edges first reduce their share to a spanning forest
with union-find, which keeps at most one edge per vertex they saw.  The forest
of one task that saw all edges is the result.  Otherwise, alternating
large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) turn the forest into stars: every vertex ends with
an edge to the smallest id of its component.  Each round is written to the
shared folder, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, staged

#: Edges that a task reduces, about (some 200 MB).
FOREST = 1_000_000
ROUNDS = 60
#: Vertices at most whose edges aren't dealt by vertex (16 bytes each in a broadcast).
HUBS = 20_000


class UnionFind:
    """Union by smallest id, with path halving."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(sets: UnionFind) -> pa.RecordBatch:
        pairs = [(x, sets.find(x)) for x in sets.parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    sets, n = UnionFind(), 0
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(u, v)
        n += batch.num_rows
        if n >= 2 * FOREST:  # parts are of uneven size
            yield out(sets)
            sets, n = UnionFind(), 0
    if sets.parent:
        yield out(sets)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on edges (u, v), u > v. Large: the larger neighbours of each vertex move to its smallest; small: the smaller ones do.

    No task gets all edges of a hub: hubs are the vertices with more than one
    in ``HUBS`` of all edge ends, so there are at most ``HUBS`` of them, and
    they are broadcast; the edges of all other vertices are dealt by vertex.
    """
    if large:
        edges = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    share = edges.count() // HUBS
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u")), "star-least")
    hubs = F.broadcast(least.filter(F.col("n") > share).select("u", "m"))  # at most HUBS rows
    moved = edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(least.filter(F.col("n") <= share).select("u", "m").hint("merge"), "u"))
    if large:
        return moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = moved.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex with an edge to another; component: its smallest vertex.

    edges: two long columns. Loops and nulls are ignored; repeated edges and
    either direction are fine. No edges: an empty result.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = staged(edges, "edges")
    tasks = -(-edges.count() // FOREST)
    edges = staged(edges.coalesce(max(1, tasks)).mapInArrow(_forest, "u long, v long"), "forest")
    if tasks <= 1:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    edges = staged(edges.dropDuplicates(), "forest-distinct")
    mark = None
    for _ in range(ROUNDS):
        edges = staged(_star(edges, large=True).filter("u > v").dropDuplicates(), "large-star")
        edges = staged(_star(edges, large=False).filter("u > v").dropDuplicates(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        free_shuffles(edges.sparkSession)  # and the rounds' broadcast hubs
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
