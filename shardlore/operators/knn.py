"""Exact cosine neighbours.

Distances are 1 - dot / (|a| |b|) in doubles.  One query is a scan with a
top-k.  Up to ``BLOCK`` queries are broadcast and meet each Arrow batch of vectors
in a matrix product.  More queries, like the vectors, are dealt to blocks, and
each pair of blocks is one product.  Only each product's best go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value.
DEPTH = 50
#: Queries of a block, and vectors of a block that meets them.
BLOCK, VECTOR_BLOCK = 2048, 4096
#: Queries whose distances are in memory at once.
ROWS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], depth: int = DEPTH) -> DataFrame:
    """(id, distance) of one query's neighbours: a scan with TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", F.abs(F.round(cosine_distance(F.col("embedding"), q), 6)).alias("distance")).orderBy("distance", "id").limit(depth)


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, corpus: str, depth: int) -> pd.DataFrame:
    """The best of one block of vectors for each of a block of queries. Only what reaches a query's depth-th distance is sorted."""
    q, v = q / np.linalg.norm(q, axis=1, keepdims=True), v / np.linalg.norm(v, axis=1, keepdims=True)
    rows, columns, near = [], [], []
    for first in range(0, len(q), ROWS):
        d = np.abs(np.round(1 - q[first : first + ROWS] @ v.T, 6))
        last = np.partition(d, depth - 1, axis=1)[:, depth - 1 : depth] if d.shape[1] > depth else np.full((len(d), 1), np.nan)
        # not greater, so that ties and distances that are no numbers stay for the sort
        row, column = np.nonzero(~(d > last))
        rows.append(row + first)
        columns.append(column)
        near.append(d[row, column])
    row, column, d = (np.concatenate(x) for x in (rows, columns, near)) if rows else (np.zeros(0, int),) * 3
    order = np.lexsort((ids[column], d, row))
    row, column, d = row[order], column[order], d[order]
    heads = np.searchsorted(row, row)  # where each row's entries begin
    kept = np.arange(len(row)) - heads < depth
    return pd.DataFrame({"qid": qids[row[kept]], "corpus": corpus, "id": ids[column[kept]], "distance": d[kept]})


def nearest_batch(vectors: DataFrame, queries: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(qid, corpus, id, distance, rank). queries: (qid, embedding); vectors: (corpus, id, embedding)."""
    spark = vectors.sparkSession
    schema = f"qid {dict(queries.dtypes)['qid']}, corpus string, id long, distance double"
    vectors = vectors.select("corpus", "id", "embedding").filter("embedding is not null")
    queries = queries.select("qid", "embedding").filter("embedding is not null")
    few = queries.limit(block + 1).collect()
    if len(few) <= block:
        found = _scanned(vectors, few, schema, depth) if few else spark.createDataFrame([], schema)
    else:
        found = _by_blocks(vectors, queries, schema, depth, block)
    rank = F.row_number().over(Window.partitionBy("qid", "corpus").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= depth)


def _scanned(vectors: DataFrame, queries: list, schema: str, depth: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in queries]), np.array([r[1] for r in queries], np.float64)))  # at most BLOCK queries

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for corpus, group in part.groupby("corpus"):
                yield _best(*shared.value, group["id"].to_numpy(), np.stack(group["embedding"].to_numpy()).astype(np.float64), corpus, depth)

    return vectors.mapInPandas(scan, schema)


def _by_blocks(vectors: DataFrame, queries: DataFrame, schema: str, depth: int, block: int) -> DataFrame:
    vector_blocks, query_blocks = -(-vectors.count() // VECTOR_BLOCK), -(-queries.count() // block)
    left = vectors.withColumn("vb", F.expr(f"pmod(xxhash64(corpus, id), {max(1, vector_blocks)})")).groupBy("vb", "corpus").agg(F.collect_list(F.struct("id", "embedding")).alias("v"))
    right = queries.withColumn("qb", F.expr(f"pmod(xxhash64(qid), {max(1, query_blocks)})")).groupBy("qb").agg(F.collect_list(F.struct("qid", "embedding")).alias("q"))
    right = right.withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, vector_blocks - 1)).cast("long"))))
    pairs = left.join(right.hint("shuffle_hash"), "vb").select("corpus", F.col("v.id").alias("ids"), F.flatten("v.embedding").alias("v"), F.col("q.qid").alias("qids"), F.flatten("q.embedding").alias("q"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                yield _best(np.asarray(r.qids), np.asarray(r.q, np.float64).reshape(len(r.qids), -1), np.asarray(r.ids), np.asarray(r.v, np.float64).reshape(len(r.ids), -1), r.corpus, depth)

    return pairs.mapInPandas(run, schema)
