"""Rank fusion: kind filter on candidates, reciprocal rank sums, ties by list order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
RRF_K = 60
MAX_K = 50


def clamp_k(k: int) -> int:
    return min(max(k, 1), MAX_K)


def keep_kinds(ranked: DataFrame, sections: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Candidates of the given kinds, ranked anew. It runs on the at most 50 candidates of a list, never before the cut."""
    if not kinds:
        return ranked
    fit = sections.filter(F.col("source_kind").isin(kinds)).select("corpus", "id")
    rank = F.row_number().over(Window.partitionBy("qid", "corpus").orderBy("rank"))
    return ranked.join(fit, ["corpus", "id"], "left_semi").withColumn("rank", rank)


def fuse(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """(qid, corpus, id, rrf, place) of lists (qid, corpus, id, rank), in the order of the lists.

    Equal sums go by the first list that has the item, then by its rank there.
    """
    both = None
    for place, one in enumerate(lists):
        one = one.select("qid", "corpus", "id", "rank", F.lit(place).alias("list"))
        both = one if both is None else both.unionByName(one)
    return fuse_ranked(both, k)


def fuse_ranked(ranked: DataFrame, k: int | None = None) -> DataFrame:
    """The same for one table (qid, corpus, id, rank, list)."""
    sums = ranked.groupBy("qid", "corpus", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "first", "corpus", "id"))
    out = sums.withColumn("place", place).drop("first")
    return out.filter(F.col("place") <= clamp_k(k)) if k is not None else out
