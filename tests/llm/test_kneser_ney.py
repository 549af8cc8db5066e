"""The Kneser-Ney model against a plain-dictionary version, and its probabilities sum to 1."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlore.llm import kneser_ney as kn
from shardlore.llm.common import WordHashes

WORDS = "a b c d e f g h".split()


def corpus(n=120):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 12), p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05]))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "ZZ\tzz\n never-seen A"), (None, "a b"), (5, rows[5][1])]


def tokens(text):
    return [w.lower() for w in (text or "").replace("\t", " ").replace("\n", " ").split()] + ["</s>"]


def brute(rows, order):
    train = [tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    raw = Counter(w for t in train for w in t)
    n_all, v = sum(raw.values()), len(raw)
    levels = {order: Counter(tuple(s[k : k + order]) for t in train for s in [["<s>"] * (order - 1 or 1) + t] for k in range((order - 1 or 1) - order + 1, len(s) - order + 1))}
    for level in range(order - 1, 0, -1):
        levels[level] = Counter(g[1:] for g in levels[level + 1])
    discounts, totals, follow = {}, {}, {}
    for level, grams in levels.items():
        n = [sum(c == k for c in grams.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        discounts[level] = [0.0] + [min(float(k), max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else y * k / 2 for k in (1, 2, 3)]
        totals[level], follow[level] = Counter(), defaultdict(Counter)
        for g, c in grams.items():
            totals[level][g[:-1]] += c
            follow[level][g[:-1]][min(c, 3)] += 1

    def p(gram):
        level = len(gram)
        if level == 0:
            return 1 / (v + 1)
        context = gram[:-1]
        lower = p(gram[1:])
        if not totals[level][context]:
            return lower
        c, d = levels[level][gram], discounts[level]
        mass = sum(d[k] * follow[level][context][k] for k in (1, 2, 3))
        return (max(c - d[min(c, 3)], 0) + mass * lower) / totals[level][context]

    out = []
    for i, t in rows:
        toks = tokens(t)
        padded = ["<s>"] * (order - 1 or 1) + toks
        base = sum(math.log10((raw[w] + 0.5) / (n_all + 0.5 * (v + 1))) for w in toks)
        score = sum(math.log10(p(tuple(padded[k - order + 1 : k + 1]))) for k in range(order - 1 or 1, len(padded)))
        out.append((i, len(toks), sum(raw[w] > 0 for w in toks), n_all, base, score))
    vocabulary = [*raw, "<unk>"]
    for context in [("a",) * (order - 1), ("never",) * (order - 1), ("<s>",) * (order - 1)]:
        assert abs(sum(p((*context, w)) for w in vocabulary) - 1) < 1e-9
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, key string")
    got = kn.score_documents(docs, order=order).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    want = sorted(brute(rows, order), key=key)
    found = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in found], [r[4:] for r in want], rtol=1e-9)


def test_small_buckets_and_flushes(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    train = docs.select(F.col("doc_id").alias("id"), "text").filter(F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(5)) != 1)
    big, small = kn.train(train, 2), kn.train(train, 2, bucket=5)
    assert small.grid > big.grid == 1
    words = [WordHashes().array([w.encode() for w in (t or "").lower().split()]) for _, t in rows]
    for a, b in zip(big.score(words), small.score(words), strict=True):
        np.testing.assert_allclose(a, b)


def test_no_training_rows_and_empty_table(spark):
    only = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = kn.score_documents(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)
    assert kn.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_better_than_the_base_on_held_out_text(spark, sf_dir):
    out = kn.op3_lm_score(spark, sf_dir).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]
