"""BM25 in arrays against the same by joins, and the blocks it works in."""

import numpy as np
import pyarrow as pa
import pytest

from shardlore.operators import bm25

ROWS = [
    ("a", 1, "one two two three"), ("a", 1, "one four"), ("a", 1, "one two two three"), ("a", 2, "Ünï one"), ("a", 3, None), ("a", 4, ""), ("a", 5, "two " * 300), ("b", 1, "one"), ("b", 7, "three_x two\none"), ("b", 8, "nothing"),
]
QUERIES = [(1, "one two"), (2, "two two three"), (3, "absent"), (4, None), (5, "one OR* two"), (6, "one one four uni")]


def found(frame):
    return sorted((r.qid, r.corpus, r.id, r.rank, round(r.score, 8)) for r in frame.collect())


@pytest.fixture
def tables(spark):
    sections = spark.createDataFrame(ROWS, "corpus string, id long, text string").repartition(3)
    return spark.createDataFrame(QUERIES, "qid long, query string"), sections


def test_arrays_find_what_joins_find(spark, tables, monkeypatch):
    queries, sections = tables
    post, stats = bm25.occurrences(sections, ("text",)), bm25.corpus_stats(sections, ("text",))
    for depth in (50, 1):
        texts, stored = found(bm25.bm25_texts(queries, sections, ("text",), depth)), found(bm25.bm25(queries, post, stats, depth))
        with monkeypatch.context() as m:
            m.setattr(bm25, "BROADCAST_TERMS", 0)
            joined = found(bm25.bm25(queries, post, stats, depth))
        assert texts == stored == joined and texts


def test_no_row_a_text_and_query_is_made(tables):
    # all texts meet all queries inside a task: no join, and at most depth rows a task, query and corpus leave it
    queries, sections = tables
    frame = bm25.bm25_texts(queries, sections, ("text",), 1)
    assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("most_texts", "most_terms"), [(1, 100), (2, 3), (100, 1), (100, 100)])
def test_blocks_end_where_texts_end(most_texts, most_terms):
    ids = [0, 0, 1, 2, 2, 2, 3, 4, 5, 5]
    batch = bm25._rows(["c"] * 10, np.array(ids), np.arange(10), np.ones(10), np.full(10, 2), np.arange(20) % 7, np.ones(20))
    pieces = [batch.slice(k, 3) for k in range(0, 10, 3)] + [batch.slice(0, 0)]
    blocks = [b.column("id").to_pylist() for b in bm25._texts(iter(pieces), most_texts, most_terms)]
    assert sum(blocks, []) == ids
    assert all(not set(a) & set(b) for a, b in zip(blocks, blocks[1:], strict=False))
    assert all(len(set(b)) <= most_texts and (2 * len(b) <= most_terms or len(set(b)) == 1) for b in blocks)
    assert pa.Table.from_batches(list(bm25._merge(iter(pieces)))).num_rows == 10


def test_scores_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    asked = bm25.Asked(list("xyz"), rng.random(9) + 1, np.full(9, 5.0), np.arange(0, 28, 3), np.tile(np.arange(3), 9), rng.random(27))
    text, key = np.sort(rng.integers(0, 6, 40)), rng.integers(0, 9, 40)
    whole = asked.scores(text, 6, np.full(40, 4), key, np.ones(40))
    want = np.zeros((6, 3))
    for t, k in zip(text, key, strict=True):
        part = asked.idf[k] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / 5))
        for at in range(asked.starts[k], asked.starts[k + 1]):
            want[t, asked.query[at]] += part * asked.times[at]
    assert np.allclose(whole, want)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 4)
    assert np.allclose(asked.scores(text, 6, np.full(40, 4), key, np.ones(40)), want)
