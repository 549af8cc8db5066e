"""Near-duplicate groups against all pairs, and the pieces of the method."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlore.llm import minhash as mh
from shardlore.llm.common import WordHashes
from shardlore.llm.components import UnionFind, components


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    forest = UnionFind()
    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                forest.union(a, b)
    return sorted((i, len(sets[i]), forest.find(i), forest.find(i) == i) for i, _ in rows if i is not None)


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def corpus():
    rng = np.random.default_rng(11)
    rows = [None, "", "  \n", "one", "One", "a b c d", "a b c d e", "a b c d e"]
    chain = words(rng, 200)
    for k in range(60):  # each is near its neighbours, the ends are far apart
        chain = chain.copy()
        for at in rng.integers(0, 200, 2):
            chain[at] = f"n{k}-{at}"
        rows.append(" ".join(chain))
    base = words(rng, 150)
    for k in range(80):  # a hub and its many variants, most of them not near each other
        own = base.copy()
        own[(3 * k) % 150] = f"x{k}"
        own[(7 * k + 40) % 150] = f"y{k}"
        rows.append(" ".join(own))
    rows += [" ".join(words(rng, n)) for n in rng.integers(1, 120, 60)]
    rows += [rows[10].upper(), rows[100], " ".join(words(rng, 20000))]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)] + [(None, "nobody's text")]


@pytest.mark.parametrize("block", [256, 7])
def test_groups(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 5, "f") for i, t in rows], "doc_id long, text string, id int, f1 string")
    out = mh.near_duplicates(docs, block=block).collect()
    assert sorted(tuple(r) for r in out if r.doc_id is not None) == brute(rows)
    (alone,) = [r for r in out if r.doc_id is None]
    assert alone.kept and alone.component_id is None and alone.n_shingles == 1


def test_unfinished_groups_are_completed(spark, monkeypatch):
    """Buckets of one slot link far documents to their heads, so most links must come from the block comparison."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    original = mh._unfinished
    monkeypatch.setattr(mh, "_unfinished", lambda *a: seen.append(r := original(*a)) or r)
    out = mh.near_duplicates(docs, bands=60, rows=1, block=10).filter("doc_id is not null").collect()
    assert sorted(map(tuple, out)) == brute(rows)
    assert seen


def test_no_join_is_broadcast(spark, monkeypatch):
    """Whatever the size of the tables: what grows with the corpus must not pass the driver."""
    plans = []

    def spied(original):
        return lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or original(df, *a, **k)

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(mh, "staged", spied(mh.staged))
    out = mh.near_duplicates(docs, bands=60, rows=1, block=10).filter("doc_id is not null")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, out.collect())) == brute(rows)
    stage = mh.dedup_stage(spark, docs, "")
    plans.append(stage._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]
    assert sum("SortMergeJoin" in p for p in plans) >= 8


def test_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert mh.near_duplicates(empty).count() == 0
    same = spark.createDataFrame([(3, "a b c")] * 3, "doc_id long, text string")
    assert [tuple(r) for r in mh.near_duplicates(same).collect()] == [(3, 1, 3, True)] * 3


def test_superminhash():
    """Slots agree as often as sets do; the early stop doesn't depend on the company; order and repeats don't matter."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for size in (1, 3, 40, 900):
        a, b = pool[:size], pool[size // 4 : size + size // 4]
        elements = np.concatenate([a, b])
        owner = np.repeat([0, 1], [len(a), len(b)])
        both = mh.superminhash(elements, owner, 2, 128)
        alone = mh.superminhash(np.concatenate([a[::-1], a]), np.zeros(2 * len(a), int), 1, 128)
        assert np.array_equal(both[0], alone[0]) and np.isfinite(both).all()
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((both[0] == both[1]).mean() - true) < 0.17
    ranks = np.sort(np.floor(mh.superminhash(pool[:1], np.zeros(1, int), 1, 128)[0]))
    assert np.array_equal(ranks, np.arange(128))  # one element: each rank once
    spread = [(mh.superminhash(np.concatenate([p[:30], p[10:40]]), np.repeat([0, 1], 30), 2, 128)) for p in rng.integers(0, 2**63, (300, 40)).astype(np.uint64)]
    found = np.array([(s[0] == s[1]).mean() for s in spread])
    assert abs(found.mean() - 0.5) < 0.01 and found.var() < 0.25 / 128  # less than independent slots have


def test_components_with_hubs(spark, monkeypatch):
    import shardlore.llm.components as module

    edges = [(1000, k) for k in range(300)] + [(k, k + 1) for k in range(2000, 2100)] + [(5000 + k, 2050) for k in range(200)]
    want = {(k, 0) for k in [*range(1, 300), 1000]} | {(k, 2000) for k in [*range(2001, 2101), *range(5000, 5200)]}
    for hubs, forest in ((4, 50), (20_000, 100), (20_000, 1_000_000)):
        monkeypatch.setattr(module, "HUBS", hubs)
        monkeypatch.setattr(module, "FOREST", forest)
        assert {(r.vertex, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 90), (90, 100), (7, 7), (None, 3), (200, 201)]
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.vertex, r.component) for r in out} == {(k, 0) for k in range(1, 51)} | {(100, 90), (201, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_texts():
    h = WordHashes()
    assert len(mh.shingle_set(h.array([b"a"] * 4))) == 1 and len(mh.shingle_set(h.array([]))) == 0 and len(mh.shingle_set(h.array([b"a"] * 9))) == 1


def brute_stage(rows, percent=80):
    """Rows (id, text, ...) that stay: of equal (id, text) one row, of each group the least id, ids before none, then any."""
    distinct = list(dict.fromkeys((r[0], r[1]) for r in rows))
    component = {k: c for k, _, c, _ in brute([(n, t) for n, (_, t) in enumerate(distinct)], percent)}
    groups = {}
    for n, key in enumerate(distinct):
        groups.setdefault(component[n], []).append(key)
    return [min(g, key=lambda k: (k[0] is None, k[0] or 0)) for g in groups.values()]


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = mh.dedup_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} == {i for i, *_, k in brute(rows, 80) if k} == {i for i, _ in brute_stage(rows)}


def test_stage_links_at_its_own_similarity(spark):
    """A pair between 80 and 85 percent is linked in the stage and not in the query."""
    words_ = [f"w{k}" for k in range(200)]
    other = [w if k not in (30, 70, 110, 150) else "x" for k, w in enumerate(words_)]
    a, b = shingles(" ".join(words_)), shingles(" ".join(other))
    assert 0.85 > len(a & b) / len(a | b) >= 0.8
    docs = spark.createDataFrame([(1, " ".join(words_)), (2, " ".join(other))], "doc_id long, text string")
    assert [r.doc_id for r in mh.dedup_stage(spark, docs, "").collect()] == [1]
    assert {r.component_id for r in mh.near_duplicates(docs).collect()} == {1, 2}


def test_stage_with_repeated_rows_and_rows_without_an_id(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text, "a"), (1, text, "a"), (2, "other words", None), (3, f"{text} x", "b"), (None, "a b c", "c"), (None, "a b c", "c"), (None, f"y {text}", "d"), (2, "of the same id", "e"), (None, None, "f"), (4, "", "g"), (5, "", "h"), (1, text, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string").withColumn("number", F.lit(1)).withColumn("row", F.lit("r"))
    out = mh.dedup_stage(spark, docs, "")
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert out.columns == docs.columns and found == sorted(brute_stage(rows), key=str)
    assert sorted(found, key=str) == sorted([(1, text), (2, "other words"), (2, "of the same id"), (None, "a b c"), (None, None), (4, ""), (5, "")], key=str)
    again = mh.dedup_stage(spark, docs.repartition(5), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
