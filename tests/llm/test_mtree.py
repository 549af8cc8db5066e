"""Top-k against brute force, with ties, copies and unusable vectors; pruning is exact and saves work."""

import numpy as np
import pytest

from shardlore.llm import mtree as mt


def brute(rows, k, step):
    good = {(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, v in sorted(g for g in good if g[0] % step == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize(("sizes", "trees"), [({}, 64), ({"tree_rows": 40, "block_rows": 3}, 64), ({"tree_rows": 40}, 2)])
def test_top_k(spark, sizes, trees, monkeypatch):
    monkeypatch.setattr(mt, "TREES", trees)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(90)]  # many copies of one vector
    rows += [(i, [0.5, 0.25, 0.0, -0.5, 0.5, 0.1]) for i in (500, 520, 501)]
    rows += [(600, None), (620, []), (640, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (660, [float("nan")] + [0.1] * 5), (680, [float("inf")] + [0.1] * 5), (700, [0.3, 0.4]), (701, [0.1, 0.2]), (None, [0.1] * 6), (720, [0.0] * 6)]
    rows += [rows[0], rows[20]]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, v string")
    got = mt.top_k(frame, k=7, **sizes).drop("computed").orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(rows, 7, 20)


def test_empty(spark):
    assert mt.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 40, (30, 16))
    points = np.unique(np.floor(centres[rng.integers(0, 30, 4000)] + rng.normal(0, 3, (4000, 16))).astype(np.int64), axis=0)
    tree = mt.MTree(points, [np.array([i]) for i in range(len(points))], page=32)
    for at in (0, 17, 999):
        tree.computed = 0
        (rows,), (scores,) = tree.search(points[at : at + 1], 10)
        want = sorted(zip(-(points @ points[at]), range(len(points))))[:10]
        assert sorted(zip((-scores).tolist(), tree.ids[tree.starts[rows]].tolist())) == want
        assert tree.computed < len(points) / 2
    together = tree.search(points[:200], 10)
    for at in range(200):  # sharing pages doesn't change a query's result
        alone = tree.search(points[at : at + 1], 10)
        assert set(alone[0][0]) == set(together[0][at])
    lifted = np.column_stack([tree.points, np.sqrt(tree.top_square - tree.squares)])

    def below(at):
        page = tree.pages[at]
        return list(range(page[0], page[1])) if len(page) == 3 else [x for child in page[0] for x in below(child)]

    assert below(tree.root) == list(range(len(points)))
    for page in tree.pages:
        if len(page) == 4:  # radii cover what is below them
            for child, router, radius in zip(*page[:3]):
                router = np.append(router, np.sqrt(tree.top_square - (router**2).sum()))
                assert np.sqrt(((lifted[below(child)] - router) ** 2).sum(axis=1)).max() <= radius + 1e-9


def test_shipped_settings_save_work_on_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (50, 64))
    rows = [(i, [float(x) for x in centres[i % 50] + rng.normal(0, 0.05, 64)]) for i in range(4000)]
    out = mt.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(out) == 200 * 20 and max(r.computed for r in out) < 4000 / 3
    point = {i: np.floor(64 * np.float32(v).astype(float)) for i, v in rows}
    for q in (0, 40, 3980):
        want = sorted((-int(point[q] @ v), i) for i, v in point.items() if i != q)[:20]
        assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in want]


def test_huge_components(spark):
    """Above 2^53, and scores beyond 64 bits, which stay in their true order."""
    big = 2.0**50
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 2.0]), (3, [-big, 0.0]), (4, [0.0, 0.5]), (5, [-big, 3.0]), (6, [2.0**53 / 64, 7.0]), (7, [1.0, 1.0]), (8, [1.0, 2.0**40]), (20, [3.0, -(2.0**46)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sizes in ({}, {"tree_rows": 2}):
        got = mt.top_k(frame, k=9, **sizes).orderBy("query_id", "rank").collect()
        for q in (0, 20):
            own = dict(rows)[q]
            exact = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(own, v)), i) for i, v in rows if i != q)
            assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in exact]
