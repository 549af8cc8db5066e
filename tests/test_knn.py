"""The best of a block against sorting all of it."""

import numpy as np
import pytest

from shardlore.operators import knn


def sorted_all(qids, q, ids, v, depth):
    q, v = q / np.linalg.norm(q, axis=1, keepdims=True), v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.abs(np.round(1 - q @ v.T, 6))
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :depth]
    return np.repeat(qids, order.shape[1]).tolist(), ids[order].ravel().tolist(), np.take_along_axis(d, order, axis=1).ravel().tolist()


@pytest.mark.parametrize(("n", "depth"), [(0, 3), (2, 3), (3, 3), (700, 3), (700, 50)])
def test_same_as_sorting_all(n, depth):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (n, 4)).astype(float)  # many ties, and some vectors without a length
    q, ids, qids = rng.integers(-2, 3, (600, 4)).astype(float), rng.permutation(n), np.arange(600) * 7
    with np.errstate(invalid="ignore"):
        got, want = knn._best(qids, q, ids, v, "c", depth), sorted_all(qids, q, ids, v, depth)
    assert np.array_equal(got["distance"].to_numpy(), np.array(want[2]), equal_nan=True)
    assert (got["qid"].tolist(), got["id"].tolist()) == want[:2]


def test_only_the_near_are_sorted(monkeypatch):
    # sorting every distance of a block is most of the time of an all-pairs search
    rng = np.random.default_rng(4)
    seen, sort = [], np.lexsort
    monkeypatch.setattr(knn.np, "lexsort", lambda keys, **k: seen.append(np.size(keys[-1])) or sort(keys, **k))
    knn._best(np.arange(300), rng.normal(size=(300, 8)), np.arange(2000), rng.normal(size=(2000, 8)), "c", 10)
    assert sum(seen) < 300 * 20
