import numpy as np
import pytest

from kbspark.llm.bagminhash import band_keys, processes, signatures
from kbspark.llm.near_dup import bag, overlap, similarities


def jaccard(a, b):
    return np.minimum(a, b).sum() / np.maximum(a, b).sum()


@pytest.mark.parametrize("top", [2, 3, 9, 40, 1000])
def test_unbiased(top):
    rng = np.random.default_rng(top)
    n, m = 25, 8192
    element = rng.integers(0, 2**63, n).astype(np.uint64)
    a = rng.integers(1, top, n)
    b = np.where(rng.random(n) < 0.6, a, rng.integers(1, top, n))
    got = signatures(np.repeat([0, 1], n), np.concatenate([element, element]), np.concatenate([a, b]), 2, m)
    want = jaccard(a, b)
    assert abs((got[0] == got[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / m) + 1e-9


def test_order_and_batch_do_not_matter():
    rng = np.random.default_rng(1)
    e, w = rng.integers(0, 2**63, 50).astype(np.uint64), rng.integers(1, 9, 50)
    one = signatures(np.zeros(50, int), e, w, 1, 64)
    p = rng.permutation(50)
    assert (signatures(np.ones(50, int), e[p], w[p], 3, 64)[1] == one[0]).all()
    assert (signatures(np.empty(0, int), e[:0], w[:0], 2, 64) == 0).all()
    assert len(set(band_keys(one, 16)[0])) == 16


def test_processes_cover_the_weight():
    for w in (1, 2, 3, 4, 5, 8, 9, 1000):
        _, _, low, high, _ = processes(np.array([0]), np.array([7], np.uint64), np.array([w]))
        assert low[0] == 0 and (low[1:] == high[:-1]).all() and high[-1] >= w > low[-1]


def test_similarities_match_counts():
    rng = np.random.default_rng(2)
    bags = [bag(rng.integers(0, 3, rng.integers(1, 60)), 2) for _ in range(12)]
    got = similarities(bags, columns=7)
    for i, (u, c) in enumerate(bags):
        for j, (v, d) in enumerate(bags):
            if i == j:
                continue
            x, y = dict(zip(u.tolist(), c.tolist())), dict(zip(v.tolist(), d.tolist()))
            both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            want = both / (sum(x.values()) + sum(y.values()) - both)
            assert abs(got[i, j] - want) < 1e-6 and abs(overlap(u, c, v, d) - want) < 1e-12
