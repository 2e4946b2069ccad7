"""The k-best search against trying everything, and on blocks of real size."""

import random
import time

import numpy as np
import pytest
from blockweave.operators import kbest, solve


def tried(counts, v, cost):
    out = []

    def go(i, left, c, chosen):
        if i == len(v):
            if not left.any():
                out.append((c, chosen))
            return
        k = 0
        while (left >= 0).all():
            go(i + 1, left, c + k * cost[i], (*chosen, (i, k)) if k else chosen)
            k, left = k + 1, left - v[i]

    go(0, np.array(counts), 0.0, ())
    return sorted(out, key=lambda x: (round(x[0], 9), [(e, -k) for e, k in x[1]]))


@pytest.mark.parametrize("seed", range(4))
def test_equals_trying_everything(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        d = rnd.randrange(1, 5)
        v = np.array([[rnd.choice([0, 0, 1, 1, 2]) for _ in range(d)] for _ in range(rnd.randrange(1, 7))])
        v = v[v.any(axis=1)]
        cost = -np.log(np.array([rnd.choice([1.0, 0.1, 0.2, 0.3, 0.05, 0.013]) for _ in v]))
        counts = [rnd.randrange(0, 7) for _ in range(d)]
        want = tried(counts, v, cost)
        for n in (1, 3, 5000):
            got, certain = kbest.n_best(np.array(counts), v, cost, n, 10**6)
            assert certain and [x for _, x in got] == [x for _, x in want[:n]]
            assert np.allclose([c for c, _ in got], [c for c, _ in want[:n]])


def test_prices_bound_every_solution():
    rng = np.random.default_rng(3)
    for _ in range(40):
        v = rng.integers(0, 3, (12, 5))
        v = v[v.any(axis=1)]
        cost = rng.random(len(v)) * 5
        x = rng.integers(0, 3, len(v))
        counts = x @ v
        y = kbest.dual_prices(v.astype(float), cost, counts.astype(float))
        assert y is not None and (cost - v @ y >= -1e-6).all() and y @ counts <= x @ cost + 1e-6


def household_types(n, seed=0):
    """Vectors of 14 race counts, children and the household: mostly of one race."""
    rng, p = np.random.default_rng(seed), np.array([0.53, 0.1, 0.01, 0.04, 0.005, 0.005, 0.03, 0.17, 0.05, 0.01, 0.02, 0.01, 0.01, 0.01])
    seen = {}
    while len(seen) < n:
        size = 1 + min(6, int(rng.poisson(1.5)))
        main = rng.choice(14, p=p)
        members = np.where(rng.random(size) < 0.93, main, rng.choice(14, size, p=p))
        seen[(*np.bincount(members, minlength=14).tolist(), int(rng.binomial(size - 1, 0.35)), 1)] = None
    share = rng.dirichlet(np.full(n, 0.5)) + 1e-5
    return np.array(list(seen)), share / share.sum()


def test_a_block_of_25_households():
    v, p = household_types(271)
    counts = np.random.default_rng(3).multinomial(25, p) @ v
    began = time.time()
    found, certain = kbest.n_best(counts, v, -np.log(p), 5000, solve.MAX_NODES)
    assert certain and len(found) == 5000 and time.time() - began < 60
    costs = [c for c, _ in found]
    assert costs == sorted(costs) and len({x for _, x in found}) == 5000
    for c, x in found:
        assert (sum(k * v[e] for e, k in x) == counts).all() and abs(c - sum(-k * np.log(p[e]) for e, k in x)) < 1e-6
    # the best thousand are the same when only they are asked for
    assert [x for _, x in kbest.n_best(counts, v, -np.log(p), 1000, solve.MAX_NODES)[0]] == [x for _, x in found[:1000]]


def test_135_counts():
    """Level 1: the counts name each kind of household as well, so that few multisets are left."""
    v, p = household_types(400, seed=2)
    kind = np.zeros((400, 119), int)
    kind[np.arange(400), (v[:, :14].argmax(axis=1) * 7 + v[:, :14].sum(axis=1) - 1) % 119] = 1
    wide = np.concatenate([v, kind], axis=1)
    assert wide.shape[1] == 135
    truth = np.random.default_rng(5).multinomial(30, p)
    found, certain = kbest.n_best(truth @ wide, wide, -np.log(p), 5000, solve.MAX_NODES)
    assert certain and found
    assert all((sum(k * wide[e] for e, k in x) == truth @ wide).all() for _, x in found)
    true = tuple((int(e), int(truth[e])) for e in np.flatnonzero(truth))
    assert len(found) == 5000 or true in {x for _, x in found}


def test_no_solution_and_cut_off():
    v, p = household_types(271)
    assert kbest.n_best(np.array([1] + [0] * 15), v, -np.log(p), 10, 10**6) == ([], True)
    counts = np.random.default_rng(3).multinomial(25, p) @ v
    assert kbest.n_best(counts, v, -np.log(p), 10, 50) == ([], False)
    assert solve.search((2, -1), [(1, (1, 0), 0.5)], 5) == ([], True)
    assert solve.search((0, 0), [(1, (1, 0), 0.5)], 5) == ([(0.0, {})], True)
    assert solve.search((3, 0), [], 5) == ([], True)
