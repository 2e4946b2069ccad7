"""Graph operators and the solver against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from blockweave.operators import chains, noise, solve
from blockweave.plans.catalog_models import QUERIES

from chain_reference import reduced_edges


def test_reachable_on_a_long_path(spark):
    edges = spark.range(60).selectExpr("id as src", "id + 1 as dst")
    assert chains.reachable(edges, spark.range(1).withColumnRenamed("id", "node")).count() == 61


def test_components_of_all_lines(spark, sf):
    edges = {(2 * r.l_partkey, 2 * r.l_suppkey + 1) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {(r.node, r.component) for r in QUERIES["components"](spark, sf).collect()} == {(x, find(x)) for x in list(root)}


def test_projection_that_does_not_settle():
    with pytest.raises(RuntimeError):
        noise.dykstra(np.array([1.0, 2.0]), np.array([1.0, 1.0]), 3.0, 9.0, rounds=50)


def every_multiset(counts, elements):
    """All multisets of elements that add up to the counts."""
    out = []
    most = [min(c // x for c, x in zip(counts, v, strict=True) if x) for _, v, _ in elements]
    for ns in itertools.product(*[range(m + 1) for m in most]):
        if all(sum(n * v[d] for n, (_, v, _) in zip(ns, elements, strict=True)) == c for d, c in enumerate(counts)):
            out.append({e: n for n, (e, _, _) in zip(ns, elements, strict=True) if n})
    return out


@pytest.mark.parametrize("seed", range(8))
def test_search_and_partition_function(seed):
    rnd = random.Random(seed)
    vectors = [v for v in itertools.product(range(3), repeat=3) if any(v)]
    elements = [(i, v, rnd.choice([0.05, 0.1, 0.3])) for i, v in enumerate(sorted(rnd.sample(vectors, 5)), 1)]
    counts = tuple(rnd.randrange(6) for _ in range(3))
    want = every_multiset(counts, [x for x in elements if all(a <= c for a, c in zip(x[1], counts, strict=True))])
    p = {e: q for e, _, q in elements}
    cost = lambda s: -sum(n * math.log(p[e]) for e, n in s.items())
    want.sort(key=lambda s: (round(cost(s), 9), [(e, -n) for e, n in sorted(s.items())]))
    for n_best in (1, 3, 1000):
        got, ended = solve.search(counts, elements, n_best)
        assert ended and [s for _, s in got] == want[:n_best]
    z = sum(math.prod(p[e] ** n / math.factorial(n) for e, n in s.items()) for s in want)
    log_z = solve.log_partition(counts, elements)
    assert math.isclose(math.exp(log_z), z, rel_tol=1e-9, abs_tol=1e-300)


def test_large_pool_ends():
    elements = [(i, v, 0.02 * i) for i, v in enumerate(sorted((a, b) for a in range(1, 7) for b in range(2)), 1)]
    got, ended = solve.search((60, 10), elements, 5000)
    assert len(got) == 5000 and all(a[0] <= b[0] + 1e-9 for a, b in itertools.pairwise(got))


def test_many_types_need_no_recursion():
    elements = [(i, (1, i), 0.5) for i in range(1, 1300)]
    assert solve.log_partition((1, 700), elements) == pytest.approx(math.log(0.5))


def test_areas_with_equal_counts_are_solved_alike(spark):
    elements = solve.lexicographic(spark.createDataFrame([([1, 0], 0.5), ([0, 1], 0.5)], "v array<int>, p double"))
    areas = spark.createDataFrame([("a", [1, 2]), ("b", [1, 2]), ("c", None), ("d", [0, 0])], "block string, counts array<int>")
    got = {(r.block, r.sol_rank, len(r.elems)) for r in solve.enumerate_solutions(areas, elements, "block", "counts").collect()}
    assert got == {("a", 1, 2), ("b", 1, 2), ("d", 1, 0)}
    z = {r.block: r.log_z for r in solve.partition_function(areas, elements, "block", "counts").collect()}
    assert set(z) == {"a", "b", "d"} and z["a"] == z["b"] == pytest.approx(math.log(0.5**3 / 2))


TOY_LISTED = [(1, (0, 1, 1), 0.2), (2, (1, 0, 1), 0.3), (3, (1, 1, 1), 0.1), (4, (2, 0, 1), 0.4)]


def share(rows):
    out = {}
    for x in rows:
        out[x] = out.get(x, 0) + 1
    return {x: n / len(rows) for x, n in out.items()}


def far(a, b):
    return sum(abs(a.get(x, 0) - b.get(x, 0)) for x in {*a, *b}) / 2


def test_draws_follow_the_partition_function(spark):
    counts = (5, 2, 5)
    elements = spark.createDataFrame([(e, list(v), p) for e, v, p in TOY_LISTED], "elem_id int, v array<int>, p double")
    targets = spark.createDataFrame([("a", list(counts)), ("b", list(counts)), ("none", [1, 9, 1]), ("null", None)], "block string, counts array<int>")
    got = solve.partition_draws(targets, elements, "block", "counts", draws=4000, seed=1).collect()
    p = {e: q for e, _, q in TOY_LISTED}
    weigh = {tuple(sorted(s.items())): math.prod(p[e] ** n / math.factorial(n) for e, n in s.items()) for s in every_multiset(counts, TOY_LISTED)}
    want = {s: w / sum(weigh.values()) for s, w in weigh.items()}
    assert math.isclose(math.log(sum(weigh.values())), solve.log_partition(counts, TOY_LISTED))
    for block in "ab":
        drawn = [tuple((x.elem_id, x.n) for x in r.elems) for r in got if r.block == block]
        assert len(drawn) == 4000 and set(drawn) <= set(want) and far(share(drawn), want) < 0.05
    assert {r.block for r in got} == {"a", "b"} and [r.elems for r in got if r.block == "a"] != [r.elems for r in got if r.block == "b"]


@pytest.mark.parametrize("rows", [2_000, 0])
@pytest.mark.parametrize("kind", ["reduced", "metropolis"])
def test_runs_keep_the_stationary_distribution(kind, rows, monkeypatch):
    monkeypatch.setattr(chains, "ROW_REMOVALS", rows)
    counts, v, logp = np.array([3, 1, 3]), np.array([v for _, v, _ in TOY_LISTED]), np.log([p for _, _, p in TOY_LISTED])
    states = chains.exact_states(counts, v, logp)
    w = np.exp([chains.log_prob(np.array(s), logp) for s in states])
    rng, x, memo, seen = np.random.default_rng(3), np.array(states[0]), {}, []
    for _ in range(8_000):
        x = chains.run_exact(x, v, logp, 2, 5, rng, memo, kind)
        seen.append(tuple(int(i) for i in x))
    assert (set(memo["rows", kind].values()) == {None}) if rows == 0 else None not in memo["rows", kind].values()
    assert len(states) > 1 and far(share(seen), dict(zip(states, w / w.sum(), strict=True))) < 0.05


@pytest.mark.parametrize("k", [2, 3])
def test_rows_are_those_of_the_graph(k):
    counts, v, logp = np.array([5, 2, 5]), np.array([v for _, v, _ in TOY_LISTED]), np.log([p for _, _, p in TOY_LISTED])
    states, edges = reduced_edges(counts, v, logp, k)
    for i, s in enumerate(states):
        total, to = chains.chain_row(s, v, logp, k, False, {})
        want = {states[b]: 2 * w for a, b, w in edges if a == i and b != i}
        assert dict(zip(to, np.diff([0, *total]), strict=True)) == pytest.approx(want)


@pytest.mark.parametrize("kind", ["gibbs", "simple"])
def test_steps_keep_the_stationary_distribution(kind):
    counts, v, logp = np.array([3, 1, 3]), np.array([v for _, v, _ in TOY_LISTED]), np.log([p for _, _, p in TOY_LISTED])
    states, gamma = chains.partial_states(counts, v), 0.4
    w = np.exp([chains.log_prob(np.array(s), logp) - gamma * (counts - np.array(s) @ v).sum() for s in states])
    rng, x, seen = np.random.default_rng(3), np.array(states[0]), []
    for _ in range(40_000):
        x = chains.STEPS[kind](x, counts, v, logp, gamma, rng)
        seen.append(tuple(int(i) for i in x))
    assert len(states) > 1 and far(share(seen), dict(zip(states, w / w.sum(), strict=True))) < 0.05


@pytest.mark.parametrize("kind", ["metropolis", "simple"])
def test_samples_against_solutions(spark, kind):
    elements = spark.createDataFrame([(e, list(v), p) for e, v, p in TOY_LISTED], "elem_id int, v array<int>, p double")
    targets = spark.createDataFrame([("a", [3, 1, 3])], "block string, counts array<int>")
    made = chains.sample_chains(targets, elements, "block", "counts", kind=kind, steps=60, k=2, gamma=0.4, chains=600, seed=2)
    row = chains.sample_tvd(made, solve.enumerate_solutions(targets, elements, "block", "counts"), "block").first()
    assert row.block == "a" and row.tvd < (0.1 if kind == "metropolis" else 0.6)  # stopping at the first exact state favours the nearest


def test_instances_and_the_best_of_a_grid(spark):
    elements, targets = solve.instances(spark, [4, 6], [3, 2])
    assert sorted((r.d, tuple(r.v)) for r in elements.collect()) == [(2, (0, 2)), (2, (1, 1)), (2, (2, 0)), (3, (0, 0, 2)), (3, (0, 1, 1)), (3, (0, 2, 0)), (3, (1, 0, 1)), (3, (1, 1, 0)), (3, (2, 0, 0))]
    assert {r.d: round(r.p, 9) for r in elements.collect()} == {2: round(1 / 3, 9), 3: round(1 / 6, 9)}
    assert sorted((r.c, r.d, tuple(r.counts)) for r in targets.collect()) == [(4, 2, (4, 4)), (4, 3, (4,) * 3), (6, 2, (6, 6)), (6, 3, (6,) * 3)]
    grid = spark.createDataFrame([(d, g) for d in (1, 2, 3) for g in (0.1, 0.2)], "d int, g double")
    results = spark.createDataFrame([(1, 0.1, 5.0), (1, 0.2, 5.0), (2, 0.2, 7.0), (2, 0.9, 1.0), (3, 0.1, None)], "d int, g double, t double")
    assert sorted(tuple(r) for r in solve.best_over_grid(results, grid, ["d"], "g", "t").collect()) == [(1, 0.1, 5.0), (2, 0.2, 7.0), (3, None, math.inf)]
    assert solve.best_over_grid(results.limit(0), grid, ["d"], "g", "t").filter("g is null").count() == 3
