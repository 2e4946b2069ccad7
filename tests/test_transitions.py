"""Distributed graphs, gaps and removals against plain loops and all eigenvalues."""

import itertools

import numpy as np
import pytest
from blockweave.operators import chains, solve, spectrum, transitions
from pyspark.sql import functions as F

from chain_reference import KINDS

TYPES = [([0, 1, 1], 0.2), ([1, 0, 1], 0.3), ([1, 1, 1], 0.1), ([2, 0, 1], 0.4)]
AREAS = {"a": [4, 2, 4], "b": [3, 1, 3], "none": [0, 0, 1], "empty": [0, 0, 0]}


@pytest.fixture(scope="module")
def given(spark):
    elements = solve.lexicographic(spark.createDataFrame(TYPES, "v array<int>, p double"))
    return spark.createDataFrame([*AREAS.items(), ("null", None)], "block string, counts array<int>"), elements


def plain(kind, param):
    v, logp = np.array([x for x, _ in TYPES]), np.log([p for _, p in TYPES])
    out = {}
    for block, counts in AREAS.items():
        c = np.array(counts)
        fit = [i for i in range(len(v)) if (v[i] <= c).all()]
        found, edges = KINDS[kind](c, v[fit].reshape(len(fit), 3), logp[fit], param)
        names = [tuple(fit[i] + 1 for i, n in enumerate(s) for _ in range(n)) for s in found]
        out[block] = {(names[a], names[b]): w for a, b, w in edges}
    return out


@pytest.mark.parametrize("kind,param", [("reduced", 2), ("reduced", 3), ("gibbs", 0.8), ("simple", 0.4)])
def test_graphs(given, kind, param):
    rows = transitions.transition_graphs(*given, "block", "counts", kind, param).collect()
    got = {}
    for r in rows:
        got.setdefault(r.block, {})[tuple(r.elems_src), tuple(r.elems_dst)] = r.weight
        assert r.left_src == sum(AREAS[r.block]) - sum(sum(TYPES[e - 1][0]) for e in r.elems_src)
    want = {b: e for b, e in plain(kind, param).items() if e}
    assert len(rows) == sum(map(len, got.values())) and set(got) == set(want)
    for block, edges in want.items():
        assert got[block] == pytest.approx(edges, abs=1e-12)


@pytest.mark.parametrize("kind,param", [("reduced", 2), ("gibbs", 0.8)])
def test_gaps_equal_all_eigenvalues(given, kind, param):
    edges = transitions.transition_graphs(*given, "block", "counts", kind, param)
    edges = edges.filter("block <> 'a'") if kind == "gibbs" else edges  # a step is a few jobs
    got = {r.block: r for r in spectrum.spectral_gaps(edges, ["block"]).collect()}
    for block, weights in plain(kind, param).items():
        if not weights or (kind == "gibbs" and block == "a"):
            assert block not in got
            continue
        names = sorted({a for a, _ in weights})
        p = np.zeros((len(names), len(names)))
        for (a, b), w in weights.items():
            p[names.index(a), names.index(b)] = w
        values = np.sort(np.abs(np.linalg.eigvals(p)))
        r = got[block]
        assert r.num_states == len(names) and r.is_connected
        assert r.spectral_gap == pytest.approx(1 - values[-2] if len(names) > 1 else 1.0, abs=1e-8)
        assert r.tolerance < 1e-9


def test_a_graph_in_two_parts_has_no_gap(spark):
    rows = [(g, a, b, w, 0.0) for g, cut in (("one", 0.3), ("two", 0.0)) for a, b, w in [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.5 - cut), (1, 2, cut), (2, 1, cut), (2, 2, 1 - cut)]]
    got = {r.g_: r for r in spectrum.spectral_gaps(spark.createDataFrame(rows, "g_ string, src long, dst long, weight double, log_pi_src double"), ["g_"]).collect()}
    assert (got["two"].is_connected, got["two"].spectral_gap) == (False, 0.0)
    values = np.sort(np.abs(np.linalg.eigvalsh(np.array([[0.5, 0.5, 0], [0.5, 0.2, 0.3], [0, 0.3, 0.7]]))))
    assert got["one"].spectral_gap == pytest.approx(1 - values[-2], abs=1e-8)


def test_removals_between_two_states(spark, given):
    states = [(1, 1, 2, 4), (2, 2, 2, 3), (1, 2), (1, 1, 1, 1)]
    pairs = spark.createDataFrame([(list(a), list(b)) for a in states for b in states], "a array<int>, b array<int>")
    for k in (1, 2, 3):
        want = set()
        for a, b in itertools.product(states, states):
            for r in set(itertools.combinations(a, k)):
                keep = list(a)
                for x in r:
                    keep.remove(x)
                if all(keep.count(x) <= b.count(x) for x in keep):
                    want.add((a, b, r, tuple(keep), tuple(np.sum([TYPES[x - 1][0] for x in r], axis=0).tolist())))
        rows = transitions.consistent_removals(pairs, given[1], "a", "b", k).collect()
        assert len(rows) == len(want)
        assert {(tuple(r.a), tuple(r.b), tuple(r.removed), tuple(r.kept), tuple(r.sub)) for r in rows} == want


def test_steps_against_a_row(spark, given):
    graph = transitions.transition_graphs(*given, "block", "counts", "reduced", 2).filter("block = 'b'")
    src = graph.select("elems_src").first()[0]
    seen = spark.createDataFrame([("b", src, src)] * 8, "block string, src array<int>, dst array<int>")
    row = transitions.empirical_row(seen, graph, "block").collect()
    loop = graph.filter(F.col("elems_src") == F.col("elems_dst")).filter(F.col("elems_src") == F.array(*map(F.lit, src))).first()
    assert [(r.block, r.n_steps, round(r.tvd, 9)) for r in row] == [("b", 8, round(1 - loop.weight, 9))]


def test_reachable_keeps_each_frontier_once(spark):
    path = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert sorted(r.node for r in chains.reachable(path, spark.createDataFrame([(30,), (35,)], "node long")).collect()) == list(range(30, 41))


def test_analysis_of_chains(given):
    import math

    from blockweave.functions.bounds import EPSILON
    from blockweave.plans.analysis import analyse

    targets, elements = given
    few = targets.filter("block in ('b', 'none')")
    one = {r.block: r for r in analyse(few, elements, "block", "counts", "reduced", 2).collect()}
    assert set(one) == {"b"} and one["b"].density == 1.0 and one["b"].num_states == one["b"].num_solutions and one["b"].expected_lower is None
    gap = one["b"].spectral_gap
    assert one["b"].lower == math.floor((1 / gap - 1) * math.log(1 / (2 * EPSILON)) + 1e-6) and one["b"].upper == math.ceil(math.log(one["b"].num_states / EPSILON) / gap - 1e-6)
    two = {r.block: r for r in analyse(few, elements, "block", "counts", "gibbs", 0.8).collect()}
    assert two["b"].num_solutions == one["b"].num_states and 0 < two["b"].density < 1 and two["b"].lower <= two["b"].upper and two["b"].expected_lower > two["b"].lower
    assert two["none"].num_solutions == 0 and two["none"].num_states == 1
