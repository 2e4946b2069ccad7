"""Chains and draws of many areas: what is worked out once for equal counts has the law of what each area's own steps have."""

import math

import numpy as np
import pytest
from blockweave.operators import chains, solve
from chain_reference import reduced_edges
from pyspark.sql import functions as F

TYPES = [(1, (0, 1, 1), 0.2), (2, (1, 0, 1), 0.3), (3, (1, 1, 1), 0.1), (4, (2, 0, 1), 0.4)]
V, LOGP = np.array([v for _, v, _ in TYPES]), np.log([p for _, _, p in TYPES])


@pytest.mark.parametrize("steps", [1, 2, 7, 10_000])
def test_ends_have_the_law_of_the_matrix_power(steps):
    states, edges = reduced_edges(np.array([5, 2, 5]), V, LOGP, 2)
    p = np.zeros((len(states),) * 2)
    for a, b, w in edges:
        p[a, b] += w
    law = chains.end_law(states[0], V, LOGP, 2, steps, "reduced", np.inf, {})
    got = dict(zip([s for _, s in law], np.diff([0.0, *[u for u, _ in law]]), strict=True))
    want = np.linalg.matrix_power(p, steps)[0]
    assert len(states) > 2 and got == pytest.approx({s: w for s, w in zip(states, want, strict=True) if w > 0})


def test_a_chain_with_too_much_to_compute_is_walked():
    assert chains.end_law((1, 3, 0, 1), V, LOGP, 2, 10, "reduced", 0.5, {}) is None


@pytest.mark.parametrize("steps", [100_000_000, 1])  # the one would never end if they were walked, the other is walked
def test_many_areas_with_equal_counts(spark, steps):
    elements = spark.createDataFrame([(e, list(v), p) for e, v, p in TYPES], "elem_id int, v array<int>, p double")
    areas = spark.range(900).select(F.col("id").alias("block"), F.when(F.col("id") % 3 < 2, F.array(*map(F.lit, (5, 2, 5)))).when(F.col("id") > 2, F.array(*map(F.lit, (1, 9, 1)))).alias("counts"))
    rows = chains.sample_chains(areas, elements, "block", "counts", steps=steps, k=2, seed=3).groupBy("elems", "exact", "chain").count().collect()
    states, _ = reduced_edges(np.array([5, 2, 5]), V, LOGP, 2)
    assert sum(r["count"] for r in rows) == 600 and all(r.exact and r.chain == 0 for r in rows)
    got = {tuple(sorted((x.elem_id, x.n) for x in r.elems)): r["count"] for r in rows}
    assert set(got) <= {tuple((i + 1, m) for i, m in enumerate(s) if m) for s in states} and len(got) > 1


def test_draws_of_equal_counts_are_made_together():
    counts, held = (5, 2, 5), [(e, v, p) for e, v, p in TYPES]
    fit = solve._fitting(counts, held)
    layers = list(solve._layers(counts, fit))
    u = solve._uniforms(np.arange(20_000, dtype=np.uint64), len(fit))
    assert abs(u.mean() - 0.5) < 0.01 and len(np.unique(u)) == u.size
    got, n = np.unique(solve._ancestors(layers, fit, u), axis=0, return_counts=True)
    w = np.exp([sum(k * lp - math.lgamma(k + 1) for k, (_, _, lp) in zip(x, fit, strict=True)) for x in got.tolist()])
    assert len(got) == len(chains.exact_states(np.array(counts), V, LOGP)) and ((got @ V) == counts).all()
    assert np.abs(n / n.sum() - w / w.sum()).sum() / 2 < 0.02
