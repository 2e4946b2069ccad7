"""A search that is cut off is told from an area without a solution."""

import numpy as np
import pytest
from blockweave.operators import chains, solve
from blockweave.plans import demo
from blockweave.plans.catalog_models import TOY, TOY_COUNTS, toy_elements
from blockweave.plans.generate import generate
from pyspark.sql import functions as F


def areas(spark):
    return spark.createDataFrame([("cut", list(TOY_COUNTS)), ("none", [0, 0, 1])], "block string, counts array<int>")


def test_cut_off_area_has_a_row(spark):
    out = solve.enumerate_solutions(areas(spark), toy_elements(spark), "block", "counts", max_nodes=2).collect()
    assert [tuple(r) for r in out] == [("cut", None, None, None, None, False)]
    out = solve.enumerate_solutions(areas(spark), toy_elements(spark), "block", "counts").collect()
    assert [(r.block, r.sol_rank, r.complete) for r in out] == [("cut", 1, True), ("cut", 2, True)]


def test_relax_does_not_move_a_cut_off_area_on(spark):
    coarse = solve.lexicographic(spark.createDataFrame([([1], 1.0)], "v array<int>, p double"))
    d = areas(spark).withColumn("some", F.array(F.lit(1)))
    got = solve.relax(d, [(1, "counts", toy_elements(spark)), (2, "some", coarse)], "block", max_nodes=4).collect()
    assert {(r.block, r.level, r.elems is None, r.complete) for r in got} == {("cut", 1, True, False), ("none", 2, False, True)}


def test_exact_states_raises_when_cut_off_or_full(monkeypatch):
    v, logp = np.array([x for x, _ in TOY]), np.log([p for _, p in TOY])
    assert len(chains.exact_states(np.array(TOY_COUNTS), v, logp)) == 2
    with pytest.raises(OverflowError):
        chains.exact_states(np.array(TOY_COUNTS), v, logp, max_nodes=2)
    monkeypatch.setattr(chains, "MAX_STATES", 2)
    with pytest.raises(OverflowError):
        chains.exact_states(np.array(TOY_COUNTS), v, logp)


def test_chain_raises_when_its_start_is_cut_off(spark):
    with pytest.raises(Exception, match="cut off"):
        chains.sample_chains(areas(spark), toy_elements(spark), "block", "counts", steps=1, max_nodes=2).collect()


def test_generate_names_the_cut_off_blocks(spark, sf):
    members = spark.range(4).select(F.lit(1).alias("COUNTYA"), F.lit(1).alias("TRACTA"), F.lit(1).alias("BLOCKA"), F.col("id").cast("int").alias("kind"))
    rows, unsolved = generate(demo.blocks_of(members), demo.sample_households(spark), n_best=5, refine_steps=1, max_nodes=1)
    assert [r.level for r in unsolved.collect()] == [1]
    assert rows.count() == 0
