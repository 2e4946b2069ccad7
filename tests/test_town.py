"""The whole plan on a few blocks of the town: every made block adds up to its table, at every level."""

import pytest
from blockweave.operators.dist import adjustment, normalize
from blockweave.plans import town
from blockweave.plans.generate import generate
from blockweave.sources.blocks import age_is_valid, race_by_ethnicity
from blockweave.sources.households import household_distribution, household_tuple, output_vector
from blockweave.sources.scratch import written
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def made(spark, sf):
    orders, lines = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("orders", "lineitem"))
    people = written(town.people_of(orders, lines))
    blocks, sample = town.read_town(people)
    few = written(blocks.filter("BLOCKA < 40"))
    rows, unsolved = generate(few, sample, n_best=20, refine_steps=2)
    return few, sample, written(rows), written(unsolved)


def test_blocks_add_up(made):
    blocks, _, rows, unsolved = made
    hispanic = sum((F.col(c) for c in race_by_ethnicity()[7:]), F.lit(0))
    want = {r.identifier: r for r in blocks.select("identifier", "H7X001", "H8A003", "H8M001", hispanic.alias("h"), age_is_valid().alias("valid"), *[F.col(f"H7X{1 + k:03d}").alias(f"r{k}") for k in range(1, 8)]).collect()}
    races = ["W", "B", "AI_AN", "AS", "H_PI", "OTH", "TWO_OR_MORE"]
    got = rows.groupBy("identifier").agg(F.count(F.lit(1)).alias("homes"), F.sum("TOTAL").alias("n"), F.sum("NUM_HISP").alias("h"), F.sum("18_PLUS").alias("a"), F.max("ACCURACY").alias("level"), F.max("AGE_ACCURACY").alias("valid"), *[F.sum(c).alias(c) for c in races]).collect()
    assert {r.identifier for r in got} | {r.identifier for r in unsolved.collect()} == set(want) and len(got) > len(want) * 0.9
    for r in got:
        w = want[r.identifier]
        assert (r.n, r.h, r.valid) == (w.H7X001, w.h, w.valid) and [r[c] for c in races] == [w[f"r{k}"] for k in range(1, 8)]
        assert r.a == w.H8A003 or not w.valid
        assert r.homes == w.H8M001 or r.level == 3
    assert {r.level for r in got} >= {1, 2} and {r.valid for r in got} == {True, False}


def test_persons_add_up(made):
    _, sample, rows, _ = made
    people = town.town_persons(rows, sample)  # an error if a household's people do not
    assert people.count() == rows.agg(F.sum("TOTAL")).first()[0] and people.filter("known").count() > 0


def test_weights_close_the_loop(made):
    """Ratios of what was made to the sample weigh the next run's sample; blocks add up again."""
    blocks, sample, rows, _ = made
    share = lambda d: normalize(d.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "n").select("key", "p")
    out = F.array(*[F.col(c) for c in ("W", "B", "AI_AN", "AS", "H_PI", "OTH", "TWO_OR_MORE", "NUM_HISP", "18_PLUS")])
    ratios = adjustment(share(household_tuple(sample).select(output_vector().alias("key"))), share(rows.select(out.alias("key"))), ["key"])
    assert ratios.filter("ratio > 1.01").count() and ratios.filter("ratio < 0.99").count()
    before, after = ({tuple(r.v): r.p for r in household_distribution(sample, 3, ratios=x).collect()} for x in (None, ratios))
    assert set(before) == set(after) and abs(sum(after.values()) - 1) < 1e-9 and before != after
    again, _ = generate(blocks.limit(6), sample, n_best=20, refine_steps=0, ratios=ratios)
    sums = again.groupBy("identifier").agg(F.sum("TOTAL").alias("n"), F.max("BLOCK_TOTAL").alias("m")).collect()
    assert sums and all(r.n == r.m for r in sums)
