"""Ranks inside ranges of the order, against plain Python: hot groups, ties, nulls and empty tables."""

import random

from blockweave.operators import stats, swap


def test_quantiles_of_hot_groups(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(40)])) for _ in range(3000)] + [("one", 5)]
    df = spark.createDataFrame(rows, "g string, x int")
    shares = {"low": 0.0, "mid": 0.5, "high": 0.95}
    got = {r.g: (r.low, r.mid, r.high) for r in stats.rank_quantiles(df, ["g"], "x", shares).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        xs = sorted((x for h, x in rows if h == g), key=lambda x: (x is not None, x or 0))
        want[g] = tuple(xs[int(len(xs) * q)] for q in shares.values())
    assert got == want
    assert stats.rank_quantiles(df.limit(0), ["g"], "x", shares).count() == 0


def test_risk_of_one_frequency(spark):
    rows = [(i, i % 2, (i * 7) % 10) for i in range(1000)]  # two flags as frequent, ties in size
    df = spark.createDataFrame(rows, "id long, flag int, size int")
    got = {r.id: r.risk for r in swap.flag_risk(df, ["flag"], "size", "id").collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    want = {r[0]: 4 if i < 50 else 3 if i < 200 else 2 if i < 500 else 1 for i, r in enumerate(order)}
    assert got == want
