"""Nearest partners and matching rounds against plain Python."""

import math

import pytest
from blockweave.operators import swap
from pyspark.sql import functions as F

POINTS = [(i, "ab"[i % 2], i % 3, float(i * 37 % 11), float(i * 53 % 7)) for i in range(60)] + [(100 + i, "a", i % 2, 5.0, 5.0) for i in range(90)] + [(300, "alone", 1, 0.0, 0.0), (301, "b", 9, 4000.0, 4000.0)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id long, b string, g int, x double, y double")


@pytest.mark.parametrize("apart", [None, "g"])
def test_nearest_partners(points, apart):
    got = {}
    for r in swap.nearest_partners(points, ["b"], "id", "x", "y", 4, 0.7, apart=apart).collect():
        got.setdefault(r.id, []).append((r["rank"], r.partner, round(r.distance, 9)))
    for i, b, g, x, y in POINTS:
        others = sorted((math.hypot(x - p, y - q), j) for j, c, h, p, q in POINTS if c == b and (x, y) != (p, q) and (apart is None or h != g))[:4]
        assert sorted(got.get(i, [])) == [(n, j, round(d, 9)) for n, (d, j) in enumerate(others, 1)]


def test_only_those_who_ask(spark, points):
    rows = swap.nearest_partners(points, ["b"], "id", "x", "y", 2, 1.0, asking=spark.createDataFrame([(100,), (300,)], "id long")).collect()
    assert {r.id for r in rows} == {100} and len(rows) == 2


@pytest.mark.parametrize("rate", [0.2, 1.0])
def test_matching(points, rate):
    rows = points.withColumn("prob", F.lit(1.0))
    pairs = swap.match_swaps(rows, ["b"], "id", "g", "x", "y", "prob", 3, rate, 4, 1.0).collect()
    by = {p[0]: p for p in POINTS}
    ends = [r.hh_1 for r in pairs]
    assert len(ends) == len(set(ends)) and {(r.hh_1, r.hh_2) for r in pairs} == {(r.hh_2, r.hh_1) for r in pairs}
    for r in pairs:
        a, b = by[r.hh_1], by[r.hh_2]
        assert a[1] == b[1] and a[2] != b[2] and r.distance == pytest.approx(math.dist(a[3:], b[3:])) and r.distance > 0
    if rate < 1:
        assert len(pairs) == int(rate * len(POINTS)) // 2 * 2
    else:  # nobody is left who could still swap with another who is left
        free = [p for p in POINTS if p[0] not in ends]
        assert not any(p[1] == q[1] and p[2] != q[2] and p[3:] != q[3:] for p in free for q in free)


def test_nothing_to_match(points):
    assert swap.match_swaps(points.withColumn("prob", F.lit(0.0)), ["b"], "id", "g", "x", "y", "prob", 3, 0.5, 4, 1.0).count() == 0


def test_first_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("u"), "id")
    assert sorted(r.u for r in swap.first_rows(rows, ["u"], 137).collect()) == list(range(137))
