"""The L1 adjustment against trying all whole values."""

import itertools
import random

from blockweave.operators import noise
from pyspark.sql import functions as F


def least(t, v, a, b):
    best = None
    for vs in itertools.product(range(b + 1), repeat=len(t)):
        if sum(vs) != b:
            continue
        for ts in itertools.product(range(a + 1), repeat=len(t)):
            if sum(ts) == a and all(x <= y for x, y in zip(vs, ts, strict=True)):
                cost = sum(abs(x - y) for x, y in zip((*ts, *vs), (*t, *v), strict=True))
                best = cost if best is None else min(best, cost)
    return best


def test_least_absolute_change(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for g in range(150):
        n = rnd.choice([1, 2, 2, 3])
        t, v = [rnd.randrange(-2, 6) for _ in range(n)], [rnd.randrange(-2, 6) for _ in range(n)]
        a = rnd.randrange(7)
        b = rnd.randrange(a + 1)
        want[g] = (a, b, t, v, least(t, v, a, b))
        rows += [(g, i, t[i], v[i], a, b) for i in range(n)]
    d = spark.createDataFrame(rows, "g int, node int, tot int, vap int, tot_parent int, vap_parent int")
    got = {}
    for r in noise.adjust_children_l1(d, ["g"], "node").collect():
        got.setdefault(r.g, {})[r.node] = (r.tot, r.vap)
    for g, (a, b, t, v, cost) in want.items():
        pairs = [got[g][i] for i in range(len(t))]
        assert abs(sum(x for x, _ in pairs) - a) < 1e-9 and abs(sum(y for _, y in pairs) - b) < 1e-9
        assert all(-1e-9 <= y <= x + 1e-9 for x, y in pairs)
        assert abs(sum(abs(x - p) + abs(y - q) for (x, y), p, q in zip(pairs, t, v, strict=True)) - cost) < 1e-9, (t, v, a, b)


def test_top_down_with_either_objective(spark):
    leaves = spark.createDataFrame([(f"{1:02d}{c:03d}{t:06d}{b}000", 3 + c + t, 1 + b) for c in (1, 2) for t in (1, 2) for b in (1, 2)], "g string, tot int, vap int")
    truth = noise.rollup_levels(leaves, "g", ["tot", "vap"]).withColumn("measure", F.lit("all"))
    nodes = noise.add_noise(truth, ["tot", "vap"], 0.5, noise.SPLITS["bottom"], 3).select("node", "parent", "level", "measure", F.col("tot_noised").alias("tot"), F.col("vap_noised").alias("vap"))
    own = lambda d, group, key: d.select(*group, key, F.col("tot_parent").alias("tot"), F.col("vap_parent").alias("vap"))
    for adjust in (noise.adjust_children, noise.adjust_children_l1):
        done = {r.node: (r.level, r.tot, r.vap) for r in noise.top_down(nodes, adjust=adjust).collect()}
        assert len(done) == truth.count()
        parent = {r.node: r.parent for r in truth.collect()}
        for node, (_, tot, vap) in done.items():
            kids = [done[k] for k, p in parent.items() if p == node]
            assert not kids or (abs(sum(k[1] for k in kids) - tot) < 1e-5 and abs(sum(k[2] for k in kids) - vap) < 1e-5)
            assert -1e-6 <= vap <= tot + 1e-6
    assert noise.top_down(nodes, adjust=own).count() == truth.count()


def test_named_splits_use_the_whole_budget():
    assert {name: round(sum(s), 12) for name, s in noise.SPLITS.items()} == dict.fromkeys(noise.SPLITS, 1.0)
    assert all(len(s) == 5 for s in noise.SPLITS.values())
    assert noise.SPLITS["top"][0] > noise.SPLITS["mid"][0] == noise.SPLITS["bottom"][0]
