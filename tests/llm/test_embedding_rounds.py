"""Blocks that all meet each other are sent in rounds, each of about as much as there is."""

import blockweave.llm.embed_dedup as module
import numpy as np
from pyspark.sql import functions as F


def test_every_two_blocks_meet_once_and_a_round_stays_small(spark, monkeypatch):
    monkeypatch.setattr(module, "ROUND_NUMBERS", 0)
    largest = {}
    for n in (20, 60):
        blocks = spark.range(n).select(F.lit(7).cast("long").alias("node"), F.col("id").cast("int").alias("k"), F.array(F.struct(F.col("id").alias("pid"), F.lit(1).alias("m"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))).alias("x"))
        sent, rounds, _ = module._rounds(spark.createDataFrame([(7, 7)], "a long, b long"), blocks)
        rows = sent.collect()
        assert sorted(tuple(sorted((r.ka, r.kb))) for r in rows if not r.own) == [(i, j) for i in range(n) for j in range(i + 1, n)]
        heads = {r.ka: (r["round"], r.alone) for r in rows if r.own}
        assert sorted(heads) == list(range(n)) and all(alone for _, alone in heads.values())
        assert all(heads[r.ka][0] == r["round"] for r in rows) and {r["round"] for r in rows} <= set(range(rounds))
        assert rounds >= n / 4
        largest[n] = np.bincount([r["round"] for r in rows]).max() / n
    assert largest[60] < 6  # all pairs are 30 times as many blocks as there are


def test_links_of_all_rounds(spark, monkeypatch):
    for name, value in (("ROUND_NUMBERS", 0), ("LEAF", 64), ("TILE", 16)):
        monkeypatch.setattr(module, name, value)
    seen, rounds = [], module._rounds
    monkeypatch.setattr(module, "_rounds", lambda *a: seen.append(rounds(*a)) or seen[-1])
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(600, 16))
    vectors[300:] = vectors[:300] + rnd.normal(size=(300, 16)) * rnd.choice([0.02, 0.3], size=(300, 1))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in module.embedding_dedup(df).collect()}
    units = module.unit(vectors)
    assert [got[i] for i in range(600)] == ((units @ units.T >= 0.98).sum(axis=1) - 1).tolist() and sum(got.values()) > 100
    assert seen[0][1] > 2
