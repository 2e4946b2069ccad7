"""Sharding, mixing and exact dedup against plain Python."""

import hashlib
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from blockweave.llm.exact_dedup import exact_dedup
from blockweave.llm.mixing import mix_sources
from blockweave.llm.queries import QUERIES
from blockweave.llm.sharding import shard_documents

KIND = "doc_id long, text string, source string, n int, rank string, stratum int, key string"
ODD = [(1, None, "a", 0, "r", 1, "k"), (2, "", None, 0, "r", 1, "k"), (None, "x", "a", None, None, None, None), (3, "Zé\n" * 5000, "b", 0, "r", 1, "k"), (3, "Zé\n" * 5000, "b", 0, "r", 1, "k"), (4, "X", "a", 0, "r", 1, "k")]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def check_shards(rows, n_shards):
    per = Counter(r.shard for r in rows)
    sizes = [per.get(s, 0) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    total = Counter(r.source for r in rows)
    for s in per:  # each shard has its share of each source to within one row a cut
        own = Counter(r.source for r in rows if r.shard == s)
        for source, n in total.items():
            assert abs(own[source] - n * per[s] / len(rows)) <= 2 + len(total)


def test_sharding_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_sharding"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    check_shards(rows, 40)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, crc32(raw), "rows", None)


def test_sharding_odd_rows(spark):
    df = spark.createDataFrame(ODD, KIND)
    rows = shard_documents(df, n_shards=4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(x[0] for x in ODD)
    check_shards(rows, 4)
    assert shard_documents(df.limit(0), n_shards=4).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("source"))
    rows = shard_documents(many, n_shards=16).collect()
    check_shards(rows, 16)
    assert [(r.doc_id, r.shard, r.slot) for r in sorted(rows, key=lambda r: r.doc_id)] == [(r.doc_id, r.shard, r.slot) for r in sorted(shard_documents(many.repartition(5), n_shards=16).collect(), key=lambda r: r.doc_id)]


def test_mixing_deviation(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'hot' when id % 11 = 1 then null else cast(id % 5 as string) end").alias("source"))
    weights = {"hot": 0.2, None: 0.3, "1": 0.25, "2": 0.25}
    rows = mix_sources(df, weights=weights, resolution=20, block_rows=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(4000))
    slots = defaultdict(set)
    for r in rows:
        slots[r.mix.slot].add((r.source, r.mix.block))
        assert r.mix.release <= r.mix.slot < r.mix.deadline
    assert all(len(x) == 1 for x in slots.values())  # a slot runs one block
    blocks = defaultdict(dict)
    for r in rows:
        blocks[r.source][r.mix.block] = (r.mix.slot, r.mix.release, r.mix.deadline)
    parts = {s: max(1, round(weights.get(s, 0) * 20)) for s in blocks}
    period = sum(parts.values())
    for s, own in blocks.items():
        last = max(x[0] for x in own.values())
        for t in range(last + 1):
            run = sum(1 for x in own.values() if x[0] <= t)
            assert abs(run - (t + 1) * parts[s] / period) < 1


def test_mixing_odd_rows(spark, sf):
    df = spark.createDataFrame(ODD, KIND)
    got = mix_sources(df)
    assert got.columns == [*df.columns, "mix"] and Counter(r.doc_id for r in got.collect()) == Counter(x[0] for x in ODD)
    assert mix_sources(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mix_sources(df.withColumnRenamed("n", "mix"))
    rows = QUERIES["op9_mixing"](spark, sf).collect()
    assert len({(r.slot, r.block_row) for r in rows}) == len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, keep):
    rows = [*ODD, (9, "x", None, 1, "", 1, ""), (10, "É", None, 1, "", 1, ""), (11, "é", None, 1, "", 1, "")]
    got = exact_dedup(spark.createDataFrame(rows, KIND), keep=keep).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    pick = max if keep == "largest" else min
    want = Counter()
    for text, ids in groups.items():
        best = pick(i for i in ids if i is not None)
        want.update((i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup(spark.createDataFrame([], KIND)).count() == 0


def test_exact_dedup_verifies_bytes(spark, monkeypatch):
    """With a digest that always collides, groups are still formed by the bytes."""
    from blockweave.llm import exact_dedup as module

    monkeypatch.setattr(module.F, "sha2", lambda c, n: F.when(c.isNotNull(), F.lit("00" * 32)))
    got = exact_dedup(spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string"), keep="largest").collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}
