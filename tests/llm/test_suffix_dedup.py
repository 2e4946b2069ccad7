import random

import pytest
from pyspark.sql import functions as F

from blockweave.llm import suffix_dedup as module
from blockweave.llm.queries import QUERIES
from blockweave.llm.suffix_dedup import suffix_dedup


def brute(rows, match):
    """(n_bytes, n_removed, n_spans, kept) of each (id, text) row."""
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - match + 1 if i is not None else 0):
            s = raw[p : p + match]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - match + 1 if i is not None else 0):
            if first[raw[p : p + match]] < i:
                gone[p : p + match] = b"\1" * match
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup(df, **options).select("doc_id", "cut.*").collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr)


def corpus(seed, alphabet, n):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([5, 20, 70, 200]))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(8))]
        rows.append((rnd.randrange(-3, 3 * n), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,alphabet,match,gap", [(1, "abcdefgh ", 50, 24), (2, "ab", 12, 6), (3, "é x", 9, 9), (4, "a", 50, 24), (5, "abc", 10, 1)])
def test_brute_force(spark, seed, alphabet, match, gap):
    rows = corpus(seed, alphabet, 60) + [(None, None), (None, "ab" * 60), (7000, None), (7001, ""), (1, "ab" * 60), (1, "ab" * 60)]
    assert run(spark, rows, match=match, gap=gap) == brute(rows, match)


def test_small_runs_and_chunks(spark, monkeypatch):
    rows = corpus(9, "abcd", 80)
    for limit in (50, 1000):
        runs = module._run

        def settled(parts, *rest):
            return list(runs(parts, *rest))

        t = []
        ids, texts = zip(*[(i, t.encode()) for i, t in rows], strict=True)
        monkeypatch.setattr(module, "RUN_TUPLES", limit)
        monkeypatch.setattr(module, "STEP", 64)
        module._powers.cache_clear()
        import pyarrow as pa

        batch = pa.record_batch({"id": pa.array(ids, pa.int64()), "text": pa.array([x.decode() for x in texts])})
        parts = list(module._sample(20, 8, 3, 1)(iter([batch.slice(0, 30), batch.slice(30)])))
        parts = [module._unpack(n, p) for b in parts for n, p in zip(b["n"].to_pylist(), b["pack"].to_pylist(), strict=True)]
        first = module.settle(module._join(parts), 1, False, True)
        asked = {}
        for d, s, n, state in zip(*(first[k].tolist() for k in ("doc", "start", "length", "state")), strict=True):
            if state == module.INDUCE:
                asked.setdefault(d, []).append({"start": s, "length": n})
        wanted = [(i, x.decode(), asked[i]) for i, x in zip(ids, texts, strict=True) if i in asked]
        spans = module._take(first, first["state"] == module.DECIDED)
        if wanted:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            batch = pa.record_batch({"id": pa.array([w[0] for w in wanted], pa.int64()), "text": pa.array([w[1] for w in wanted]), "asked": pa.array([w[2] for w in wanted], kind)})
            parts = list(module._induce(20, 3, 1)(iter([batch])))
            parts = [module._unpack(n, p) for b in parts for n, p in zip(b["n"].to_pylist(), b["pack"].to_pylist(), strict=True)]
            second = module.settle(module._join(parts), 1, True, True)
            spans = module._join([spans, module._take(second, second["state"] == module.DECIDED)])
        gone = {i: bytearray(len(x)) for i, x in zip(ids, texts, strict=True)}
        if len(gone) == len(ids):
            for d, s, n in zip(*(spans[k].tolist() for k in ("doc", "start", "length")), strict=True):
                gone[d][s : s + n + 19] = b"\1" * (n + 19)
            want = {i: r for i, _, r, _, _ in brute(rows, 20)}
            assert {i: sum(g) for i, g in gone.items()} == want
    module._powers.cache_clear()


def test_large_ids_that_repeat(spark):
    big = (1 << 62) + 5
    rows = [(big, "ab" * 40), (big, "other text " * 9), (big, "ab" * 40), (-big, "ab" * 30), (big + 1, "other text " * 9), (-big, "cd" * 40)]
    assert run(spark, rows, match=12, gap=6) == brute(rows, 12)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, id int, row string, spans string, c int")
    assert suffix_dedup(df).count() == 0
    df = spark.createDataFrame([(2, "x" * 80, 1, "r", "s", 3), (1, "x" * 60, 1, "r", "s", 3)], df.schema)
    got = suffix_dedup(df)
    assert got.columns == [*df.columns, "cut"]
    assert {r.doc_id: r.cut.n_removed for r in got.collect()} == {1: 0, 2: 80}
    with pytest.raises(ValueError):
        suffix_dedup(df.withColumn("cut", F.lit(1)))


def test_query(spark, sf):
    import hashlib

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_suffix_dedup"](spark, sf).collect())
    assert got == sorted((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(rows, 50))


def test_strings_that_share_sums_of_powers_are_different(spark):
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    rows = [(1, word[:1024]), (2, word[1024:]), (3, "x" + word[1024:] + "y")]
    assert run(spark, rows, match=1024, gap=1) == brute(rows, 1024)
