"""Embedding dedup and the n-gram join against all pairs."""

import re

import numpy as np
import pytest

from blockweave.llm.embed_dedup import embedding_dedup, unit
from blockweave.llm.ngram_join import ngram_join
from blockweave.llm.queries import QUERIES


def classes(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute_vectors(rows, threshold):
    sound = [i for i, (v, e, y) in enumerate(rows) if v is not None and e and y is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = []
    for k, i in enumerate(sound):
        for j in sound[:k]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = unit(np.array([rows[i][1], rows[j][1]], np.float32))
                if a @ b >= threshold:
                    links.append((i, j))
    root = classes(len(rows), links)
    least = {}
    for i in sound:
        least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows)) if links else np.zeros(len(rows), int)
    out = []
    for i, r in enumerate(rows):
        c = least[root[i]] if i in sound else r[0]
        out.append((r[0], int(n[i]), c, r[0] is not None and c == r[0]))
    return sorted(out, key=repr)


def vectors(seed, n, dim=8):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = base[rnd.integers(12)] + rnd.normal(size=dim) * rnd.choice([0.0, 0.02, 0.08, 0.5])
        rows.append((i, v.astype(np.float32).tolist(), int(rnd.integers(3))))
    return rows


def test_embedding_dedup(spark, monkeypatch):
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [1.0, None] * 4, 1), (905, [float("inf")] * 8, 1), (906, [1.0] * 8, None), (None, [1.0] * 8, 1), (907, [1.0] * 3, 1), (908, [2.0] * 3, 1), (909, [1e-30] * 8, 2), (910, [1e30] * 8, 2), (5, [1e30] * 8, 2)]
    rows = vectors(1, 300) + odd
    df = spark.createDataFrame([(*r, 0, "") for r in rows], "vec_id long, embedding array<float>, label int, node int, path string")
    import blockweave.llm.embed_dedup as module

    for leaf in (1024, 16):
        monkeypatch.setattr(module, "LEAF", leaf)
        got = embedding_dedup(df, threshold=0.98).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == brute_vectors(rows, 0.98)
    assert embedding_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        embedding_dedup(df, threshold=0.1)


def test_large_ids_that_repeat(spark):
    big = (1 << 62) + 5
    rows = [(big, [1.0, 0.0], 1), (big, [0.0, 1.0], 1), (big, [1.0, 0.0], 1), (-big, [1.0, 0.01], 1), (big + 1, [0.01, 1.0], 1), (-big, [1.0, 1.0], 1)]
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), threshold=0.98).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == brute_vectors(rows, 0.98)


def test_embedding_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op2_embedding_dedup"](spark, sf).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == brute_vectors(rows, 0.98)


def shingle_set(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def brute_join(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if rows[i][0] == rows[j][0] or 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    links.append((i, j))
    root = classes(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted(((r[0], len(sets[i]), None if r[0] is None else least[root[i]]) for i, r in enumerate(rows)), key=repr)


def texts(seed, n):
    rnd = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "x y"]
    base = [[words[i] for i in rnd.integers(len(words), size=size)] for size in (1, 2, 3, 10, 40, 40, 90, 300)]
    rows = []
    for i in range(n):
        own = list(base[rnd.integers(len(base))])
        for _ in range(rnd.integers(6)):
            own[rnd.integers(len(own))] = words[rnd.integers(len(words))]
        rows.append((i, " ".join(w.upper() if rnd.random() < 0.1 and w.isascii() else w for w in own)))
    return rows


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    rows = texts(n, 160) + [(900, None), (901, ""), (902, " \n\t"), (None, "w1 w2 w3"), (903, "same same same same same"), (904, "same\x0bsame same same"), (905, "long " * 30_000), (906, "long " * 20_000)]
    rows += [rows[3], rows[3], (3, rows[9][1]), (3, "a text of its own"), (910, "a text of its own"), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], "doc_id long, text string, sig int, size string")
    got = ngram_join(df, n_words=n, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_join(rows, n, percent)
    assert ngram_join(df.limit(0), n_words=n, percent=percent).count() == 0


def near_group(seed, n, size, edits):
    """A chain of near copies: each changes some words of the first text, of an earlier copy, or drops or adds a run."""
    rnd = np.random.default_rng(seed)
    first = [f"b{i}" for i in range(size)]
    rows = [first]
    for i in range(n - 1):
        own = list(first if rnd.random() < 0.6 else rows[rnd.integers(len(rows))])
        for _ in range(rnd.integers(edits) + 1):
            own[rnd.integers(len(own))] = f"n{i}x{rnd.integers(4)}"
        if rnd.random() < 0.3:
            at = rnd.integers(size // 2)
            own[at : at + 5] = [] if rnd.random() < 0.5 else ["one", "line", "that", "many", "share", "here"]
        rows.append(own)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("n,percent,size,edits,paired,by_place", [(5, 80, 60, 3, 2, 1024), (5, 80, 146, 6, 2, 1024), (3, 90, 40, 2, 16, 16), (3, 90, 150, 4, 2, 2), (5, 80, 100, 5, 2, 2)])
def test_near_copies_that_the_pivot_does_not_link(spark, monkeypatch, n, percent, size, edits, paired, by_place):
    import blockweave.llm.ngram_join as module

    monkeypatch.setattr(module, "PAIRED", paired)
    monkeypatch.setattr(module, "PAIRED_BY_PLACE", by_place)
    rows = near_group(size, 140, size, edits)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n_words=n, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_join(rows, n, percent)


def test_ngram_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op7_ngram_join"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_join(rows, 3, 90)


def test_words_over_a_kilobyte_stay_apart(spark):
    """A word of 1,024 letters by the parity of its places' bits, and its complement: sums of powers modulo 2^64 agree on them."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    long = "z" * 3_000_000
    rows = [(1, word), (2, other), (3, word), (4, f"x {word} y"), (5, f"x {other} y"), (6, long), (7, long), (8, long[:-1] + "y"), (9, "abcdefgh"), (10, "abcdefghi"), (11, "abcdefgh\0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join(df, n_words=3, percent=90).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 11}


def test_embeddings_of_any_size(spark):
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(12, 16))
    vectors = np.repeat(base, 200, axis=0) + rnd.normal(size=(2400, 16)) * 0.15
    want = None
    for scale in (1.0, 1e200, 1e-200):
        df = spark.createDataFrame([(i, (v * scale).tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df, threshold=0.98).collect()}
        want = want or got
        assert got == want
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert [want[i][0] for i in range(len(units))] == ((units @ units.T >= 0.98).sum(axis=1) - 1).tolist()
