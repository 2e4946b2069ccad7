"""Filter audit, whitening and license scans against plain Python and numpy."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm.filter_audit import failing_sets, filter_audit
from blockweave.llm.license_rules import RULES
from blockweave.llm.license_scan import TRUST, Detection, license_scan, load_rules, suppress
from blockweave.llm.queries import QUERIES
from blockweave.llm.whitening import embedding_whitening, tiled_products

MARKS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs, labels):
    """All orders, document by document; docs are (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = {}
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and least.get(text, i) < i,
        }
        parts.setdefault(lang or "", []).append((i, {f for f, hit in fails.items() if hit}))
    out = {}
    for part, members in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                stay = [(i, x) for i, x in members if not x & set(order[: step - 1])]
                here = [i for i, x in stay if f in x]
                total[f] += len(here)
                out[part, "".join(order), step] = [len(stay) - len(here), len(here), sum(f in x for _, x in members) - len(here), sum(x == {f} for _, x in members), sum(i in good for i in here), sum(i in toxic for i in here), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = total[row[6]]
    return out


def as_rows(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in MARKS] for r in df.collect()}


def test_audit_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert as_rows(QUERIES["op11_filter_audit"](spark, sf)) == audit(docs, labels)


def test_audit_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [(1, None, "a"), (2, "", None), (3, long, "a"), (4, long, "b"), (4, long, "b"), (None, long, ""), (None, long, "a"), (2, "AB %", "a"), (7, "x y " * 200, "b"), (8, " \t\n", "c"), (9, "É#" * 9000, "c"), (3, long + " ", "a"), (5, "a\x0bb\x0cc\rd", "a")]
    docs += [(20 + i, "same", "hot") for i in range(40)]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, None), (None, 1, 1), (4, 1, 1), (21, None, None), (22, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"digest": F.lit(1), "n": F.lit(2), "part": F.lit(3), "good": F.lit(4), "word": F.lit("x")}).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))
    assert as_rows(filter_audit(failing_sets(df, marks))) == audit(docs, labels)
    assert filter_audit(failing_sets(df.limit(0), marks)).count() == 0
    assert as_rows(filter_audit(failing_sets(df, marks.limit(0)))) == audit(docs, [])


def whiten(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors])
    n, s = len(x), [sum(int(a) for a in c) for c in x.T]
    z = x - np.array(s) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    return z, e[::-1], u[:, ::-1], [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]


def check_white(rows, ids, vectors, k):
    z, e, u, deviation = whiten(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(ids) * k
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        want = z @ u[:, c] / np.sqrt(e[c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert got[ids[0], c + 1].explained == pytest.approx(e[c] / e.sum(), rel=1e-9)
    assert [got[i, 1].deviation for i in ids] == deviation
    assert {r.n for r in rows} == {len(ids)} and {r.identity_error for r in rows} == {rows[0].identity_error}
    assert rows[0].identity_error < 1e-8


def test_whitening_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check_white(QUERIES["op12_whitening"](spark, sf).collect(), [r.vec_id for r in table], [r.embedding for r in table], 8)


def test_whitening_odd_rows(spark):
    rnd = np.random.default_rng(5)
    good = [(i, [float(x) for x in rnd.normal(size=70)]) for i in range(300)]
    bad = [(900, None), (901, []), (902, [1.0, None] * 35), (903, [float("nan")] * 70), (904, [float("inf")] * 70), (905, [1e300] * 70), (906, [1.0] * 69)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({"id": F.lit("a"), "x": F.lit(1), "v": F.lit(1), "component": F.lit(2)}).repartition(6)
    check_white(embedding_whitening(df).collect(), [i for i, _ in good], [v for _, v in good], 8)
    assert embedding_whitening(df.limit(0)).count() == 0
    assert embedding_whitening(df.filter("vec_id >= 900 and vec_id < 906")).count() == 0
    few = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [3.0, 0.0])], "vec_id long, embedding array<float>")
    rows = embedding_whitening(few).collect()
    assert len(rows) == 6 and {r.n for r in rows} == {3} and sum(r.vec_id is None for r in rows) == 2
    assert {r.component for r in rows if r.whitened is not None} == {1} and {r.explained for r in rows if r.component == 1} == {1.0}
    same = embedding_whitening(few.filter("vec_id = 1")).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in same} == {(None, None, None, 0)}
    huge = spark.createDataFrame([(1, [2.0**41]), (2, [-(2.0**41)]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in embedding_whitening(huge).orderBy("vec_id").collect()] == [None, None, 0]


def test_tiles(spark):
    x = np.random.default_rng(6).normal(size=(500, 37))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(7)
    for tile, rows in ((37, 500), (5, 16), (64, 3)):
        assert np.allclose(tiled_products(df, lambda z: z, 37, tile, rows), x.T @ x)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def scan(text):
    """All rules on the whole text without the keyword gate, suppression by comparing all pairs."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    base = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    plain = " " + " ".join(words) + " "
    found = []
    for number, r in enumerate(load_rules()):
        for m in re.finditer(r.pattern.pattern.decode(), plain, re.ASCII):
            found.append((plain[: m.start()].count(" ") - 1, plain[: m.end()].count(" ") - 1, r.priority, number))

    def inside(d, o):
        if d == o or not (o[0] <= d[0] and d[1] <= o[1]):
            return False
        return o[2] < d[2] or (o[2] == d[2] and (o[:2] != d[:2] or o[3] < d[3]))

    rules = load_rules()
    left = [d for d in found if rules[d[3]].base or not any(inside(d, o) for o in found)]
    trust = {}
    for d in left:
        trust[rules[d[3]].label] = max(trust.get(rules[d[3]].label, 0), TRUST[d[2]])
    starts = [i for i, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(trust)), pytest.approx(1 - math.prod(1 - t for t in trust.values())))


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_scan_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_license_scan"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == scan(docs[r.doc_id])


def test_scan_odd_rows(spark):
    texts = [None, "", " \n", "CC BY-SA 4.0, cc by cc by", "cc by", "ÀÉ cc-by é", "All Rights Reserved. ALL rights reserved", "Licensed under the Apache License, Version 2.0 (the License)", "GNU General Public License v3 or later; GNU Lesser General Public License 2.1", "general public", "x" * 300000 + " mit license", "mit license " * 3000 + "general public license", "cc0 public domain", "spdx-license-identifier: MIT", "the general public license of all rights reserved", "licence mit / todos los derechos reservados"]
    texts += [" ".join(np.random.default_rng(i).choice(["cc", "by", "nc", "4", "0", "gnu", "general", "public", "license", "version", "3", "apache", "2", "mit", "all", "rights", "reserved", "domain"], 60)) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("score", F.lit(7))
    rows = df.union(df.filter("doc_id = 3")).select("doc_id", license_scan("text", df).alias("s")).select("doc_id", "s.*").collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == scan(texts[r.doc_id])
    empty = df.limit(0)
    assert empty.select(license_scan("text", empty).alias("s")).count() == 0


def alternatives(pattern):
    depth, out = 0, [""]
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def test_rules_need_their_keywords():
    lines = RULES.strip().splitlines()
    assert len(lines) > 200
    for line in lines:
        _, priority, keyword, pattern = line.split(" | ", 3)
        assert int(priority) in TRUST
        for must in alternatives(pattern):
            before = None
            while before != must:  # what a match cannot do without
                before, must = must, re.sub(r"\((?:\?:)?[^()]*\)(?:\?|\{0,\d+\})", "", must)
            assert re.search(rf"(?<![a-z0-9]){keyword}(?![a-z0-9?])", must), line


def test_suppression():
    a, b, c = Detection("x", 1, 2, 0, 5), Detection("y", 2, 1, 1, 3), Detection("z", 3, 2, 1, 5)
    assert suppress([c, b, a]) == [a, b]
