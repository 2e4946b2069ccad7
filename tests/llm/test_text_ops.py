"""Token counts, BPE codec, line dedup and the quality classifier against the library or plain Python."""

import hashlib
import random
import struct
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockweave.llm.bpe_codec import bpe_decode, bpe_encode, decode_stream, encode_stream, load_bpe
from blockweave.llm.line_dedup import line_dedup
from blockweave.llm.quality import document_features, quality_score, score_texts, train_quality
from blockweave.llm.queries import QUERIES, tokenizer_path
from blockweave.llm.token_count import count_texts, load_tokenizer, token_count


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def odd_texts():
    rnd = random.Random(4)
    soup = "ab  \n\té’'s'LL 12３٣ <|endoftext|> !!…—  \x1c\x85日本語😀é؀"
    texts = ["", " ", "\n", "a", "<|endoftext|>", "x<|endoftext|>  y", "a" * 5000, " " * 5000 + "x", "\n" * 3001, "!?" * 3000, "1" * 4000, "é" * 3000, "it's we'll I'M", "a\r\n b"]
    return texts + ["".join(rnd.choice(soup) for _ in range(rnd.randrange(1, 400))) for _ in range(150)] + ["word " * 3000 + "a" * 9000 + " tail" * 900]


def test_token_counts(library):
    texts = [*odd_texts(), None]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    tok = load_tokenizer(tokenizer_path())
    for chunk, overlap in ((1 << 16, 256), (64, 8), (500, 20)):
        assert count_texts(tok, texts, chunk, overlap) == want


def test_codec(library):
    bpe = load_bpe(tokenizer_path())
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        want = struct.pack(f"<{len(ids)}I", *ids)
        back = library.decode(ids, skip_special_tokens=False)
        for window in (1 << 16, 7, 100):
            assert b"".join(encode_stream(bpe, text, window)) == want
            assert "".join(decode_stream(bpe, (want[i : i + 4 * window] for i in range(0, len(want), 4 * window)))) == back


def test_token_queries(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs.items()}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op3_token_count"](spark, sf).collect()}
    assert counts == {d: (len(t.encode()), len(ids[d]), len(ids[d]) > 1024) for d, t in docs.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op5_bpe_codec"](spark, sf).collect()}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    assert got == {d: (len(x), sha(struct.pack(f"<{len(x)}I", *x)), sha(library.decode(x, skip_special_tokens=False).encode())) for d, x in ids.items()}


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def drop_lines(rows, min_docs, min_chars):
    """A document is an id; rows without one are documents of their own."""
    found = defaultdict(set)
    for k, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            found[line_key(line)].add((i is None, k if i is None else i))
    gone = {k for k, v in found.items() if len(v) >= min_docs and len(k) >= min_chars}
    return [([x for x in (t or "").split("\n") if line_key(x) not in gone], len((t or "").split("\n"))) for _, t in rows]


def test_line_dedup(spark):
    texts = [None, "", " ", "A\nb", "a \nB\nc", "\ta\n\nd", "é\nÉ", "a\x0b", "x\n" * 3000 + "a", "b", "b", "\n\n"]
    rows = [(i, t, "r", 0) for i, t in enumerate(texts)] + [(None, "q\na", "r", 0), (None, "q\na", "s", 0), (3, "q\nb", "r", 1), *[(77, "only here", "r", k) for k in range(12)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, lines_ int")
    for min_docs, min_chars in ((2, 1), (3, 0), (1, 1), (4, 1)):
        got = line_dedup(df, min_docs=min_docs, min_chars=min_chars)
        assert got.columns == [*df.columns, "lines"]
        want = drop_lines([r[:2] for r in rows], min_docs, min_chars)
        want = sorted(((str(r[0]), str(r[1]), "\n".join(k), n, n - len(k)) for r, (k, n) in zip(rows, want, strict=True)))
        assert sorted((str(r.doc_id), str(r.text), r.lines.text, r.lines.n_lines, r.lines.n_dropped) for r in got.collect()) == want
    assert line_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup(df.withColumn("lines", F.lit(1)))


def test_quality_learns(spark):
    """Held-out ranking on the labelled rows of a larger table."""
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op4_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and label.get(r.doc_id) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert good and bad
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9


def test_score_is_softmax_of_the_average(spark):
    docs = spark.createDataFrame([(i, f"good plain words {i} here" if i % 2 else f"%%%% $$$$ {i}") for i in range(20)], "doc_id long, text string")
    model = train_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))
    texts = ["good plain words", "%%%% 77", "", None, "a", "é" * 50, "words " * 200_000]
    want = []
    for t in texts:
        at, count = document_features(t)
        z = (count / count.sum()) @ model.vectors[at].astype(float) @ model.output + model.bias
        want.append(np.exp(z[1]) / np.exp(z).sum())
    assert np.allclose(score_texts(model.margins(), float(model.bias[1] - model.bias[0]), texts), want, atol=1e-4)


def test_quality_without_labels(spark, sf, tmp_path):
    """No label to learn from (none at all, or all held out): every text scores 0.5."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    assert {(r.score, r.predicted) for r in QUERIES["op4_quality"](spark, str(tmp_path)).collect()} == {(0.5, 1)}


def test_tokens_of_odd_rows(spark, library):
    rows = [(1, "a b", 5), (1, "a b", 5), (None, None, 6), (2, "", 7), (3, "long word " * 60_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    path = tokenizer_path()
    out = docs.select("*", token_count("text", path).alias("n"), bpe_encode("text", path).alias("packed")).withColumn("back", bpe_decode("packed", path))
    got = sorted((str(r.doc_id), r.text or "", r.n, len(r.packed) // 4, r.back) for r in out.collect())
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert got == sorted((str(i), t or "", size(t or ""), size(t or ""), t or "") for i, t, _ in rows)
    empty = docs.limit(0)
    assert empty.select(token_count("text", path)).count() == empty.select(bpe_decode(bpe_encode("text", path), path)).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    import json

    import public_tokenizers

    with pytest.raises(ValueError):
        load_bpe(public_tokenizers.path("word_bpe_49k.json"))
    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "prefix.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    for load in (load_tokenizer, load_bpe):
        with pytest.raises(ValueError):
            load(str(other))


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good plain words here"), (2, "%%%% $$$$ 0000"), (3, None), (None, "x"), (5, "z " * 400_000), (1, "good plain words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0), (99, 1, 0)], "doc_id long, quality int, text int")
    model = train_quality(docs, labels)
    rows = docs.withColumn("score", quality_score("text", model, docs)).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 6
    again = train_quality(docs.repartition(3), labels.repartition(2))
    assert all((a == b).all() for a, b in zip(model, again, strict=True))  # whatever order rows come in
    assert train_quality(docs, labels.limit(0)) is None
    assert docs.limit(0).withColumn("score", quality_score("text", model, docs)).count() == 0
