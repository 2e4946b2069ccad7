"""Each stage of the pipeline against plain Python on the rows that the stage before left."""

import hashlib
import struct
from collections import defaultdict

import corpus_pipeline as pipeline
from test_joins import brute_join
from test_text_ops import drop_lines
from tokenizers import Tokenizer

from blockweave.llm.quality import score_texts
from blockweave.llm.queries import quality_model, tokenizer_path


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*pipeline.COLUMNS)
    model = quality_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.collect()
    margin, bias = model.margins(), float(model.bias[1] - model.bias[0])
    rows = [r for r in rows if score_texts(margin, bias, [r.text])[0] >= pipeline.REJECT_BELOW]
    left = {r.doc_id: r.text for r in rows}
    for k, (lines, n) in zip(list(left), drop_lines(list(left.items()), 10, 1), strict=True):
        text = "\n".join(lines)
        if len(lines) < n:
            left[k] = text
            if not text.strip(" \t\n\x0b\x0c\r"):
                del left[k]
    for d, _, c in brute_join(list(left.items()), 5, 80):
        if d != c:
            del left[d]
    tok = Tokenizer.from_file(tokenizer_path())
    want = {}
    for d, text in left.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), True)
    out = pipeline.run(spark, sf).collect()
    assert len(out) == len(want)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.round_trip) for r in out} == want


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(40), sf)
        assert [c for c, _ in out.dtypes] == docs.columns, name
        assert stage(spark, empty, sf).count() == 0


def test_stages_with_odd_rows(spark, sf):
    """Nulls everywhere, empty and long texts, repeated rows, columns whose names the operators use."""
    rows = [(1, "some words that stand here", "en", "a", 26), (1, "some words that stand here", "en", "a", 26), (None, None, None, None, None), (2, "", None, "", 0), (3, "long words " * 20_000, "en", "a", None), (None, "\t\n", "en", None, 2)]
    docs = spark.createDataFrame([(*r, 7, "x", 0.5, "y", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lines int, mix string, score double, _row string, ids int")
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, sf).collect()
        if name in ("lines", "mixture"):
            assert sorted(map(repr, got)) == sorted(repr(r) for r in docs.select(*pipeline.COLUMNS).collect()), name
        elif name == "near_duplicates":
            assert len(got) == 5
        elif name == "tokens":
            assert len(got) == 6 and all(r.round_trip for r in got)
        else:
            assert set(map(repr, got)) <= {repr(r) for r in docs.select(*pipeline.COLUMNS).collect()}


def test_mixture_keeps_every_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    count = defaultdict(int)
    for r in pipeline.mixture(spark, docs, sf).collect():
        count[r.doc_id] += 1
    assert count == {r.doc_id: 1 for r in docs.collect()}
