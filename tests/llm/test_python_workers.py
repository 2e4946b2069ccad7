"""Steps that stand in one task run at once, each in a Python worker of its own: a stage has one."""

import corpus_pipeline as pipeline
import pytest
from test_text_ops import odd_texts

from blockweave.llm.bpe_codec import bpe_decode, bpe_encode, bpe_round_trip
from blockweave.llm.queries import QUERIES, tokenizer_path


def python_steps(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


@pytest.mark.parametrize("name", ["quality", "lines", "tokens"])
def test_stages_have_one_python_step(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*pipeline.COLUMNS)
    assert python_steps(dict(pipeline.STAGES)[name](spark, docs, sf)) == 1


@pytest.mark.parametrize("name", ["op5_bpe_codec", "op6_line_dedup"])
def test_queries_have_one_python_step(spark, sf, name):
    assert python_steps(QUERIES[name](spark, sf)) == 1


def test_round_trip_is_encode_then_decode(spark):
    path = tokenizer_path()
    docs = spark.createDataFrame([(t,) for t in [*odd_texts(), None]], "text string")
    for window in (1 << 16, 7):
        out = docs.select(bpe_encode("text", path, window).alias("ids"), bpe_decode(bpe_encode("text", path, window), path, window).alias("decoded"), bpe_round_trip("text", path, window).alias("coded"))
        rows = out.collect()
        assert len(rows) == docs.count()
        assert all((r.coded.ids, r.coded.decoded) == (r.ids, r.decoded) for r in rows)
    assert docs.limit(0).select(bpe_round_trip("text", path)).count() == 0
