"""What the driver builds for a join does not follow the compressed bytes of a table."""

import corpus_pipeline
import pytest
from blockweave.llm import _shared, ngram_join
from pyspark.sql import functions as F

THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture
def docs(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("w"), (i * i + F.floor(F.col("doc_id") / 3) * 7).cast("string"))))
    return spark.range(30).select(F.col("id").alias("doc_id")).withColumn("text", text).select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"))


def test_ngram_join_broadcasts_only_what_it_names(spark, docs, monkeypatch):
    seen, write = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, *a, **b: seen.append({spark.conf.get(t, None) for t in THRESHOLDS}) or write(df, *a, **b))
    before = [spark.conf.get(t, None) for t in THRESHOLDS]
    out = ngram_join.ngram_join(docs)
    assert len(seen) > 10 and all(x == {"-1"} for x in seen)
    assert [spark.conf.get(t, None) for t in THRESHOLDS] == before
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(i, i - i % 3) for i in range(30)}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [0, 100_000])
def test_near_duplicates_broadcasts_few_rows_at_most(spark, docs, monkeypatch, rows):
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", rows)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 30, 3))
    assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == (rows > 0)
