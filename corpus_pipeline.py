"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm._shared import counted_broadcast, materialize
from blockweave.llm.bpe_codec import bpe_round_trip
from blockweave.llm.line_dedup import BLANK, line_dedup
from blockweave.llm.mixing import mix_sources
from blockweave.llm.ngram_join import ngram_join
from blockweave.llm.quality import quality_score
from blockweave.llm.queries import quality_model, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT_BELOW = 0.3
PART_SLOTS = 1000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of REJECT_BELOW or more stay (all have 0.5 where no label was learned from); null and empty texts have a score too."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("score", quality_score("text", model, docs)).filter(F.col("score") >= REJECT_BELOW).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; a document that loses some and has only white space left goes with them.

    A document that loses nothing keeps its text as it was (null too).
    """
    out = line_dedup(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    hit = F.col("lines.n_dropped") > 0
    kept = out.filter(~hit | (F.btrim("lines.text", F.lit(BLANK)) != ""))
    return kept.select("doc_id", F.when(hit, F.col("lines.text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(hit, F.char_length("lines.text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with a five-word shingle similarity of 0.8 or more, the smallest id stays.

    Every row is a document of its own, also with a null id (such rows count as the largest ids) or one that occurs
    again: of these the least hash of the row stays.  Where there are any, the rows are numbered in that order.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id is null or n > 1")
    if odd.isEmpty():
        rows = docs.withColumn("_row", F.col("doc_id"))
    else:
        order = [F.col("doc_id").asc_nulls_last(), F.col("_hash"), F.col("_at")]
        rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_hash"), F.monotonically_increasing_id().alias("_at"))
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
        rows = materialize(rows.select(*COLUMNS, "_row"), "numbered")
    classes = ngram_join(rows.select("_row", "text"), n_words=5, percent=80, id_col="_row")
    gone = materialize(classes.filter("component_id is not null and _row <> component_id").select("_row").distinct(), "gone")
    return rows.join(counted_broadcast(gone), "_row", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the schedule mixes their sources: files and their rows follow it.

    Every row has a place of its own, whether its id or source is null or occurs again.
    """
    place = F.concat_ws("|", F.col("doc_id").cast("string"), F.xxhash64(*COLUMNS).cast("string"))
    order = mix_sources(docs.select(*COLUMNS, place.alias("_place")), id_col="_place")
    placed = order.select(*COLUMNS, "mix.slot", "mix.block_row")
    return placed.repartitionByRange("slot", "block_row").sortWithinPartitions("slot", "block_row").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's packed token ids, their number, and whether decoding gives the text again."""
    out = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("coded", bpe_round_trip("text", tokenizer_path())).select("*", "coded.ids", "coded.decoded")
    return out.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: A learned score, classes of a similarity join and a tokenizer are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
