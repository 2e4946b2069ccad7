"""Proportional stratified interleaving into shards (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import distributed_rank, materialize, shuffle_key

#: Rank buckets inside a source, and of the fractional rank; with them a hot source is 1/RANK_BUCKETS a task.
RANK_BUCKETS_LOG2 = 10
FRACTION_BUCKETS = 4096


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows: id_col, size, text_crc32, source, fraction, position, shard, slot.

    Rows are shuffled by a seeded key within their source and ranked; (rank + 1/2) / rows of the source is the
    fractional rank.  All rows in the order of that fraction are cut into ``n_shards`` runs whose row counts are
    at most one apart, so each shard takes the same share of each source to within one row a cut.  ``slot``
    counts 0, 1, ... inside a shard.

    Null texts have no bytes (size 16, checksum 0); null sources are one source of their own.  Repeated rows each
    get a place; rows that agree in everything are interchangeable.  With fewer rows than shards some shards
    stay empty; an empty table gives no rows.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        shuffle_key(seed, F.col(id_col)).alias("key"),
    ).withColumn("part", F.shiftright("key", 60 - RANK_BUCKETS_LOG2).cast("int"))
    ranked = distributed_rank(rows, ["stratum"], "part", ["key", "id", "crc", "size"], "rank", "n")
    ranked = ranked.withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("n")))
    ranked = materialize(ranked.select("id", "source", "stratum", "size", "crc", "key", "fraction"), "fractions")
    ranked = ranked.withColumn("part", F.floor(F.col("fraction") * FRACTION_BUCKETS).cast("int")).withColumn("all", F.lit(0))
    placed = distributed_rank(ranked, ["all"], "part", ["fraction", "stratum", "key", "id", "crc", "size"], "position", "n")
    shard = F.expr(f"cast(position * {n_shards} div n as int)")
    return placed.withColumn("shard", shard).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "source",
        "fraction",
        "position",
        "shard",
        F.expr(f"position - (cast(shard as bigint) * n + {n_shards} - 1) div {n_shards}").alias("slot"),
    )
