"""Exact dedup by a log-structured merge index (built-in functions only).

Memtables flush sorted digest runs, each with a filter; compaction merges the runs and keeps the wanted
identifiers; a digest that occurs more than once is a hit, and hits are verified byte for byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lower_ascii, materialize

#: Bits of the hit filter; its bitmaps together take FILTER_BITS / 8 bytes, whatever the input.
FILTER_BITS = 1 << 23
_PAGE = 32768  # bits in one of Spark's bitmaps


def flush_runs(rows: DataFrame) -> DataFrame:
    """Each input split is a memtable: its (digest, id) rows leave as one sorted run with a Bloom filter on the digest."""
    bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": "65536"}
    return materialize(rows.select("digest", "id").sortWithinPartitions("digest", "id"), "runs", **bloom)


def compact(runs: DataFrame) -> DataFrame:
    """Merge all runs: one entry per digest with its smallest and largest identifier and its row count."""
    return materialize(runs.groupBy("digest").agg(F.min("id").alias("smallest"), F.max("id").alias("largest"), F.count(F.lit(1)).alias("group_size")), "index")


def _filter_place(digest):
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS))


def _collided(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Digests of hits whose texts are not all the same bytes.

    Only rows that pass the hit filter are compared.  Smallest and largest text of a digest are combined before
    the shuffle, so a group that holds a third of all rows is one row per split.
    """
    place = _filter_place(F.col("digest"))
    pages = (
        index.filter("group_size > 1")
        .select((place / _PAGE).cast("int").alias("page"), (place % _PAGE).alias("bit"))
        .groupBy("page")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    # at most FILTER_BITS / 8 = 1 MiB in all, so it can be broadcast at any input size
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hits = (
        rows.withColumn("_place", place)
        .withColumn("page", (F.col("_place") / _PAGE).cast("int"))
        .withColumn("_bit", F.col("_place") % _PAGE)
        .join(F.broadcast(pages), "page")
        .filter(F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(1) == 1)
    )
    return hits.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("z")).filter("a <> z").select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Rows: id_col, keep_id (the row of the group that stays), group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when they are the same bytes after lower-casing A-Z.  ``keep`` is 'smallest' or 'largest'.
    Null texts count as empty and form one group with the empty ones; whole texts are digested, however long.
    Rows that repeat an id carry the same answer (ids name documents).  An empty table gives no rows; other
    columns are ignored.  A null id never stays when its group has another id.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    norm = lower_ascii(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), F.unhex(F.sha2(norm, 256)).alias("digest"))
    runs = flush_runs(rows)
    index = compact(runs)
    bad = materialize(_collided(rows, index), "collided")
    out = runs.join(index.select("digest", F.col(keep).alias("keep_id"), "group_size"), "digest")
    if not bad.isEmpty():  # two texts with one SHA-256: these groups are formed by their bytes instead
        own = rows.join(bad, "digest", "left_semi")
        pick = (F.max if keep == "largest" else F.min)("id").alias("keep_id")
        exact = own.join(own.groupBy("norm").agg(pick, F.count(F.lit(1)).alias("group_size")), "norm").select("digest", "id", "keep_id", "group_size")
        out = out.join(bad, "digest", "left_anti").select("digest", "id", "keep_id", "group_size").unionByName(exact)
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
