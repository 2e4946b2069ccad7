"""Drop lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import lower_ascii, materialize, small_batches

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def _reassemble(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, drops in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, drop in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
            lines: list[str | None] = text.split("\n")
            for at in drop or ():
                lines[at] = None
            n_lines.append(len(lines))
            n_dropped.append(len(drop or ()))
            kept.append("\n".join(x for x in lines if x is not None))
        yield pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["text", "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with struct ``lines``: text (what is left), n_lines (before), n_dropped.

    A line's key is the line stripped of blanks at both ends, with A-Z lower-cased.  A key of at least
    ``min_chars`` code points that occurs in at least ``min_docs`` documents loses its lines everywhere; the other
    lines stay in their order, joined by newlines.  Keys are told apart by 128 bits of hash.

    A null or empty text is one empty line.  Rows that share an id are one document and count once, each row with a
    null id is a document of its own; repeated rows get the same result.  A text whose lines all go becomes
    empty.  An empty table gives no rows.  Columns of ``docs`` keep their names; one called ``lines`` is an error.
    """
    if "lines" in docs.columns:
        raise ValueError("a column is named lines already")
    small_batches(docs.sparkSession)
    text, id_ = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    # two 64-bit hashes name a row's id and text: rows that agree in both have the same result
    name = [F.xxhash64(id_, text).alias("_h1"), F.xxhash64(F.lit(7), text, id_).alias("_h2")]
    doc = F.when(id_.isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(id_))
    lines = docs.select(*name, id_.isNull().alias("_alone"), doc.alias("_doc"), text.alias("_text"))
    lines = lines.select("_h1", "_h2", "_alone", "_doc", F.posexplode(F.split("_text", "\n")).alias("_at", "_line")).withColumn("_key", line_key(F.col("_line")))
    lines = lines.filter(F.char_length("_key") >= min_chars).select("_h1", "_h2", "_alone", "_doc", "_at", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(7), "_key").alias("_k2"))
    lines = materialize(lines, "lines")
    shared = lines.select("_k1", "_k2", "_alone", "_doc").distinct().groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.filter(F.col("n") >= min_docs).select("_k1", "_k2"), "shared-lines")
    drops = lines.join(shared, ["_k1", "_k2"], "left_semi").groupBy("_h1", "_h2").agg(F.collect_set("_at").alias("_drop"))
    drops = materialize(drops, "drops")
    # called nondeterministic, it is not made again for a filter that the caller puts on its result
    rebuild = F.arrow_udf(_reassemble, "struct<text string, n_lines bigint, n_dropped bigint>", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    out = docs.select(F.struct(*docs.columns).alias("_row"), *name).join(drops, ["_h1", "_h2"], "left")
    return out.select("_row", rebuild(F.coalesce(F.col("_row")[text_col], F.lit("")), "_drop").alias("lines")).select("_row.*", "lines")
