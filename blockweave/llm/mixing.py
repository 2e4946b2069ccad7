"""Mixing sources to target weights by Pfair scheduling (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import distributed_rank, materialize, shuffle_key

RANK_BUCKETS_LOG2 = 10
#: The schedule of one period is broadcast up to this many slots and joined by a shuffle beyond.
BROADCAST_SLOTS = 20_000


def edf_period(parts: DataFrame) -> DataFrame:
    """One period of the schedule: (stratum, parts, period, nth, slot) from ``parts`` (stratum, parts).

    A source with a of the D parts of a period has its i-th block released at floor(i D / a) and due at
    ceil((i + 1) D / a).  In each of the D slots the released block that is due first runs (ties: the smaller
    stratum).  All of a period's blocks end in it, so later periods repeat it.  The table has D rows.
    """
    listed = parts.agg(F.array_sort(F.collect_list(F.struct("stratum", "parts"))).alias("s"))
    listed = listed.select(F.transform("s", lambda x: x.stratum).alias("names"), F.transform("s", lambda x: x.parts.cast("int")).alias("a"))
    listed = listed.filter(F.size("a") > 0).withColumn("d", F.aggregate("a", F.lit(0), lambda x, y: x + y))
    picks = listed.withColumn(
        "picks",
        F.expr("""
        if(d > 0, aggregate(
          sequence(0, d - 1),
          named_struct('c', array_repeat(0, size(a)), 'out', cast(array() as array<int>)),
          (acc, t) -> transform(
            array(array_min(filter(
              transform(sequence(0, size(a) - 1), i -> named_struct(
                'due', ((acc.c[i] + 1) * cast(d as bigint) + a[i] - 1) div a[i],
                'i', i,
                'release', acc.c[i] * cast(d as bigint) div a[i])),
              x -> x.release <= t)).i),
            p -> named_struct('c', transform(acc.c, (v, i) -> if(i = p, v + 1, v)), 'out', concat(acc.out, array(p)))
          )[0],
          acc -> acc.out), cast(array() as array<int>))"""),
    )
    rows = picks.select("names", "a", "d", F.posexplode("picks").alias("slot", "i"))
    rows = rows.select(F.col("names")[F.col("i")].alias("stratum"), F.col("a")[F.col("i")].alias("parts"), F.col("d").alias("period"), "slot")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("stratum").orderBy("slot")) - 1)


def target_parts(counts: DataFrame, weights: dict[str | None, float] | None, temperature: float, resolution: int) -> DataFrame:
    """(stratum, parts): integer shares of a period.  Every source gets one part at least, so none is left out."""
    weight: Column = F.pow(F.col("n").cast("double"), F.lit(temperature))
    if weights is not None:
        named = [x for k, v in weights.items() for x in (F.lit("" if k is None else f"={k}"), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*named)[F.col("stratum")], F.lit(0.0)) if named else F.lit(0.0)
    share = F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("w", weight).select("stratum", F.greatest(F.lit(1), F.coalesce(F.round(share * resolution), F.lit(1))).cast("int").alias("parts"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    resolution: int = 1000,
    block_rows: int = 16,
    seed: int = 23,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with struct ``mix``: source, rank, block, block_row, release, deadline, slot (the place in the mixture).

    Each source is shuffled by a seeded key and cut into blocks of ``block_rows`` rows.  Block j of a source with
    share w runs in [release, deadline) = [floor(j / w), ceil((j + 1) / w)), earliest deadline first, so up to any
    slot each source is within one block of its weight while its blocks last.  The mixture is the order of
    (slot, block_row).  Nothing is dropped or repeated: a source that ends early leaves its later slots empty.

    Weights are given by source (others count 0) or taken as rows ** ``temperature``; they are rounded to whole parts
    of a period of about ``resolution`` slots, one part at least.  Null sources are one source of their own.
    Repeated rows each get a place.  Columns of ``docs`` keep their names; one called ``mix`` is an error.
    An empty table gives no rows.
    """
    if "mix" in docs.columns:
        raise ValueError("a column is named mix already")
    stratum = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    narrow = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), stratum.alias("stratum"), shuffle_key(seed, F.col(id_col)).alias("key"))
    narrow = narrow.withColumn("part", F.shiftright("key", 60 - RANK_BUCKETS_LOG2).cast("int"))
    period = edf_period(target_parts(docs.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n")), weights, temperature, resolution))
    period = materialize(period, "period")
    if period.count() <= BROADCAST_SLOTS:
        period = F.broadcast(period)
    ranked = distributed_rank(narrow, ["stratum"], "part", ["key", "id"], "rank", "_total")
    shares = period.filter("nth = 0").select("stratum", "parts", "period")
    block = F.expr(f"rank div {block_rows}")
    at = ranked.withColumn("block", block).join(shares, "stratum").withColumn("nth", (F.col("block") % F.col("parts")).cast("int"))
    at = at.join(period.select("stratum", "nth", F.col("slot").alias("_slot")), ["stratum", "nth"])
    mix = F.struct(
        F.col(f"row.{source_col}").alias("source"),
        "rank",
        "block",
        (F.col("rank") % block_rows).cast("int").alias("block_row"),
        F.expr("block * period div parts").alias("release"),
        F.expr("((block + 1) * period + parts - 1) div parts").alias("deadline"),
        F.expr("(block div parts) * period + _slot").alias("slot"),
    )
    return at.select("row.*", mix.alias("mix"))
