"""Picking rows: first, least, last, top, slices, samples and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.functions.chance import uniform


def first_per_group(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the first in a total order.  Rows are reduced before the shuffle (min of a struct)."""
    rest = [c for c in df.columns if c not in keys]
    if all(isinstance(o, str) for o in order):
        lead = [o for o in order]
        packed = F.struct(*lead, *[c for c in rest if c not in lead])
        return df.groupBy(*keys).agg(F.min(packed).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def argmin_per_group(df: DataFrame, keys: list[str], value: str, tie: list[str]) -> DataFrame:
    return first_per_group(df, keys, [value, *tie])


def last_wins(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Overlapping sources: the row of the latest version stays."""
    rest = [c for c in df.columns if c not in keys and c != version]
    return df.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [version, *rest]])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def task_slices(df: DataFrame, n_tasks: int, seed: int, key: str, buckets: int = 1024) -> DataFrame:
    """Contiguous slices of equal (ceil) size of the rows in a seeded order, with ``slot`` and ``task``.

    The order is ranked within hash ranges and shifted by the ranges before, so no task sees all rows.
    """
    u = uniform(seed, key)
    d = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_u", key))).join(shift, "_b")
    slot = F.col("_before") + F.col("_r") - 1
    return d.withColumn("slot", slot).withColumn("task", F.floor(F.col("slot") / F.ceil(F.col("_total") / n_tasks))).drop("_u", "_b", "_r", "_before", "_total")


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, the first in a seeded order."""
    return df.withColumn("_u", uniform(seed, key)).orderBy("_u", key).limit(n).drop("_u")


def stratified_sample(df: DataFrame, strata: list[tuple[str, Column]], n: int, seed: int, key: str) -> DataFrame:
    """n rows of each stratum (name, condition); strata may overlap."""
    parts = [seeded_sample(df.filter(cond), n, seed + i, key).withColumn("stratum", F.lit(name)) for i, (name, cond) in enumerate(strata)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weighted_draw(df: DataFrame, group: list[str], p: str, order: list[str], seed: int) -> DataFrame:
    """One row of each group with probability p (which sums to 1): the one whose interval holds the group's uniform."""
    w = Window.partitionBy(*group).orderBy(*order)
    d = df.withColumn("_hi", F.sum(p).over(w)).withColumn("_rank", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    d = d.withColumn("_u", uniform(seed, *group)).withColumn("_lo", F.col("_hi") - F.col(p))
    hit = (F.col("_u") < F.col("_hi")) | (F.col("_rank") == F.col("_n"))
    return d.filter(hit).withColumn("_pick", F.row_number().over(w)).filter("_pick = 1").drop("_hi", "_lo", "_rank", "_n", "_u", "_pick")


def conditional_draw(rows: DataFrame, dist: DataFrame, on: list[str], row_key: list[str], order: list[str], seed: int, p: str = "p", buckets: int = 1024) -> DataFrame:
    """For each row a draw from the part of ``dist`` that agrees with it in ``on``: the candidate whose interval holds the row's uniform.

    A row meets the candidates of one of ``buckets`` parts of the unit interval, not all that agree.  A row that nothing agrees with has no
    draw.
    """
    w, whole = Window.partitionBy(*on).orderBy(*order), Window.partitionBy(*on)
    share = F.col(p) / F.sum(p).over(whole)
    d = dist.withColumn("_share", share).withColumn("_hi", F.sum("_share").over(w))
    d = d.withColumn("_lo", F.coalesce(F.lag("_hi").over(w), F.lit(0.0))).withColumn("_hi", F.when(F.row_number().over(w) == F.count(F.lit(1)).over(whole), 2.0).otherwise(F.col("_hi")))
    part = lambda x: F.least(F.floor(x * buckets), F.lit(buckets - 1)).cast("int")
    d = d.filter("_lo < _hi and _lo < 1").withColumn("_part", F.explode(F.sequence(part(F.col("_lo")), part(F.col("_hi"))))).drop(p, "_share")
    asked = rows.withColumn("_u", uniform(seed, *row_key)).withColumn("_part", part(F.col("_u")))
    return asked.join(d, [*on, "_part"]).filter("_u >= _lo and _u < _hi").drop("_u", "_lo", "_hi", "_part")


def fallback_flags(n: Column, k: Column, seed: int, *keys: str) -> Column:
    """An array of k ones and n - k zeros in a seeded order."""
    places = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.struct(uniform(seed, *keys, i).alias("u"), (i <= k).cast("int").alias("v")))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.transform(F.array_sort(places), lambda s: s["v"]))
