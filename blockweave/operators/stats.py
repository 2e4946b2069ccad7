"""Statistics over probability lists and value columns."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.sources.scratch import written


def cumulative(df: DataFrame, within: list[str], order: list[Column | str], value: str, out: str = "cumulative") -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def first_above(df: DataFrame, within: list[str], rank: str, cum: str, shares: dict[str, float]) -> DataFrame:
    """The first rank at which the cumulative value exceeds each share."""
    return df.groupBy(*within).agg(*[F.min(F.when(F.col(cum) > q, F.col(rank))).alias(name) for name, q in shares.items()])


def rank_quantiles(df: DataFrame, within: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Empirical quantiles by index: the floor(n q)-th value in ascending order (nulls first), counted from 0.

    Equal values are counted first.  Values are ranked inside ranges and shifted by the ranges before, so a group of any
    size is many tasks.
    """
    seen = df.groupBy(*within, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    seen = written(seen.repartitionByRange(*within, "_v").withColumn("_b", F.spark_partition_id()))
    w = Window.partitionBy(*within)
    up_to = Window.unboundedPreceding, -1
    per = seen.groupBy(*within, "_b").agg(F.sum("_c").alias("_s"))
    per = per.select("_b", *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.coalesce(F.sum("_s").over(w.orderBy("_b").rowsBetween(*up_to)), F.lit(0)).alias("_before"), F.sum("_s").over(w).alias("_n"))
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy("_b", *within).orderBy("_v").rowsBetween(*up_to)), F.lit(0))
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(within)], F.col("_b") == F.col("_o"))
    d = seen.withColumn("_inside", inside).join(per.withColumnRenamed("_b", "_o"), same)
    first, at = F.col("_before") + F.col("_inside"), {name: F.floor(F.col("_n") * q) for name, q in shares.items()}
    return d.groupBy(*within).agg(*[F.max(F.when((first <= i) & (i < first + F.col("_c")), F.col("_v"))).alias(name) for name, i in at.items()])


def coverage(df: DataFrame, group: list[str], rank: str, p: str, tail: int = 50, head: int = 500) -> DataFrame:
    """Of each group's probability list (rank from 1): total, last, sum of the last ``tail``, first ``tail``, first and best ``head``.

    A list shorter than a slice counts whole.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(p).desc(), rank))
    d = df.withColumn("_n", n).withColumn("_best", best)

    def part(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(p)).otherwise(0.0))

    r = F.col(rank)
    return d.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(p).alias("total"),
        F.max(F.when(r == F.col("_n"), F.col(p))).alias("last"),
        part(r > F.col("_n") - tail).alias("last_part"),
        part(r <= tail).alias("first_part"),
        part(r <= head).alias("first_head"),
        part(F.col("_best") <= head).alias("best_head"),
    )


def ccdf(df: DataFrame, value: str) -> DataFrame:
    """(value, n, ccdf): the share of rows with at least this value."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))
    return counts.select(value, "n", (F.sum("n").over(w.orderBy(F.col(value).desc())) / F.sum("n").over(w)).alias("ccdf"))


def vector_sum(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise sum of arrays by key: (keys, pos, total)."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "_x")).groupBy(*keys, "pos").agg(F.sum(F.col("_x").cast("double")).alias("total"))


def entropy(df: DataFrame, group: list[str], category: str) -> DataFrame:
    counts = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(*group))
    return counts.withColumn("_p", share).groupBy(*group).agg(F.sum(-F.col("_p") * F.log("_p")).alias("entropy"))


def ols(df: DataFrame, y: str, x: str, within: list[str] | None = None) -> DataFrame:
    yx = (F.col(y).cast("double"), F.col(x).cast("double"))
    return df.groupBy(*(within or [])).agg(F.regr_slope(*yx).alias("slope"), F.regr_intercept(*yx).alias("intercept"), F.regr_r2(*yx).alias("r2"))


def fixed_bins(df: DataFrame, value: Column, low: float, high: float, n: int) -> DataFrame:
    return df.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(n)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, value: str, within: list[str] | None = None) -> DataFrame:
    v = F.col(value)
    q = [F.percentile(v, F.lit(x)).alias(name) for name, x in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    return df.groupBy(*(within or [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("low"), *q, F.max(v).alias("high"))


def mean_std(df: DataFrame, value: str, within: list[str]) -> DataFrame:
    return df.groupBy(*within).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def power_law(df: DataFrame, within: list[str], x: str, y: str, rounds: int = 60) -> DataFrame:
    """Least-squares fit y = a x ** -b (not of the logarithms) by Gauss-Newton: (within, a, b, sse).

    The input is a curve of distinct points for each group, not raw rows.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[(pdf[x] > 0) & (pdf[y] > 0)]
        px, py = d[x].to_numpy(float), d[y].to_numpy(float)
        if len(np.unique(px)) < 2:
            return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in within}, "a": np.nan, "b": np.nan, "sse": np.nan}])
        slope, start = np.polyfit(np.log(px), np.log(py), 1)
        a, b, damp = np.exp(start), -slope, 1e-3
        sse = ((a * px**-b - py) ** 2).sum()
        for _ in range(rounds):
            f = px**-b
            j = np.stack([f, -a * f * np.log(px)], 1)
            h = j.T @ j
            step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ (py - a * f))
            new = ((((a + step[0]) * px ** -(b + step[1])) - py) ** 2).sum()
            if new <= sse:
                a, b, sse, damp = a + step[0], b + step[1], new, damp / 10
                if np.abs(step).max() < 1e-13:
                    break
            else:
                damp *= 10
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in within}, "a": a, "b": b, "sse": sse}])

    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in within] + ["a double", "b double", "sse double"])
    return df.select(*within, x, y).groupBy(*within).applyInPandas(fit, schema)
