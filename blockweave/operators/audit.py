"""Expected against actual: completeness, failures, resumption, and join checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def param_grid(**axes: DataFrame) -> DataFrame:
    """Every combination of the values of small parameter tables."""
    out = None
    for name, df in axes.items():
        one = df.select(F.col(df.columns[0]).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(actual, keys, "left_anti")


def reconcile(expected: DataFrame, actual: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each expected or failed item: done, failed, unfinished, or unknown failure."""
    a = actual.select(*keys).distinct().withColumn("_done", F.lit(True))
    f = failures.select(*keys).distinct().withColumn("_failed", F.lit(True))
    e = expected.select(*keys).distinct().withColumn("_expected", F.lit(True))
    status = F.when(F.col("_expected").isNull(), "unknown failure").when(F.col("_done"), "done").when(F.col("_failed"), "failed").otherwise("unfinished")
    return e.join(a, keys, "left").join(f, keys, "full_outer").select(*keys, status.alias("status"))


def classify_series(df: DataFrame, series: str, x: str) -> DataFrame:
    """disconnected (lacks the grid's least point), incomplete (has fewer points than the grid) or complete."""
    grid = df.agg(F.min(x).alias("_low"), F.count_distinct(x).alias("_points"))  # one row
    per = df.groupBy(series).agg(F.min(x).alias("low"), F.count_distinct(x).alias("points"))
    status = F.when(F.col("low") > F.col("_low"), "disconnected").when(F.col("points") < F.col("_points"), "incomplete").otherwise("complete")
    return per.crossJoin(F.broadcast(grid)).select(series, "low", "points", status.alias("status"))


def resume(todo: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(finished.select(*keys), keys, "left_anti")


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join that fails where a side declared unique has a key twice."""
    for side, mark, name in ((left, validate.split(":")[0], "left"), (right, validate.split(":")[1], "right")):
        if mark == "1" and not side.groupBy(*on).count().filter("count > 1").isEmpty():
            raise ValueError(f"keys of the {name} side are not unique")
    return left.join(right, on, how)


def required(df: DataFrame, column: str, what: str) -> DataFrame:
    """Fails when the column is null in any row that is used."""
    return df.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(what))).otherwise(F.col(column)))
