"""Distributions as tables (key columns, p): building, conditioning, comparing and re-weighting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.functions.chance import uniform


def empirical(df: DataFrame, keys: list[str], weight: Column | None = None, within: list[str] | None = None) -> DataFrame:
    """Share of each key, of all rows or of the rows with the same ``within``.

    Rows are combined before anything is shuffled; only the totals of the distinct keys meet in a window.
    """
    within = within or []
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return normalize(df.groupBy(*within, *[k for k in keys if k not in within]).agg(n.alias("n")), "n", within)


def normalize(df: DataFrame, value: str, within: list[str] | None = None, out: str = "p") -> DataFrame:
    w = Window.partitionBy(*(within or [F.lit(0)]))
    return df.withColumn(out, F.col(value) / F.sum(value).over(w))


def softmax(df: DataFrame, log_weight: str, within: list[str], out: str = "p") -> DataFrame:
    w = Window.partitionBy(*(within or [F.lit(0)]))
    e = F.exp(F.col(log_weight) - F.max(log_weight).over(w))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def logsumexp(df: DataFrame, log_weight: str, within: list[str], out: str = "lse") -> DataFrame:
    top = df.groupBy(*within).agg(F.max(log_weight).alias("_top"))
    joined = df.join(top, within) if within else df.crossJoin(top)  # without groups the other side is one row
    return joined.groupBy(*within, "_top").agg(F.sum(F.exp(F.col(log_weight) - F.col("_top"))).alias("_s")).select(*within, (F.col("_top") + F.log("_s")).alias(out))


def coarsen(dist: DataFrame, keys: dict[str, Column], p: str = "p") -> DataFrame:
    """The distribution of a function of the key."""
    return dist.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.sum(p).alias(p))


def conditional(dist: DataFrame, given: list[str], p: str = "p") -> DataFrame:
    return normalize(dist, p, given, p)


def tvd(a: DataFrame, b: DataFrame, keys: list[str], within: list[str] | None = None, p: str = "p") -> DataFrame:
    """Total variation distance over the union of the keys, for each group of ``within``; both are normalised first."""
    within = within or []
    on = [*within, *keys]
    x = normalize(a, p, within, "_a").select(*on, "_a")
    y = normalize(b, p, within, "_b").select(*on, "_b")
    gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return x.join(y, on, "full_outer").groupBy(*within).agg((F.sum(gap) / 2).alias("tvd"))


def missing_mass(a: DataFrame, b: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Mass of ``a`` on keys that ``b`` lacks, and the distance over the keys of ``a`` only."""
    joined = a.join(b.select(*keys, F.col(p).alias("_b")), keys, "left")
    return joined.agg(
        F.coalesce(F.sum(F.when(F.col("_b").isNull(), F.col(p))), F.lit(0.0)).alias("missing"),
        (F.sum(F.abs(F.col(p) - F.coalesce("_b", F.lit(0.0)))) / 2).alias("one_sided_tvd"),
    )


def size_adjusted_tvd(a: DataFrame, b: DataFrame, size: str, keys: list[str], p: str = "p") -> DataFrame:
    """Distance of the conditional distributions given the size, weighted by the sizes of ``a``; a size that ``b`` lacks counts 1."""
    each = tvd(a, b, keys, [size], p)
    known = b.select(size).distinct().withColumn("_known", F.lit(True))
    share = normalize(a.groupBy(size).agg(F.sum(p).alias("_w")), "_w", out="_w").select(size, "_w")
    d = F.when(F.col("_known").isNull(), 1.0).otherwise(F.col("tvd"))
    return share.join(each, size).join(known, size, "left").agg(F.sum(F.col("_w") * d).alias("tvd"))


def reweight(dist: DataFrame, target: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """``dist`` scaled so that its mass by ``by`` is that of ``target``; keys without a target keep theirs."""
    own = dist.groupBy(*by).agg(F.sum(p).alias("_own"))
    goal = target.groupBy(*by).agg(F.sum(p).alias("_goal"))
    return dist.join(own, by).join(goal, by, "left").withColumn(p, F.col(p) * F.coalesce(F.col("_goal") / F.col("_own"), F.lit(1.0))).drop("_own", "_goal")


def adjustment(sample: DataFrame, made: DataFrame, keys: list[str], smooth: float = 0.001, double: Column | None = None, p: str = "p") -> DataFrame:
    """Ratio (made + s) / (sample + s) by key, doubled where ``double`` holds."""
    both = sample.select(*keys, F.col(p).alias("_a")).join(made.select(*keys, F.col(p).alias("_b")), keys, "full_outer")
    ratio = (F.coalesce("_b", F.lit(0.0)) + smooth) / (F.coalesce("_a", F.lit(0.0)) + smooth)
    return both.select(*keys, (ratio if double is None else ratio * F.when(double, 2).otherwise(1)).alias("ratio"))


def apply_adjustment(dist: DataFrame, ratios: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Weights times ratios (1 where a key has none), normalised."""
    scaled = dist.join(ratios, keys, "left").withColumn(p, F.col(p) * F.coalesce("ratio", F.lit(1.0))).drop("ratio")
    return normalize(scaled, p, out=p)


def bootstrap_tvd(dist: DataFrame, keys: list[str], n: int, reps: int, seed: int = 0, p: str = "p") -> DataFrame:
    """Distance of samples of ``n`` draws from the distribution itself, for ``reps`` samples: (rep, tvd).

    Draws are reps x n rows spread over the cluster; each finds its key in the cumulative distribution by an
    equality on hundredths and a range check, not by a comparison with every key.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(*keys)
    cum = normalize(dist, p, out=p).withColumn("_hi", F.sum(p).over(w)).withColumn("_lo", F.col("_hi") - F.col(p))
    last = F.max("_hi").over(Window.partitionBy(F.lit(0)))
    cum = cum.withColumn("_hi", F.when(F.col("_hi") == last, 2.0).otherwise(F.col("_hi")))
    cells = cum.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * 100).cast("int"), F.least(F.lit(100), F.floor(F.col("_hi") * 100)).cast("int"))))
    spark = dist.sparkSession
    draws = spark.range(reps * n).select((F.col("id") / n).cast("long").alias("rep"), F.col("id").alias("_d"))
    draws = draws.withColumn("_u", uniform(seed, "_d")).withColumn("_cell", F.floor(F.col("_u") * 100).cast("int"))
    hit = draws.join(cells, "_cell").filter("_u >= _lo and _u < _hi").groupBy("rep", *keys).agg((F.count(F.lit(1)) / n).alias("_q"))
    grid = spark.range(reps).select(F.col("id").alias("rep")).crossJoin(dist.select(*keys, F.col(p).alias("_p")))  # reps x keys, both parameters
    gap = grid.join(hit, ["rep", *keys], "left")
    return gap.groupBy("rep").agg((F.sum(F.abs(F.col("_p") - F.coalesce("_q", F.lit(0.0)))) / 2).alias("tvd"))
