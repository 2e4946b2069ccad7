"""Spectral gaps of many reversible chains at once, as edge joins.

The chain is made symmetric by the roots of its stationary weights, whose own eigenvector (eigenvalue 1) is taken out of every
vector; Lanczos steps on all graphs together give each a small tridiagonal matrix.  A graph leaves when its eigenvalue stands.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.sources.scratch import written

TOLERANCE = 1e-10
LOPSIDED = 1e-9  # difference of two rates that a reversible chain has alike
EARLY = 8  # steps before which a small bound may be another eigenvalue's
NOTHING_LEFT = 1e-9  # the bound where a step adds nothing: all of the space that the start spans has been seen


def _ritz(rows: pd.DataFrame) -> pd.DataFrame:
    """The largest |eigenvalue| of a graph's tridiagonal matrix so far and how far an eigenvalue of the graph may be off; rows are the steps, not the states."""
    rows = rows.sort_values("j")
    a, b = rows["alpha"].to_numpy(), rows["beta"].to_numpy()
    values, vectors = np.linalg.eigh(np.diag(a) + np.diag(b[:-1], 1) + np.diag(b[:-1], -1))
    at = int(np.abs(values).argmax())
    return pd.DataFrame([{"g": rows["g"].iloc[0], "ritz": float(abs(values[at])), "tolerance": float(b[-1] * abs(vectors[-1, at]))}])


def connected(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, num_states, is_connected): whether all states are reached from the least one along edges of weight."""
    keys = [*group, "node"]
    nodes = written(edges.select(*group, F.col("src").alias("node")).union(edges.select(*group, F.col("dst"))).distinct())
    ways = edges.filter("weight > 0 and src <> dst").select(*group, F.col("src").alias("node"), "dst")
    fronts = [nodes.groupBy(*group).agg(F.min("node").alias("node"))]
    while True:
        step = fronts[-1].join(ways, keys).select(*group, F.col("dst").alias("node")).distinct()
        front = written(step.join(reduce(DataFrame.union, fronts), keys, "left_anti"))
        if front.isEmpty():
            break
        fronts.append(front)
    met = reduce(DataFrame.union, fronts).groupBy(*group).agg(F.count(F.lit(1)).alias("met"))
    return nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("num_states")).join(met, group).select(*group, "num_states", (F.col("met") == F.col("num_states")).alias("is_connected"))


def spectral_gaps(edges: DataFrame, group: list[str], max_steps: int = 300) -> DataFrame:
    """(group, num_states, is_connected, spectral_gap, tolerance) of each graph; the gap is 1 - |second eigenvalue|, 1 for one state.

    ``edges`` holds loops and log_pi_src, the logarithm of each state's stationary weight (up to a constant per graph); the chains
    are reversible in it; one that is not has a null gap.  tolerance bounds how far the next eigenvalue of the graph is; after
    ``max_steps`` a graph has the tolerance it got to.  Columns of ``group`` are not null.  A chain that is not connected has gap 0.
    """
    edges = written(edges.withColumn("g", F.struct(*group)).select("g", *group, "src", "dst", "weight", "log_pi_src"))
    top = edges.groupBy("g").agg(F.max("log_pi_src").alias("top"))
    roots = edges.groupBy("g", "src").agg(F.max("log_pi_src").alias("l")).join(top, "g").select("g", "src", F.exp((F.col("l") - F.col("top")) / 2).alias("r"))
    sizes = roots.groupBy("g").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    roots = written(roots.join(sizes, "g").select("g", F.col("src").alias("node"), (F.col("r") / F.col("norm")).alias("root")))
    a, b = roots.select("g", F.col("node").alias("src"), F.col("root").alias("ra")), roots.select("g", F.col("node").alias("dst"), F.col("root").alias("rb"))
    matrix = written(edges.join(a, ["g", "src"]).join(b, ["g", "dst"]).select("g", "src", F.col("dst").alias("node"), (F.col("weight") * F.col("ra") / F.col("rb")).alias("s")))
    back = matrix.select("g", F.col("node").alias("src"), F.col("src").alias("node"), F.col("s").alias("s_back"))
    lopsided = matrix.join(back, ["g", "src", "node"], "left").groupBy("g").agg(F.max(F.abs(F.col("s") - F.coalesce("s_back", F.lit(0.0)))).alias("off")).filter(f"off > {LOPSIDED}")
    told = connected(edges, group).withColumn("g", F.struct(*group)).join(lopsided, "g", "left")
    told = written(told.select(*group, "num_states", "is_connected", F.col("off").isNull().alias("reversible")))

    noise = (F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 30)) + 0.5) / float(1 << 29) - 1
    now = roots.join(told.filter("num_states > 1 and reversible").select(F.struct(*group).alias("g")), "g").select("g", "node", "root", F.lit(0.0).alias("before"), noise.alias("cur"), F.lit(0.0).alias("beta"))
    now, settled, steps = written(_scaled(_deflated(now, "cur"), "cur")), None, None
    for j in range(max_steps if not now.isEmpty() else 0):
        y = now.select("g", "node", "cur").join(matrix, ["g", "node"]).groupBy("g", "src").agg(F.sum(F.col("s") * F.col("cur")).alias("y")).withColumnRenamed("src", "node")
        moved = written(now.join(y, ["g", "node"]))
        found = moved.groupBy("g").agg(F.sum(F.col("y") * F.col("cur")).alias("alpha"), F.sum(F.col("y") * F.col("root")).alias("along"))
        step = F.col("y") - F.col("alpha") * F.col("cur") - F.col("beta") * F.col("before") - F.col("along") * F.col("root")
        rest = written(moved.join(found, "g").select("g", "node", "root", F.col("cur").alias("before"), step.alias("next"), "alpha"))
        # rounding leaves a part along the root, which would grow
        size = rest.groupBy("g").agg(F.sum(F.col("next") * F.col("next")).alias("nn"), F.sum(F.col("next") * F.col("root")).alias("off"), F.max("alpha").alias("alpha"))
        size = written(size.select("g", "alpha", "off", F.sqrt(F.greatest(F.lit(0.0), F.col("nn") - F.col("off") * F.col("off"))).alias("beta"), F.lit(j).alias("j")))
        steps = size if steps is None else steps.unionByName(size)
        ritz = steps.join(size.select("g"), "g").groupBy("g").applyInPandas(_ritz, f"g {edges.schema['g'].dataType.simpleString()}, ritz double, tolerance double")
        last = written(ritz.join(size.select("g", "beta"), "g"))
        done = last if j + 1 == max_steps else last.filter(f"beta < {NOTHING_LEFT}" if j < EARLY else f"tolerance < {TOLERANCE} or beta < {NOTHING_LEFT}")
        done = done.select("g", "ritz", "tolerance")
        settled = done if settled is None else settled.unionByName(done)
        last = last.join(done.select("g"), "g", "left_anti")
        if last.isEmpty():
            break
        rest = rest.join(size.select("g", "beta", "off"), "g").join(last.select("g"), "g", "left_semi")
        now = rest.select("g", "node", "root", "before", ((F.col("next") - F.col("off") * F.col("root")) / F.col("beta")).alias("cur"), "beta")
    gap = F.when(F.col("num_states") == 1, 1.0).when(~F.col("reversible"), F.lit(None).cast("double")).when(~F.col("is_connected"), 0.0).otherwise(1 - F.col("ritz"))
    if settled is None:
        settled = edges.select("g", F.lit(0.0).alias("ritz"), F.lit(0.0).alias("tolerance")).limit(0)
    out = told.withColumn("g", F.struct(*group)).join(settled, "g", "left")
    return out.select(*group, "num_states", "is_connected", gap.alias("spectral_gap"), F.coalesce("tolerance", F.lit(0.0)).alias("tolerance"))


def _deflated(rows: DataFrame, x: str) -> DataFrame:
    """``x`` without its part along the root of the stationary weights, in each graph."""
    along = rows.groupBy("g").agg(F.sum(F.col("root") * F.col(x)).alias("_along"))
    return rows.join(along, "g").withColumn(x, F.col(x) - F.col("_along") * F.col("root")).drop("_along")


def _scaled(rows: DataFrame, x: str) -> DataFrame:
    size = rows.groupBy("g").agg(F.sqrt(F.sum(F.col(x) * F.col(x))).alias("_size"))
    return rows.join(size, "g").withColumn(x, F.col(x) / F.col("_size")).drop("_size")
