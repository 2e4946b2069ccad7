"""Hierarchical noise: Laplace noise by level, then top-down adjustment so that children add up to their parent."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.functions.chance import laplace, uniform
from blockweave.functions.keys import PREFIXES
from blockweave.sources.scratch import written

#: How the budget is split over the five levels.
SPLITS = {
    "equal": (0.2, 0.2, 0.2, 0.2, 0.2),
    "top": (0.5, 0.25, 1 / 12, 1 / 12, 1 / 12),
    "mid": (1 / 12, 1 / 6, 0.5, 1 / 6, 1 / 12),
    "bottom": (1 / 12, 1 / 12, 1 / 12, 0.25, 0.5),
}


def rollup_levels(leaves: DataFrame, geoid: str, values: list[str], prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """(node, parent, level from 0, values) for every prefix of the leaves' geoids; sums are combined before the shuffle."""
    cells = leaves.select(F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.substring(geoid, 1, n).alias("node"), (F.substring(geoid, 1, prefixes[i - 1]) if i else F.lit(None).cast("string")).alias("parent")) for i, n in enumerate(prefixes)])).alias("c"), *values)
    return cells.groupBy("c.level", "c.node", "c.parent").agg(*[F.sum(v).alias(v) for v in values])


def add_noise(nodes: DataFrame, values: list[str], epsilon: float, split: tuple[float, ...], seed: int, sensitivity: float = 2.0) -> DataFrame:
    """Each value plus Laplace noise of scale sensitivity / (epsilon x the level's share), from md5 uniforms of node and value."""
    if epsilon <= 0 or min(split) <= 0:
        raise ValueError("every level needs a positive budget")
    scale = F.element_at(F.array(*[F.lit(sensitivity / (epsilon * s)) for s in split]), F.col("level") + 1)
    return nodes.select("*", *[(F.col(v) + laplace(uniform(seed, "node", F.lit(v)), scale)).alias(f"{v}_noised") for v in values])


def project_pair(total: Column, part: Column) -> tuple[Column, Column]:
    """The nearest point to (total, part) with 0 <= part <= total."""
    mid = F.greatest((total + part) / 2, F.lit(0.0))
    over = part > total
    return F.when(over, mid).otherwise(F.greatest(total, F.lit(0.0))), F.when(over, mid).otherwise(F.greatest(part, F.lit(0.0)))


def simplex_projection(df: DataFrame, group: list[str], value: str, total: str, tie: str, out: str = "adjusted") -> DataFrame:
    """The nearest non-negative values of each group that sum to its ``total``: a sort and a running sum."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc(), tie)
    d = df.withColumn("_r", F.row_number().over(w)).withColumn("_s", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shift = (F.col("_s") - F.col(total)) / F.col("_r")
    whole = Window.partitionBy(*group)
    d = d.withColumn("_t", F.when(F.col(value) - shift > 0, F.struct(F.col("_r").alias("r"), shift.alias("t"))))
    d = d.withColumn("_t", F.max("_t").over(whole)["t"])
    return d.withColumn(out, F.greatest(F.col(value) - F.coalesce("_t", F.lit(0.0)), F.lit(0.0))).drop("_r", "_s", "_t")


def dykstra(tot: np.ndarray, vap: np.ndarray, t_sum: float, v_sum: float, rounds: int = 20_000, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Nearest (tot, vap) with both sums given and 0 <= vap <= tot, by alternating projections with corrections.

    RuntimeError where they have not settled after ``rounds``: no values that miss the sums are given.
    """
    t, v = tot.astype(float), vap.astype(float)
    ct, cv = np.zeros_like(t), np.zeros_like(v)
    for _ in range(rounds):
        a, b = t + (t_sum - t.sum()) / len(t), v + (v_sum - v.sum()) / len(v)
        x, y = a + ct, b + cv
        mid = np.maximum((x + y) / 2, 0)
        nt, nv = np.where(y > x, mid, np.maximum(x, 0)), np.where(y > x, mid, np.maximum(y, 0))
        ct, cv = x - nt, y - nv
        done = max(np.abs(nt - t).max(), np.abs(nv - v).max()) < tol
        t, v = nt, nv
        if done and abs(t.sum() - t_sum) < 1e-7 and abs(v.sum() - v_sum) < 1e-7:
            return t, v
    raise RuntimeError("the projections did not settle")


def adjust_children(children: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, key, tot, vap) nearest to the noised ones, with the parent's sums and 0 <= vap <= tot.

    ``children`` has noised tot and vap and the parent's tot_parent and vap_parent.  A group is one parent's children in one measure.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        t, v = dykstra(pdf["tot"].to_numpy(), pdf["vap"].to_numpy(), float(pdf["tot_parent"].iloc[0]), float(pdf["vap_parent"].iloc[0]))
        return pdf[[*group, key]].assign(tot=t, vap=v)

    kinds = ", ".join(f"{c} {children.schema[c].dataType.simpleString()}" for c in [*group, key])
    return children.groupBy(*group).applyInPandas(run, f"{kinds}, tot double, vap double")


def adjust_children_l1(children: DataFrame, group: list[str], key: str) -> DataFrame:
    """As ``adjust_children`` with the least sum of absolute changes instead of squares.

    With grown-ups v and others u = tot - v, both not negative and of given sums, only how much v lies over the noised tot in all (O) ties them
    together: changing tot costs O + |S - O|, where S is what the parent's tot has over the children's.  So v is filled up from 0 in
    the order of what a unit costs: to its noised value and not over the noised tot; to its noised value over it, as long as O is under S; then
    to the noised tot, and over it again as long as O is under S; then the rest.  Children share each part in proportion, or what has no bound alike.
    All of it is sums over a group.
    """
    c, zero = F.col, F.lit(0.0)
    d = children.select(*group, key, F.greatest(c("tot").cast("double"), zero).alias("t"), F.greatest(c("vap").cast("double"), zero).alias("v"), c("tot_parent").cast("double").alias("ts"), c("vap_parent").cast("double").alias("vs"))
    d = d.withColumn("a", F.least("t", "v")).withColumn("b", F.greatest(c("v") - c("t"), zero)).withColumn("c", F.greatest(c("t") - c("v"), zero))
    g = d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"), F.max("vs").alias("vs"), *[F.sum(x).alias(f"{x}_all") for x in "tabc"])
    up = F.greatest(c("ts") - c("t_all"), zero)  # S, where over 0
    g = g.withColumn("a_take", F.least("a_all", "vs")).withColumn("left", c("vs") - c("a_take"))
    g = g.withColumn("b_take", F.least(c("b_all"), c("left"), up)).withColumn("left", c("left") - c("b_take"))
    g = g.withColumn("c_take", F.least("c_all", "left")).withColumn("left", c("left") - c("c_take"))
    # over the noised tot: first those who are noised to be there, then alike
    g = g.withColumn("b_more", F.least(c("b_all") - c("b_take"), c("left"))).withColumn("each", (c("left") - c("b_more")) / c("n"))
    part = lambda take, whole: F.when(c(whole) > 0, take / c(whole)).otherwise(0.0)
    g = g.select(*group, c("n").alias("_n"), "each", part(c("a_take"), "a_all").alias("fa"), part(c("b_take") + c("b_more"), "b_all").alias("fb"), part(c("c_take"), "c_all").alias("fc"))
    d = d.join(g, group).withColumn("vap", c("a") * c("fa") + c("b") * c("fb") + c("c") * c("fc") + c("each"))
    d = d.withColumn("base", F.greatest(c("t") - c("vap"), zero))
    rest = d.groupBy(*group).agg(F.sum("base").alias("base_all"))
    gap = c("ts") - c("vs") - c("base_all")
    others = F.when(gap >= 0, c("base") + gap / c("_n")).otherwise(c("base") * (1 + gap / c("base_all")))
    return d.join(rest, group).select(*group, key, (c("vap") + others).alias("tot"), "vap")


def top_down(nodes: DataFrame, levels: int = 5, adjust: Callable[[DataFrame, list[str], str], DataFrame] = adjust_children) -> DataFrame:
    """Adjust level by level: (node, measure, level, tot, vap).

    ``nodes`` has node, parent, level, measure and noised tot and vap.  The root is projected on 0 <= vap <= tot; each level below
    is adjusted to its adjusted parents by ``adjust``: adjust_children (squares), adjust_children_l1 or one of the caller's own with the same
    columns.  A level is one shuffle by (parent, measure).
    """
    t, v = project_pair(F.col("tot"), F.col("vap"))
    done = written(nodes.filter("level = 0").select("node", "measure", "level", t.alias("tot"), v.alias("vap")))
    out = done
    for level in range(1, levels):
        up = done.select(F.col("node").alias("parent"), "measure", F.col("tot").alias("tot_parent"), F.col("vap").alias("vap_parent"))
        down = nodes.filter(F.col("level") == level).join(up, ["parent", "measure"])
        done = written(adjust(down.select("parent", "measure", "node", "tot", "vap", "tot_parent", "vap_parent"), ["parent", "measure"], "node").select("node", "measure", F.lit(level).alias("level"), "tot", "vap"))
        out = out.unionByName(done)
    return out


def with_error(adjusted: DataFrame, truth: DataFrame, values: list[str]) -> DataFrame:
    """``adjusted`` (node, measure, level, values) with <value>_error, what it has over the true value of the node; null where the truth has no such node."""
    true = truth.select("node", "measure", *[F.col(v).alias(f"_{v}") for v in values])
    out = adjusted.join(true, ["node", "measure"], "left")
    return out.select(*adjusted.columns, *[(F.col(v) - F.col(f"_{v}")).alias(f"{v}_error") for v in values])


def leaf_tables(adjusted: DataFrame, blocks: DataFrame, geoid: str, measures: list[str], leaf_level: int = 4) -> DataFrame:
    """``blocks`` with <measure>_tot and <measure>_vap of their leaves, one row per block: blocks or leaves without the other are left out.

    The names of ``measures`` are fixed, so the table's columns do not depend on the data.
    """
    cells = [F.max(F.when(F.col("measure") == m, F.col(v))).alias(f"{m}_{v}") for m in measures for v in ("tot", "vap")]
    leaves = adjusted.filter(F.col("level") == leaf_level).groupBy(F.col("node").alias(geoid)).agg(*cells)
    return blocks.join(leaves, geoid)
