"""Transition graphs of the chains over many areas at once: states by a frontier, edges by grouping states that one move connects.

A state is a sorted array of type ids.  Nothing holds a whole graph: states, lines of states that differ in one type, and
removals with their refills are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.functions import vectors
from blockweave.sources.scratch import written

from .solve import MAX_ELEMENTS

KINDS = ("reduced", "gibbs", "simple")


def fitting_types(targets: DataFrame, elements: DataFrame, key: str, counts: str) -> DataFrame:
    """(key, e, v, lp, most): the types that fit each area's counts, and how often."""
    types = elements.select(F.col("elem_id").cast("int").alias("e"), "v", F.log("p").alias("lp")).filter(F.exists("v", lambda x: x > 0))
    if types.limit(MAX_ELEMENTS + 1).count() > MAX_ELEMENTS:
        raise ValueError("too many household types")
    areas = targets.filter(F.col(counts).isNotNull()).select(key, F.col(counts).alias("_counts")).distinct()
    fit = areas.join(F.broadcast(types), vectors.fits("v", "_counts"))  # the table of types is bounded above
    return written(fit.select(key, "e", "v", "lp", vectors.max_multiplicity("_counts", "v").cast("int").alias("most")))


def states(targets: DataFrame, fit: DataFrame, key: str, counts: str, exact: bool = False) -> DataFrame:
    """(key, elems, left, log_p, n): all multisets of types within the counts of each area, or those that use them up.

    The frontier of all multisets of n types joins the types not before its last one, so each multiset is met once and nothing needs to be
    looked up among those seen.  log_p is the log-likelihood with the number of orders.  An area's counts occur once.
    """
    areas = targets.filter(F.col(counts).isNotNull()).select(key, F.col(counts).cast("array<int>").alias("left")).distinct()
    front = areas.select(key, F.array().cast("array<int>").alias("elems"), "left", F.lit(0.0).alias("log_p"), F.lit(0).alias("n"), F.lit(0).alias("last"), F.lit(0).alias("run"))
    found = front
    while True:
        run = F.when(F.col("e") == F.col("last"), F.col("run") + 1).otherwise(1)
        step = front.join(fit, key).filter((F.col("n") == 0) | (F.col("e") >= F.col("last"))).filter(vectors.fits("v", "left"))
        gain = F.col("lp") + F.log((F.col("n") + 1).cast("double")) - F.log(run.cast("double"))
        front = written(step.select(key, F.concat("elems", F.array("e")).alias("elems"), vectors.minus("left", "v").alias("left"), (F.col("log_p") + gain).alias("log_p"), (F.col("n") + 1).alias("n"), F.col("e").alias("last"), run.alias("run")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    found = found.drop("last", "run")
    return found.filter(vectors.is_zero("left")) if exact else found


def numbered(found: DataFrame, key: str) -> DataFrame:
    """``found`` with a long ``id`` that ascends with key and elems."""
    return written(found.repartitionByRange(key, "elems").sortWithinPartitions(key, "elems").withColumn("id", F.monotonically_increasing_id()))


def _lines(nodes: DataFrame, fit: DataFrame, key: str, kind: str) -> DataFrame:
    """Edges between the states that differ in how often they have one type: a line has most + 1 states at most."""
    types = fit.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    rest = F.filter("elems", lambda x: x != F.col("e"))
    rows = nodes.join(fit.select(key, "e", "most"), key).select(key, "e", "most", rest.alias("rest"), F.struct("id", "log_pi").alias("s"))
    lines = rows.groupBy(key, "e", "most", "rest").agg(F.collect_list("s").alias("line")).join(types, key)
    top = F.array_max(F.transform("line", lambda s: s.log_pi))
    lines = lines.withColumn("top", top).withColumn("mass", F.aggregate("line", F.lit(0.0), lambda a, s: a + F.exp(s.log_pi - F.col("top"))))
    pairs = lines.select(key, "m", "most", "top", "mass", "line", F.explode("line").alias("a")).select("*", F.explode("line").alias("b")).filter("a.id <> b.id")
    share = F.exp(F.col("b.log_pi") - F.col("top")) / F.col("mass") if kind == "gibbs" else F.least(F.lit(1.0), F.exp(F.col("b.log_pi") - F.col("a.log_pi"))) / F.col("most")
    return pairs.select(key, F.col("a.id").alias("src"), F.col("b.id").alias("dst"), (share / (2 * F.col("m"))).alias("weight"))


def removals(sols: DataFrame, elements: DataFrame, k: int, own: bool = False) -> DataFrame:
    """Each state with its distinct removals of min(k, n) types, or of its ``own`` kk (k at most): columns of ``sols``, keep, sub (the removed types' counts), kk."""
    v = elements.select(F.col("elem_id").cast("int").alias("_e"), F.col("v").alias("_v"))
    rows = (sols if own else sols.withColumn("kk", F.least(F.lit(k), F.col("n")))).withColumn("at", F.array().cast("array<int>")).withColumn("sub", F.transform("left", lambda x: x * 0))
    for _ in range(k):
        last = F.coalesce(F.array_max("at"), F.lit(-1))
        first = lambda p: (p == 0) | (F.get("elems", p) != F.get("elems", p - 1)) | (p - 1 == last)  # noqa: E731  of equal types the first that is left
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda p: (p > last) & first(p))
        rows = rows.withColumn("p", F.explode(F.when(F.size("at") < F.col("kk"), places).otherwise(F.array(F.lit(-1)))))
        rows = rows.withColumn("_e", F.when(F.col("p") >= 0, F.get("elems", F.col("p")))).join(v, "_e", "left")
        rows = rows.withColumn("at", F.when(F.col("p") >= 0, F.concat("at", F.array("p"))).otherwise(F.col("at"))).withColumn("sub", F.when(F.col("p") >= 0, vectors.plus("sub", "_v")).otherwise(F.col("sub")))
        rows = rows.drop("p", "_e", "_v")
    return rows.withColumn("keep", F.filter("elems", lambda x, i: ~F.array_contains("at", i)))


def _refilled(nodes: DataFrame, elements: DataFrame, key: str, k: int) -> DataFrame:
    """Edges between exact states that agree but for a removal of k types and its refill, drawn by the likelihood of the whole."""
    out = written(removals(nodes, elements, k).select(key, F.col("id").alias("src"), "n", "kk", "at", "keep", "sub"))
    subs = out.select("sub").distinct()
    fills = states(subs.withColumn("counts", F.col("sub")), fitting_types(subs.withColumn("counts", F.col("sub")), elements, "sub", "counts"), "sub", "counts", exact=True)
    full = out.join(fills.select("sub", F.col("elems").alias("fill")), "sub").withColumn("elems", F.array_sort(F.concat("keep", "fill")))
    full = written(full.join(nodes.select(key, "elems", F.col("id").alias("dst"), "log_pi"), [key, "elems"]).select(key, "src", "dst", "n", "kk", "at", "log_pi"))
    top = full.groupBy("src", "at").agg(F.max("log_pi").alias("top"))
    full = full.join(top, ["src", "at"]).withColumn("e", F.exp(F.col("log_pi") - F.col("top")))
    mass = full.groupBy("src", "at").agg(F.sum("e").alias("mass"))
    choices = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("kk"), F.lit(1))), F.lit(1.0), lambda a, i: F.when(i <= F.col("kk"), a * (F.col("n") - F.col("kk") + i) / i).otherwise(a))
    moves = full.join(mass, ["src", "at"]).filter("src <> dst").withColumn("weight", F.col("e") / F.col("mass") / (2 * choices))
    return moves.groupBy(key, "src", "dst").agg(F.sum("weight").alias("weight"))


def graph_states(targets: DataFrame, elements: DataFrame, key: str, counts: str, kind: str, param: float) -> tuple[DataFrame, DataFrame]:
    """Numbered states of each area's chain with ``log_pi`` (and ``left_sum``), and the types that fit."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    fit = fitting_types(targets, elements, key, counts)
    left = F.aggregate("left", F.lit(0).cast("long"), lambda a, x: a + x)
    gamma = 0.0 if kind == "reduced" else float(param)
    found = states(targets, fit, key, counts, exact=kind == "reduced").withColumn("left_sum", left)
    return numbered(found.withColumn("log_pi", F.col("log_p") - gamma * F.col("left_sum")), key), fit


def transition_graphs(targets: DataFrame, elements: DataFrame, key: str, counts: str, kind: str, param: float) -> DataFrame:
    """Edges (key, kind, param, src, dst, weight, left_src, left_dst, log_pi_src, elems_src, elems_dst) of each area's chain, loops included.

    ``kind`` reduced: the lazy chain over exact solutions that takes ``param`` types out and refills by the likelihood of the whole.
    gibbs: over all multisets within the counts, one type's multiplicity is redrawn by likelihood and exp(-param x what is left).
    simple: one type's multiplicity is proposed and taken by the ratio of these weights.  An area without a state has no rows;
    null counts have none.  Areas are told apart by ``key``; left is what a state leaves of the counts.
    """
    nodes, fit = graph_states(targets, elements, key, counts, kind, param)
    moves = written(_refilled(nodes, elements, key, int(param)) if kind == "reduced" else _lines(nodes, fit, key, kind))
    stay = nodes.join(moves.groupBy("src").agg(F.sum("weight").alias("out")), nodes["id"] == F.col("src"), "left")
    edges = moves.unionByName(stay.select(key, F.col("id").alias("src"), F.col("id").alias("dst"), (1 - F.coalesce("out", F.lit(0.0))).alias("weight")))
    a = nodes.select(F.col("id").alias("src"), F.col("left_sum").alias("left_src"), F.col("log_pi").alias("log_pi_src"), F.col("elems").alias("elems_src"))
    b = nodes.select(F.col("id").alias("dst"), F.col("left_sum").alias("left_dst"), F.col("elems").alias("elems_dst"))
    out = edges.join(a, "src").join(b, "dst")
    return written(out.select(key, F.lit(kind).alias("kind"), F.lit(float(param)).alias("param"), "src", "dst", "weight", "left_src", "left_dst", "log_pi_src", "elems_src", "elems_dst"))


def empirical_row(visits: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Distance (tvd) of the steps that were seen out of each state from the graph's row: (key, src, n_steps, tvd).

    ``visits`` (key, src, dst) has one row a step, with the states as sorted arrays like elems_src; states that were not visited have no row.
    """
    seen = visits.groupBy(key, "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    total = seen.groupBy(key, "src").agg(F.sum("n").alias("n_steps"))
    rows = edges.select(key, F.col("elems_src").alias("src"), F.col("elems_dst").alias("dst"), "weight").join(total, [key, "src"])
    both = rows.join(seen.join(total, [key, "src"]), [key, "src", "dst", "n_steps"], "full")
    gap = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce(F.col("n") / F.col("n_steps"), F.lit(0.0)))
    return both.groupBy(key, "src", "n_steps").agg((F.sum(gap) / 2).alias("tvd"))


def consistent_removals(pairs: DataFrame, elements: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """All removals of ``k`` types from state ``a`` after which state ``b`` can be refilled: columns of pairs, removed, kept, sub.

    ``a`` and ``b`` are sorted arrays of type ids.  What a has more often than b goes in each; the others of the k are any distinct
    sub-multiset of what they share.  ``sub`` are the removed types' counts.  Pairs that differ in more than k types have no row.
    """
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.filter(F.col(a), lambda x, i: times(F.slice(F.col(a), F.lit(1), i + 1), x) <= times(F.col(b), x))
    width = elements.select(F.max(F.size("v"))).first()[0] or 0
    rows = pairs.withColumn("elems", both).withColumn("n", F.size("elems")).withColumn("kk", k - F.size(a) + F.col("n")).filter("kk between 0 and n")
    out = removals(rows.withColumn("left", F.array_repeat(F.lit(0), width)), elements, k, own=True).drop("sub")
    # of a's types, as often as they are not kept
    gone = F.filter(F.col(a), lambda x, i: times(F.slice(F.col(a), F.lit(1), i + 1), x) > times(F.col("keep"), x))
    out = out.select(*pairs.columns, gone.alias("removed"), F.col("keep").alias("kept"))
    row = F.xxhash64(*pairs.columns, "removed")
    v = elements.select(F.col("elem_id").cast("int").alias("_e"), F.posexplode("v").alias("_d", "_x"))
    sums = out.select("removed", row.alias("_row")).distinct().select("_row", F.explode("removed").alias("_e")).join(v, "_e").groupBy("_row", "_d").agg(F.sum("_x").alias("_x"))
    sums = sums.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda s: s["_x"]).alias("sub"))
    return out.withColumn("_row", row).join(sums, "_row", "left").drop("_row")
