"""Exact enumeration of the multisets of household types that add up to an area's counts.

Areas are rows; their distinct counts are dealt out and each is solved on its own.  The table of types is a
parameter of the job, checked against MAX_ELEMENTS before it goes to the tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockweave.functions.vectors import log_likelihood
from blockweave.sources.scratch import written

from . import kbest

MAX_ELEMENTS = 200_000
#: States of one area's search: about 16 bytes each.
MAX_NODES = 10_000_000
#: With so many fitting types at most a plain search of a few nodes is tried first.  This decides cost, never results.
FEW_TYPES = 32
PLAIN_NODES = 2_000


def lexicographic(elements: DataFrame, vector: str = "v") -> DataFrame:
    """``elem_id`` 1, 2, ... in the lexicographic order of the vectors (a small parameter table)."""
    return elements.withColumn("elem_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(vector)))


def element_list(elements: DataFrame) -> list[tuple[int, tuple[int, ...], float]]:
    rows = elements.select("elem_id", "v", "p").orderBy("v").limit(MAX_ELEMENTS + 1).collect()
    if len(rows) > MAX_ELEMENTS:
        raise ValueError("too many household types")
    return [(r.elem_id, tuple(r.v), r.p) for r in rows if any(r.v)]


class Types(NamedTuple):
    """The table of household types as arrays, by id."""

    ids: np.ndarray
    v: np.ndarray
    cost: np.ndarray


def types_of(elements: list[tuple[int, tuple[int, ...], float]]) -> Types:
    rows = sorted(elements)
    return Types(np.array([e for e, _, _ in rows], np.int64), np.array([v for _, v, _ in rows], np.int32).reshape(len(rows), len(rows[0][1]) if rows else 0), -np.log(np.array([p for _, _, p in rows], float)))


def search(counts: tuple[int, ...], elements: list[tuple[int, tuple[int, ...], float]] | Types, n_best: int, max_nodes: int = MAX_NODES) -> tuple[list[tuple[float, dict[int, int]]], bool]:
    """(cost, {elem_id: n}) of the ``n_best`` solutions with the least sum of -ln p, best first; and whether they are certain.

    Few types are searched plainly, others (and what that does not end on) by the k-best dynamic program, in ``max_nodes`` states.
    Counts under 0 have no solution.  Ties go to the multiset that comes first by element.
    """
    if min(counts, default=0) < 0:
        return [], True
    types = elements if isinstance(elements, Types) else types_of(elements)
    fit = np.flatnonzero((types.v <= np.array(counts)).all(axis=1)) if len(types.ids) else np.zeros(0, int)
    if len(fit) <= FEW_TYPES:
        few = [(int(types.ids[i]), tuple(types.v[i].tolist()), math.exp(-types.cost[i])) for i in fit]
        best, ended = plain_search(counts, few, n_best, min(max_nodes, PLAIN_NODES))
        if ended:
            return best, True
    best, certain = kbest.n_best(np.array(counts), types.v[fit], types.cost[fit], n_best, max_nodes)
    return [(c, {int(types.ids[fit[e]]): k for e, k in x}) for c, x in best], certain


def plain_search(counts: tuple[int, ...], elements: list[tuple[int, tuple[int, ...], float]], n_best: int, max_nodes: int) -> tuple[list[tuple[float, dict[int, int]]], bool]:
    """As ``search``, for few types; and whether it ended within ``max_nodes`` nodes.

    Depth first over the elements that fit, those with the least cost a person first.  What is left of each count costs
    at least as much as the cheapest later element asks for it; a branch whose cost with that is over the worst of the
    ``n_best`` best found ends, and so does one with a count that no later element fills.  The last element that fills
    a count has no choice.
    """
    fit = [(e, v, -math.log(p)) for e, v, p in elements if all(a <= c for a, c in zip(v, counts, strict=True))]
    fit.sort(key=lambda x: (x[2] / sum(x[1]), x[0]))
    dims = range(len(counts))
    least = [[math.inf] * len(counts)]  # of the elements from i on, the least cost of one unit of each count
    for _, v, c in reversed(fit):
        least.append([min(least[-1][d], c / v[d]) if v[d] else least[-1][d] for d in dims])
    least.reverse()
    last = [[d for d in dims if v[d] and least[i + 1][d] == math.inf] for i, (_, v, _) in enumerate(fit)]

    def rank(x: tuple[float, tuple[tuple[int, int], ...]]) -> tuple:
        return round(x[0], 9), [(e, -n) for e, n in sorted(x[1])]

    found: list[tuple[float, tuple[tuple[int, int], ...]]] = []
    pool: list[float] = []  # minus the costs of the n_best best, as a heap
    nodes = 0
    stack: list[tuple[int, tuple[int, ...], float, tuple[tuple[int, int], ...]]] = [(0, tuple(counts), 0.0, ())]
    while stack and nodes < max_nodes:
        i, left, cost, chosen = stack.pop()
        nodes += 1
        rest = [x * y for x, y in zip(left, least[i], strict=True) if x]
        if not rest:
            if len(pool) < n_best:
                heapq.heappush(pool, -cost)
            elif cost > -pool[0] + 1e-9:
                continue
            else:
                heapq.heappushpop(pool, -cost)
            found.append((cost, chosen))
            if len(found) >= 4 * n_best + 1000:
                found = sorted(found, key=rank)[:n_best]
            continue
        bound = max(rest)
        if bound == math.inf or (len(pool) == n_best and cost + bound > -pool[0] + 1e-9):
            continue
        e, v, c = fit[i]
        some, most = 0, min(x // y for x, y in zip(left, v, strict=True) if y)
        if last[i]:
            some = left[last[i][0]] // v[last[i][0]]
            if some > most or any(some * v[d] != left[d] for d in last[i]):
                continue
            most = some
        for n in range(some, most + 1):
            stack.append((i + 1, tuple(x - n * y for x, y in zip(left, v, strict=True)) if n else left, cost + n * c, (*chosen, (e, n)) if n else chosen))
    return [(c, dict(x)) for c, x in sorted(found, key=rank)[:n_best]], not stack


SOLUTION = "sol_rank int, elems array<struct<elem_id:int,n:int>>, cost double, log_w double, complete boolean"


def _each_once(targets: DataFrame, key: str, counts: str, run, kinds: str) -> DataFrame:
    """``run`` on the distinct counts, dealt out by their values, and its rows for every area that has them."""
    spark, name = targets.sparkSession, F.col(counts).cast("array<int>").alias("_counts")
    own = targets.filter(F.col(counts).isNotNull()).select(key, name)
    once = own.select("_counts").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_counts")
    return own.join(written(once.mapInPandas(run, f"_counts array<int>, {kinds}")), "_counts").drop("_counts")


def enumerate_solutions(targets: DataFrame, elements: DataFrame, key: str, counts: str, n_best: int = 5000, max_nodes: int = MAX_NODES) -> DataFrame:
    """(key, sol_rank from 1, elems, cost, log_w, complete) of every area; an area without a solution has no rows.

    Where the search stopped before it found any, the area is undecided: one row that has nulls and is not complete.
    Areas with the same counts are solved once; an area's rows follow each other by rank.

    log_w is the multiset's log-likelihood with the number of its orders.  ``complete`` is false where the pool was
    full or the search stopped.  Null counts have no solution.
    """
    table = targets.sparkSession.sparkContext.broadcast(types_of(element_list(elements)))  # MAX_ELEMENTS rows at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = table.value
        logp = dict(zip(held.ids.tolist(), (-held.cost).tolist(), strict=True))
        for pdf in batches:
            rows = []
            for c in pdf["_counts"]:
                best, ended = search(tuple(int(x) for x in c), held, n_best, max_nodes)
                if not best and not ended:
                    rows.append((c, None, None, None, None, False))
                for rank, (cost, sol) in enumerate(best, 1):
                    n = sum(sol.values())
                    log_w = sum(m * logp[e] for e, m in sol.items()) + math.lgamma(n + 1) - sum(math.lgamma(m + 1) for m in sol.values())
                    rows.append((c, rank, [{"elem_id": e, "n": m} for e, m in sorted(sol.items())], cost, log_w, ended and len(best) < n_best))
            yield pd.DataFrame(rows, columns=["_counts", "sol_rank", "elems", "cost", "log_w", "complete"]).astype({"sol_rank": "Int32", "cost": "Float64", "log_w": "Float64"})

    return _each_once(targets, key, counts, run, SOLUTION).sortWithinPartitions(key, "sol_rank")


def solution_probs(solutions: DataFrame, key: str, gamma_slack: tuple[float, str] | None = None) -> DataFrame:
    """Softmax of the solutions' log weights within each area, minus gamma x slack where given."""
    w = Window.partitionBy(key)
    log_w = F.col("log_w") if gamma_slack is None else F.col("log_w") - gamma_slack[0] * F.col(gamma_slack[1])
    top = solutions.withColumn("_l", log_w).withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(w)))
    return top.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_l", "_e")


def relax(targets: DataFrame, levels: list[tuple[int, str, DataFrame]], key: str, n_best: int = 5000, max_nodes: int = MAX_NODES) -> DataFrame:
    """Solve at the first level (number, counts column, elements) that has a solution; areas that none solves have level null.

    An undecided area (null elems) stays at the level whose search was cut off: that one may have a solution.
    """
    left, out = targets, None
    for level, counts, elements in levels:
        got = written(enumerate_solutions(left, elements, key, counts, n_best, max_nodes).withColumn("level", F.lit(level)))
        out = got if out is None else out.unionByName(got)
        left = written(left.join(got.select(key).distinct(), key, "left_anti"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema if f.name != key]
    return out.unionByName(left.select(key, *blank))


def recursive_solutions(spark, targets_view: str, elements_view: str) -> DataFrame:
    """The same as a recursive query, for instances of few elements: (block, ms) with the multiplicity of each element."""
    return spark.sql(f"""
        WITH RECURSIVE n AS (SELECT max(elem_id) AS m FROM {elements_view}),
        walk(block, i, rest, ms) AS (
          SELECT block, 0, counts, cast(array() AS array<int>) FROM {targets_view}
          UNION ALL
          SELECT w.block, w.i + 1, zip_with(w.rest, e.v, (a, b) -> a - b * k.k), concat(w.ms, array(k.k))
          FROM walk w JOIN {elements_view} e ON e.elem_id = w.i + 1
          JOIN (SELECT explode(sequence(0, max(array_max(counts)))) AS k FROM {targets_view}) k ON forall(zip_with(w.rest, e.v, (a, b) -> a - b * k.k), x -> x >= 0) AND (k.k = 0 OR exists(e.v, x -> x > 0)))
        SELECT block, ms FROM walk, n WHERE i = n.m AND forall(rest, x -> x = 0)""")


def _layers(counts: tuple[int, ...], fit: list[tuple[int, tuple[int, ...], float]]) -> Iterator[dict[tuple[int, ...], float]]:
    """After each element, ln of the sum of prod p^x / x! over the ways to each of what may be left of the counts."""
    later = [[False] * len(counts)]  # which counts an element from i on fills
    for _, v, _ in reversed(fit):
        later.append([x or y > 0 for x, y in zip(later[-1], v, strict=True)])
    later.reverse()
    now = {tuple(counts): 0.0}
    yield now
    for i, (_, v, lp) in enumerate(fit):
        then: dict[tuple[int, ...], float] = {}
        for left, z in now.items():
            n = 0
            while min(left) >= 0:
                if all(ok or not x for ok, x in zip(later[i + 1], left, strict=True)):
                    then[left] = float(np.logaddexp(then.get(left, -math.inf), z + n * lp - math.lgamma(n + 1)))
                n, left = n + 1, tuple(x - y for x, y in zip(left, v, strict=True))
        now = then
        yield now


def _fitting(counts: tuple[int, ...], elements: list[tuple[int, tuple[int, ...], float]]) -> list[tuple[int, tuple[int, ...], float]]:
    return [(e, v, math.log(p)) for e, v, p in elements if all(a <= c for a, c in zip(v, counts, strict=True))]


def log_partition(counts: tuple[int, ...], elements: list[tuple[int, tuple[int, ...], float]]) -> float:
    """ln of the sum over exact solutions of prod p^x / x!, by dynamic programming over elements and what is left."""
    last: dict[tuple[int, ...], float] = {}
    for last in _layers(counts, _fitting(counts, elements)):  # noqa: B007
        pass
    return last.get((0,) * len(counts), -math.inf)


#: Draws made at once, times the types that fit.
DRAWN_AT_ONCE = 1 << 20


def _uniforms(keys: np.ndarray, places: int) -> np.ndarray:
    """``places`` uniforms in [0, 1) of each 64-bit key: its own sequence of mixed numbers."""
    z = keys[:, None] + np.arange(1, places + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _ancestors(layers: list[dict], fit: list[tuple[int, tuple[int, ...], float]], u: np.ndarray) -> np.ndarray:
    """Solutions (a row of ``u`` each, by the places of ``fit``) drawn with chance prod p^x / x! over their sum: back from nothing left, one element at a time.

    Draws that have the same left go on together.
    """
    counts = next(iter(layers[0]))
    out = np.zeros(u.shape, np.int32)
    lefts, at_left = [(0,) * len(counts)], np.zeros(len(u), np.int64)
    for j in reversed(range(len(fit))):
        _, v, lp = fit[j]
        number: dict[tuple[int, ...], int] = {}
        then = np.zeros(len(u), np.int64)
        order = np.argsort(at_left, kind="stable")
        ends = np.searchsorted(at_left[order], np.arange(len(lefts) + 1))
        for i, left in enumerate(lefts):
            own = order[ends[i] : ends[i + 1]]
            if not len(own):
                continue
            places, weights, n, at = [], [], 0, left
            while all(a <= c for a, c in zip(at, counts, strict=True)):
                if at in layers[j]:
                    places.append((n, number.setdefault(at, len(number))))
                    weights.append(layers[j][at] + n * lp - math.lgamma(n + 1))
                n, at = n + 1, tuple(x + y for x, y in zip(at, v, strict=True))
            w = np.cumsum(np.exp(np.array(weights) - max(weights)))
            pick = np.minimum(np.searchsorted(w / w[-1], u[own, j], "right"), len(places) - 1)
            both = np.array(places)[pick]
            out[own, j], then[own] = both[:, 0], both[:, 1]
        lefts, at_left = list(number), then
    return out


def partition_draws(targets: DataFrame, elements: DataFrame, key: str, counts: str, draws: int = 1, seed: int = 0) -> DataFrame:
    """(key, draw from 0, elems): independent exact solutions of each area with chance prod p^x / x!; none where it has none.

    Areas with the same counts follow each other in one task, share its table and are drawn together, each by its key's own uniforms.
    Null counts give no row.
    """
    held = element_list(elements)
    kind = targets.schema[key].dataType.simpleString()
    jobs = targets.filter(F.col(counts).isNotNull()).select(key, F.col(counts).cast("array<int>").alias("_counts"), F.xxhash64(F.lit(seed), key).alias("_u"))
    cell = pa.struct([("elem_id", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            listed = batch["_counts"].to_pylist()
            names, keys = batch[key], batch["_u"].to_numpy().view(np.uint64)
            cuts = [0, *[i for i in range(1, len(listed)) if listed[i] != listed[i - 1]], len(listed)]
            for a, b in zip(cuts, cuts[1:]) if listed else ():  # noqa: B905
                c = tuple(listed[a])
                if known != c:
                    known, fit = c, _fitting(c, held)
                    layers = list(_layers(c, fit))
                    by_id = np.argsort([e for e, _, _ in fit], kind="stable")
                    ids = np.array([e for e, _, _ in fit], np.int32)[by_id]
                if (0,) * len(c) not in layers[-1]:
                    continue
                size = max(1, DRAWN_AT_ONCE // max(1, len(fit)))
                for first in range(a * draws, b * draws, size):
                    which = np.arange(first, min(first + size, b * draws))
                    area, draw = which // draws, which % draws
                    own = keys[area] + draw.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
                    got = _ancestors(layers, fit, _uniforms(own, len(fit)))[:, by_id]
                    row, col = np.nonzero(got)
                    cells = pa.StructArray.from_arrays([pa.array(ids[col], pa.int32()), pa.array(got[row, col], pa.int32())], fields=list(cell))
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(which)))])
                    elems = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(area)), pa.array(draw, pa.int32()), elems], [key, "draw", "elems"])

    dealt = jobs.repartition(F.col("_counts"), F.pmod(F.xxhash64(key), F.lit(64))).sortWithinPartitions("_counts", key)
    return dealt.mapInArrow(run, f"{key} {kind}, draw int, elems array<struct<elem_id:int,n:int>>")


def instances(spark: SparkSession, capacities: list[int], dims: list[int]) -> tuple[DataFrame, DataFrame]:
    """Test instances of every number of dimensions d and capacity c: (elements: d, v, p) and (targets: c, d, counts).

    The elements are 2 e_i and e_i + e_j for i < j, all as likely; the counts are c in every dimension.
    """
    d = spark.createDataFrame([(x,) for x in dims], "d int").distinct()
    pairs = d.select("d", F.explode(F.sequence(F.lit(1), "d")).alias("i")).select("*", F.explode(F.sequence("i", "d")).alias("j"))
    v = F.transform(F.sequence(F.lit(1), F.col("d")), lambda x: (x == F.col("i")).cast("int") + (x == F.col("j")).cast("int"))
    elements = pairs.select("d", v.alias("v"), (F.lit(2.0) / (F.col("d") * (F.col("d") + 1))).alias("p"))
    c = spark.createDataFrame([(x,) for x in capacities], "c int").distinct()
    return elements, d.crossJoin(c).select("c", "d", F.array_repeat("c", F.col("d")).alias("counts"))  # two short lists of parameters


def best_over_grid(results: DataFrame, grid: DataFrame, by: list[str], param: str, value: str) -> DataFrame:
    """The least value of each ``by`` over the grid's parameters, and the parameter (the least of equals).

    A parameter without a result, or with a null one, counts as infinite; where none has one the parameter is null.
    """
    x = F.coalesce(F.col("_x").cast("double"), F.lit(math.inf))
    found = grid.select(*by, param).distinct().join(results.select(*by, param, F.col(value).alias("_x")), [*by, param], "left").withColumn("_x", x)
    least = found.groupBy(*by).agg(F.min(F.struct("_x", param)).alias("m"))
    return least.select(*by, F.when(F.col("m._x") < math.inf, F.col(f"m.{param}")).alias(param), F.col("m._x").alias(value))


def partition_function(targets: DataFrame, elements: DataFrame, key: str, counts: str) -> DataFrame:
    """(key, log_z); areas with the same counts are computed once, null counts give no row."""
    held = element_list(elements)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(log_z=[log_partition(tuple(int(x) for x in c), held) for c in pdf["_counts"]])

    return _each_once(targets, key, counts, run, "log_z double")


def likelihoods(solutions: DataFrame, counts: str, probs: str, out: str = "log_w") -> DataFrame:
    return solutions.withColumn(out, log_likelihood(counts, probs))
