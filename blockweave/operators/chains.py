"""Markov chains over solutions: analysis of their graphs, and samplers.

Each area's chain is independent of the others, so areas run in parallel and a chain's own steps inside one task.
States are multiplicity vectors over the elements that fit the area's counts.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockweave.functions import chance
from blockweave.sources.scratch import parts_of, written

from .dist import empirical, tvd
from .solve import MAX_NODES, element_list, search, solution_probs

MAX_STATES = 20_000
#: A removal with so many refills or more is declined.
MAX_REFILLS = 300
#: States with so many distinct removals at most get their whole row of the chain.  This decides cost, never chances.
ROW_REMOVALS = 2_000
#: and only once they have been met this share of their removals' number: a row solves all of them.
MET_OFTEN = 0.25
#: Chains that meet so many states at most are moved all their steps at once, by the power of their matrix.
LAW_STATES = 300


def log_prob(x: np.ndarray, logp: np.ndarray) -> float:
    return float(x @ logp) + math.lgamma(x.sum() + 1) - sum(math.lgamma(k + 1) for k in x)


def eligible(counts: np.ndarray, elements: list) -> tuple[np.ndarray, np.ndarray]:
    fit = [(v, math.log(p)) for _, v, p in elements if all(np.array(v) <= counts)]
    return np.array([v for v, _ in fit]).reshape(len(fit), len(counts)), np.array([lp for _, lp in fit])


def exact_states(counts: np.ndarray, v: np.ndarray, logp: np.ndarray, max_nodes: int = MAX_NODES, limit: int | None = None) -> list[tuple[int, ...]]:
    """All exact solutions; an error where they fill the pool (``limit``, else MAX_STATES) or the search was cut off."""
    limit = limit or MAX_STATES
    best, ended = search(tuple(counts), [(i, tuple(x), math.exp(lp)) for i, (x, lp) in enumerate(zip(v, logp, strict=True))], limit, max_nodes)
    if not ended or len(best) >= limit:
        raise OverflowError("too many states")
    return sorted(tuple(sol.get(i, 0) for i in range(len(v))) for _, sol in best)


def partial_states(counts: np.ndarray, v: np.ndarray) -> list[tuple[int, ...]]:
    """All multisets within the counts; every one can be reached from the empty one."""
    states: list[tuple[tuple[int, ...], np.ndarray]] = [((), counts)]
    for x in v:
        states = [((*s, n), left - n * x) for s, left in states for n in range(int((left[x > 0] // x[x > 0]).min()) + 1)]
        if len(states) > MAX_STATES:
            raise OverflowError("too many states")
    return sorted(s for s, _ in states)


def solution_density(edges: DataFrame, group: list[str]) -> DataFrame:
    """Share of the stationary mass on exact solutions, and their number."""
    nodes = edges.groupBy(*group, "src").agg(F.max("log_pi_src").alias("l"), F.max("left_src").alias("left"))
    top = nodes.withColumn("e", F.exp(F.col("l") - F.max("l").over(Window.partitionBy(*group))))
    exact = F.col("left") == 0
    return top.groupBy(*group).agg(F.count(F.lit(1)).alias("num_states"), F.sum(exact.cast("long")).alias("num_solutions"), (F.sum(F.when(exact, F.col("e")).otherwise(0.0)) / F.sum("e")).alias("solution_density"))


def stationarity_error(edges: DataFrame, group: list[str]) -> DataFrame:
    """Largest |(pi P)(x) - pi(x)| of each graph for pi from the states' weights: an edge join, no matrix."""
    nodes = edges.groupBy(*group, "src").agg(F.max("log_pi_src").alias("l"))
    e = F.exp(F.col("l") - F.max("l").over(Window.partitionBy(*group)))
    pi = nodes.withColumn("_e", e).withColumn("pi", F.col("_e") / F.sum("_e").over(Window.partitionBy(*group))).select(*group, "src", "pi")
    moved = edges.select(*group, "src", "dst", "weight").join(pi, [*group, "src"]).groupBy(*group, F.col("dst").alias("src")).agg(F.sum(F.col("pi") * F.col("weight")).alias("q"))
    return pi.join(moved, [*group, "src"], "left").groupBy(*group).agg(F.max(F.abs(F.col("pi") - F.coalesce("q", F.lit(0.0)))).alias("error"))


def layer_conductance(edges: DataFrame, group: list[str], product_form: bool = False) -> DataFrame:
    """Least conductance over the cuts by what is left of the counts (states with at most l against the others)."""
    nodes = edges.groupBy(*group, "src").agg(F.max("log_pi_src").alias("l"), F.max("left_src").alias("layer"))
    e = F.exp(F.col("l") - F.max("l").over(Window.partitionBy(*group)))
    pi = nodes.withColumn("_e", e).withColumn("pi", F.col("_e") / F.sum("_e").over(Window.partitionBy(*group))).select(*group, "src", "layer", "pi")
    mass = pi.groupBy(*group, "layer").agg(F.sum("pi").alias("m"))
    w = Window.partitionBy(*group).orderBy("layer")
    mass = mass.withColumn("inside", F.sum("m").over(w)).withColumn("next", F.lead("layer").over(w)).filter("next is not null")
    out = edges.filter("left_dst > left_src").join(pi.select(*group, "src", "pi"), [*group, "src"])
    cross = out.groupBy(*group, "left_src", "left_dst").agg(F.sum(F.col("pi") * F.col("weight")).alias("q"))
    cut = mass.join(cross, group, "left").filter("left_src <= layer and left_dst > layer").groupBy(*group, "layer", "inside").agg(F.sum("q").alias("q"))
    inside = F.col("inside")
    base = inside * (1 - inside) if product_form else F.least(inside, 1 - inside)
    return cut.groupBy(*group).agg(F.min(F.col("q") / base).alias("conductance"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reachable from ``start`` (node): the frontier joins the edges until it is empty; the edges and each frontier are written once."""
    fronts, edges = [start.select("node").distinct()], written(edges.select("src", "dst"))
    n = parts_of(edges.sparkSession, edges.count())
    while True:
        near = fronts[-1].repartition(n, "node").join(edges.repartition(n, "src"), F.col("node") == F.col("src"))
        step = near.select(F.col("dst").alias("node")).distinct()
        front = written(step.join(reduce(DataFrame.union, fronts), "node", "left_anti"))
        if front.isEmpty():
            return reduce(DataFrame.union, fronts)
        fronts.append(front)


def refills(sub: np.ndarray, v: np.ndarray, logp: np.ndarray, memo: dict) -> list[tuple[int, ...]]:
    """All ways to make up the counts of a removal; none where there are MAX_REFILLS or more.

    Such a removal is declined.  So is the way back, which takes out as much: the chain keeps its distribution.
    """
    key = tuple(sub)
    if key not in memo:
        try:
            memo[key] = exact_states(sub, v, logp, limit=MAX_REFILLS)
        except OverflowError:
            memo[key] = []
    return memo[key]


def chain_rng(seed: int, key) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())])


def removal_count(x: tuple[int, ...], k: int) -> float:
    """How many distinct removals of k elements x has; infinite where a part of x has over ROW_REMOVALS."""
    ways, kk = [1], min(k, sum(x))
    for m in x:
        ways = [sum(ways[max(0, j - m) : j + 1]) for j in range(min(kk, len(ways) - 1 + m) + 1)]
        if max(ways) > ROW_REMOVALS:
            return math.inf
    return ways[kk] if kk < len(ways) else 0


def chain_row(x: tuple[int, ...], v: np.ndarray, logp: np.ndarray, k: int, by_ratio: bool, memo: dict) -> tuple[list[float], list[tuple[int, ...]]] | None:
    """Running chances and targets of a step from x that is not lazy; none where x has too many removals.

    By likelihood (reduced), or each refill as likely and taken by the ratio of likelihoods (metropolis).
    """
    n = sum(x)
    kk = min(k, n)
    if removal_count(x, k) > ROW_REMOVALS:
        return None
    removals = [((), kk)]
    for m in x:
        removals = [((*r, j), left - j) for r, left in removals for j in range(min(m, left) + 1)]
        if len(removals) > 4 * ROW_REMOVALS:
            return None
    chance: dict[tuple[int, ...], float] = {}
    here, log_here = np.array(x), log_prob(np.array(x), logp)
    for r, left in removals:
        if left:
            continue
        out = np.array(r, int)
        if not (fills := refills(out @ v, v, logp, memo)):
            continue
        to = [tuple(int(a) for a in here - out + np.array(f)) for f in fills]
        lw = np.array([log_prob(np.array(t), logp) for t in to])
        w = np.exp(np.minimum(0.0, lw - log_here)) / len(to) if by_ratio else np.exp(lw - lw.max()) / np.exp(lw - lw.max()).sum()
        for t, p in zip(to, w, strict=True):
            if t != x:
                chance[t] = chance.get(t, 0.0) + float(p) / math.comb(n, kk)
    return np.cumsum(list(chance.values())).tolist(), list(chance)


def run_exact(x: np.ndarray, v: np.ndarray, logp: np.ndarray, k: int, steps: int, rng: np.random.Generator, memo: dict, kind: str) -> np.ndarray:
    """``steps`` steps of a lazy chain on exact solutions: those that are not lazy, each a look-up in its state's row once the state has been met a few times."""
    rows, met, move = memo.setdefault(("rows", kind), {}), memo.setdefault(("met", kind), {}), MOVES[kind]
    now = tuple(int(a) for a in x)
    for u in rng.random(int(rng.binomial(steps, 0.5))).tolist():
        if now not in rows:
            met[now] = met.get(now, 0) + 1
            if met[now] >= MET_OFTEN * math.comb(sum(now), min(k, sum(now))):
                rows[now] = chain_row(now, v, logp, k, kind == "metropolis", memo)
        if (row := rows.get(now)) is None:
            now = tuple(int(a) for a in move(np.array(now), v, logp, k, rng, memo))
        elif (i := bisect.bisect_right(row[0], u)) < len(row[1]):
            now = row[1][i]
    return np.array(now)


def end_law(x: tuple[int, ...], v: np.ndarray, logp: np.ndarray, k: int, steps: int, kind: str, most: float, memo: dict) -> list[tuple[float, tuple[int, ...]]] | None:
    """(running chance, state) of where the lazy chain on exact solutions is ``steps`` steps after x; the last running chance is 1.

    The rows of all states that it can meet make its matrix, whose power has the chances.  None where that takes over ``most``
    removals or over LAW_STATES states: such a chain is walked.
    """
    number, rows, front, spent, depth = {x: 0}, [], [x], 0, 0
    while front and depth < steps:
        then = []
        for state in front:
            spent += removal_count(state, k)
            if spent > most or (row := chain_row(state, v, logp, k, kind == "metropolis", memo)) is None:
                return None
            rows.append((number[state], row))
            for t in row[1]:
                if t not in number:
                    number[t] = len(number)
                    then.append(t)
            if len(number) > LAW_STATES:
                return None
        front, depth = then, depth + 1
    p = np.eye(len(number))
    for i, (total, to) in rows:
        for t, w in zip(to, np.diff([0.0, *total]).tolist(), strict=True):
            p[i, number[t]] += w / 2
            p[i, i] -= w / 2
    at, left = np.eye(len(number))[0], steps
    while left:
        if left & 1:
            at = at @ p
        left >>= 1
        if left:
            p = p @ p
            p /= p.sum(axis=1, keepdims=True)
    at = np.maximum(at, 0.0)
    met = [(s, w) for s, w in sorted(zip(number, at.tolist(), strict=True)) if w > 0]
    total = np.cumsum([w for _, w in met])
    return [*zip((total[:-1] / total[-1]).tolist(), [s for s, _ in met], strict=False), (1.0, met[-1][0])]


def _refills(x: np.ndarray, v: np.ndarray, logp: np.ndarray, k: int, rng: np.random.Generator, memo: dict) -> list[np.ndarray]:
    """All states that agree with x up to a removal of k elements, uniform over distinct ones; none where it is declined."""
    bag = np.repeat(np.arange(len(x)), x)
    r = np.bincount(rng.choice(bag, min(k, len(bag)), replace=False), minlength=len(x))
    ways = math.prod(math.comb(int(a), int(b)) for a, b in zip(x, r, strict=True))
    if rng.random() >= 1 / ways:
        return []
    return [x - r + np.array(f) for f in refills(r @ v, v, logp, memo)]


def reduced_move(x: np.ndarray, v: np.ndarray, logp: np.ndarray, k: int, rng: np.random.Generator, memo: dict) -> np.ndarray:
    """One step of the reduced chain that is not lazy: a removal, and a refill by likelihood."""
    if not (to := _refills(x, v, logp, k, rng, memo)):
        return x
    lw = np.array([log_prob(t, logp) for t in to])
    w = np.exp(lw - lw.max())
    return to[int(rng.choice(len(to), p=w / w.sum()))]


def metropolis_move(x: np.ndarray, v: np.ndarray, logp: np.ndarray, k: int, rng: np.random.Generator, memo: dict) -> np.ndarray:
    """The same with a refill uniform over all, taken by the ratio of likelihoods."""
    if not (to := _refills(x, v, logp, k, rng, memo)):
        return x
    y = to[int(rng.integers(len(to)))]
    return y if rng.random() < math.exp(min(0.0, log_prob(y, logp) - log_prob(x, logp))) else x


def gibbs_step(x: np.ndarray, counts: np.ndarray, v: np.ndarray, logp: np.ndarray, gamma: float, rng: np.random.Generator) -> np.ndarray:
    """One lazy heat-bath step; weights grow by w_j = w_(j-1) (s + j) / j p exp(gamma |v|)."""
    if rng.random() < 0.5:
        return x
    e = int(rng.integers(len(v)))
    x = x.copy()
    x[e] = 0
    left = counts - x @ v
    most = int((left[v[e] > 0] // v[e][v[e] > 0]).min())
    lw, s = [0.0], int(x.sum())
    for j in range(1, most + 1):
        lw.append(lw[-1] + math.log((s + j) / j) + logp[e] + gamma * float(v[e].sum()))
    w = np.exp(np.array(lw) - max(lw))
    x[e] = int(rng.choice(most + 1, p=w / w.sum()))
    return x


def simple_step(x: np.ndarray, counts: np.ndarray, v: np.ndarray, logp: np.ndarray, gamma: float, rng: np.random.Generator) -> np.ndarray:
    """One lazy Metropolis step: another multiplicity of one element is proposed and taken by the ratio of weights."""
    if rng.random() < 0.5:
        return x
    e = int(rng.integers(len(v)))
    most = int((counts[v[e] > 0] // v[e][v[e] > 0]).min())
    y = x.copy()
    y[e] = (x[e] + 1 + int(rng.integers(most))) % (most + 1)
    if (y @ v > counts).any():
        return x
    ratio = log_prob(y, logp) - log_prob(x, logp) + gamma * float((y - x) @ v.sum(1))
    return y if rng.random() < math.exp(min(0.0, ratio)) else x


MOVES: dict[str, Callable] = {"reduced": reduced_move, "metropolis": metropolis_move}
STEPS: dict[str, Callable] = {"gibbs": gibbs_step, "simple": simple_step}


ELEMS = "array<struct<elem_id:int,n:int>>"


def sample_chains(targets: DataFrame, elements: DataFrame, key: str, counts: str, kind: str = "reduced", steps: int = 10_000, k: int = 3, gamma: float = 0.8, chains: int = 1, seed: int = 0, max_nodes: int = MAX_NODES, start: str | None = None) -> DataFrame:
    """(key, chain, elems, exact): the state of each chain after ``steps`` steps, as elements with their multiplicities.

    The chain advances from ``start`` on (a column of exact solutions as enumerate_solutions gives them) or else, in the kinds
    on exact solutions, from the likeliest.  Kinds reduced and metropolis stay on exact solutions; gibbs and simple
    go on until they are exact, for at most ten times the steps.
    Areas with the same counts and start have the same chances of where a chain on exact solutions ends: these are computed once where
    the chain meets few states (``end_law``), and each chain's end is drawn from them; other chains are walked step by step.
    An area without an exact solution has no rows in the kinds on exact ones; one whose search for a start was cut off is an error.
    Null counts have no rows.
    """
    held, on_exact = element_list(elements), kind in MOVES
    kind_ = targets.schema[key].dataType.simpleString()
    began = F.lit(None).cast(ELEMS) if start is None else F.col(start).cast(ELEMS)
    own = targets.filter(F.col(counts).isNotNull()).select(key, F.col(counts).cast("array<int>").alias("_counts"), began.alias("_start"))
    dealt = F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain")
    if not on_exact:
        return _walked(own.select("*", dealt), held, key, kind_, kind, steps, k, gamma, seed)

    def laws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memos: dict = {}  # sub-problems by the set of elements that fit
        for pdf in batches:
            rows = []
            for c, given in zip(pdf["_counts"], pdf["_start"], strict=True):
                c = np.array(c, int)
                v, logp = eligible(c, held)
                names = [e for e, x, _ in held if all(np.array(x) <= c)]
                if given is not None:
                    first = {names.index(e["elem_id"]): e["n"] for e in given}
                else:
                    best, ended = search(tuple(c), [(i, tuple(x), math.exp(lp)) for i, (x, lp) in enumerate(zip(v, logp, strict=True))], 1, max_nodes)
                    if not best and not ended:
                        raise OverflowError(f"the search for a solution of {c.tolist()} was cut off")
                    if not best:
                        continue
                    first = best[0][1]
                elems = lambda x, names=names: [{"elem_id": e, "n": int(i)} for e, i in zip(names, x, strict=True) if i]
                x, memo = tuple(int(first.get(i, 0)) for i in range(len(v))), memos.setdefault(tuple(names), {})
                if len(memo) > 100_000:
                    memo.clear()
                found = end_law(x, v, logp, k, steps, kind, steps * chains / 2, memo)
                rows.append((c.tolist(), given, elems(x), None if found is None else [{"upto": u, "elems": elems(s)} for u, s in found]))
            yield pd.DataFrame(rows, columns=["_counts", "_start", "_from", "law"])

    own = written(own)
    once = own.select("_counts", "_start").distinct().repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_counts", "_start")
    known = written(once.mapInPandas(laws, f"_counts array<int>, _start {ELEMS}, _from {ELEMS}, law array<struct<upto:double,elems:{ELEMS}>>"))
    same = (own["_counts"] == known["_counts"]) & own["_start"].eqNullSafe(known["_start"])
    jobs = own.join(known, same).select(key, own["_counts"], F.col("_from").alias("_start"), "law", dealt)
    ends = F.filter("law", lambda s: s["upto"] > F.col("_u"))
    drawn = jobs.filter("law is not null").withColumn("_u", chance.uniform_52(seed, key, "chain"))
    drawn = drawn.select(key, F.col("chain").cast("int").alias("chain"), ends[0]["elems"].alias("elems"), F.lit(True).alias("exact"))
    if known.filter("law is null").isEmpty():
        return drawn
    return drawn.unionByName(_walked(jobs.filter("law is null").drop("law"), held, key, kind_, kind, steps, k, gamma, seed))


def _walked(jobs: DataFrame, held: list, key: str, key_type: str, kind: str, steps: int, k: int, gamma: float, seed: int) -> DataFrame:
    """The chains of ``jobs`` (key, _counts, _start, chain), step by step: from _start in the kinds on exact solutions, else from nothing."""
    step = STEPS.get(kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memos: dict = {}  # sub-problems by the set of elements that fit
        for pdf in batches:
            rows = []
            for kv, c, given, chain in zip(pdf[key], pdf["_counts"], pdf["_start"], pdf["chain"], strict=True):
                c = np.array(c, int)
                v, logp = eligible(c, held)
                names = [e for e, x, _ in held if all(np.array(x) <= c)]
                rng = chain_rng(seed, f"{kv}|{chain}")
                if step is None:
                    first, memo = {names.index(e["elem_id"]): e["n"] for e in given}, memos.setdefault(tuple(names), {})
                    x = np.array([first.get(i, 0) for i in range(len(v))])
                    if len(memo) > 100_000 or len(memo.get(("met", kind), {})) > 100_000:
                        memo.clear()
                    x = run_exact(x, v, logp, k, steps, rng, memo, kind)
                else:
                    x = np.zeros(len(v), int)
                    for t in range(steps * 10 if len(v) else 0):
                        if t >= steps and (x @ v == c).all():
                            break
                        x = step(x, c, v, logp, gamma, rng)
                rows.append((kv, chain, [{"elem_id": e, "n": int(i)} for e, i in zip(names, x, strict=True) if i], bool((x @ v == c).all()) if len(v) else not c.any()))
            yield pd.DataFrame(rows, columns=[key, "chain", "elems", "exact"])

    return jobs.repartition(key, "chain").mapInPandas(run, f"{key} {key_type}, chain int, elems {ELEMS}, exact boolean")


def sample_tvd(samples: DataFrame, solutions: DataFrame, key: str) -> DataFrame:
    """(key, tvd) between each area's exact samples and its enumerated solutions weighed by likelihood.

    ``samples`` has the columns of sample_chains or partition_draws, ``solutions`` those of enumerate_solutions.
    """
    state = F.to_json(F.array_sort("elems")).alias("state")
    exact = samples.filter("exact") if "exact" in samples.columns else samples
    drawn = empirical(exact.select(key, state), ["state"], within=[key])
    return tvd(drawn, solution_probs(solutions.filter("elems is not null"), key).select(key, state, "p"), ["state"], [key])
