"""Disclosure-avoidance swapping: risk classes, nearest partners, and the exchange of geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockweave.functions.chance import uniform
from blockweave.sources.scratch import parts_of, written

#: Share of the rows in each risk class, riskiest first, and the chance of a swap in it.
RISK_SHARES = {4: 0.05, 3: 0.15, 2: 0.3, 1: 0.5}
SWAP_PROBS = {4: 1.0, 3: 0.6, 2: 0.3, 1: 0.1}
#: A search for k partners begins in cells of at most CROWD x k points, or after HALVINGS halvings of the cell size.
CROWD, HALVINGS = 4, 12


def frequency(df: DataFrame, flags: list[str], out: str = "frequency") -> DataFrame:
    """How many rows share the flags; counts are combined first and joined back."""
    counts = df.groupBy(*flags).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, flags)


def flag_risk(df: DataFrame, flags: list[str], size: str, key: str, shares: dict[int, float] | None = None, probs: dict[int, float] | None = None) -> DataFrame:
    """``frequency``, ``risk`` and ``prob``: rows in ascending (frequency, size, key) are cut into classes of the given shares.

    The place of a row is exact: rows are ranked inside ranges of that order, and shifted by the rows of the ranges
    before, so rows of one frequency are many tasks.
    """
    shares, probs = shares or RISK_SHARES, probs or SWAP_PROBS
    d = written(frequency(df, flags).repartitionByRange("frequency", size, key).withColumn("_b", F.spark_partition_id()))
    per = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    all_rows = Window.partitionBy(F.lit(0))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(all_rows.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(all_rows))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("frequency", size, key))).join(per.drop("_n"), "_b")
    place = F.col("_before") + F.col("_r")
    names = sorted(shares, reverse=True)
    risk: Column = F.lit(names[-1])
    edge: Column = F.lit(0)
    edges = []
    for name in names[:-1]:
        edge = edge + F.floor(F.col("_total") * shares[name])
        edges.append((name, edge))
    for name, e in reversed(edges):
        risk = F.when(place <= e, name).otherwise(risk)
    chance = F.create_map(*[F.lit(x) for k, v in probs.items() for x in (k, float(v))])
    return d.withColumn("risk", risk).withColumn("prob", chance[F.col("risk")]).drop("_b", "_r", "_before", "_total")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in a distinct order: ranges are ranked on their own and shifted by the rows of the ranges before."""
    d = written(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))
    per = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    per = per.select("_b", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = d.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order))).join(per, "_b")
    return ranked.filter(F.col("_before") + F.col("_r") <= n).drop("_b", "_r", "_before")


def _least_keys(points: DataFrame, site: list[str], key: str, k: int) -> DataFrame:
    """The k least keys of each site, first of parts of it: a site with many rows is many tasks."""
    parts = Window.partitionBy(*site, F.pmod(F.xxhash64(key), F.lit(64))).orderBy(key)
    few = points.withColumn("_r", F.row_number().over(parts)).filter(F.col("_r") <= k).drop("_r")
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(*site).orderBy(key))).filter(F.col("_r") <= k).drop("_r")


def nearest_partners(points: DataFrame, bucket: list[str], key: str, x: str, y: str, k: int, cell: float, apart: str | None = None, asking: DataFrame | None = None) -> DataFrame:
    """(key, partner, distance, rank) of the k nearest other points at a distance over zero with the same bucket.

    Partners differ in ``apart``, where given; ``asking`` (key) are the points that look for partners, all where not given.  Points that
    lie together are one site: sites are compared, each stands for its k least keys, and what a site finds holds for all its points.
    Only sites in the 3 x 3 cells around one are compared.  A site begins with the widest cells, from ``cell`` on by halves, of which its
    own holds CROWD x k points at most; where there are fewer than k points within one cell size, its search is repeated with cells
    twice as wide, until all are found or a cell holds the whole bucket.
    """
    size = lambda level: F.lit(float(cell)) * F.pow(F.lit(2.0), -F.col(level).cast("double"))
    at = lambda c, level: F.floor(F.col(c) / size(level))
    site = [*bucket, *([apart] if apart else []), x, y]
    pts = written(points.select(*site, key))
    shown = written(_least_keys(pts, site, key, k))
    span = pts.groupBy(*bucket).agg(F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("_span"))
    todo = written((pts if asking is None else pts.join(asking.select(key), key, "left_semi")).select(*site).distinct().withColumn("_site", F.xxhash64(*site)))
    if todo.groupBy("_site").count().filter("count > 1").limit(1).count():
        raise RuntimeError("two sites share a name")
    every = F.explode(F.array(*map(F.lit, range(HALVINGS + 1)))).alias("_j")
    cells = [*bucket, "_j", "_cx", "_cy"]
    placed = lambda d, *keep: d.select(*bucket, x, y, *keep, every).withColumn("_cx", at(x, "_j")).withColumn("_cy", at(y, "_j"))
    crowds = written(placed(shown).groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")))
    over = crowds.filter(F.col("_n") > CROWD * k).select(*cells)
    # a point's cells grow emptier with each halving: as many of them are too full as it needs halvings
    need = placed(todo, "_site").join(over, cells, "left_semi").groupBy("_site").agg(F.least(F.count(F.lit(1)), F.lit(HALVINGS)).cast("int").alias("_need"))
    todo = written(todo.join(need, "_site", "left").join(span, bucket).withColumn("_j", F.coalesce("_need", F.lit(0))).drop("_need"))
    out = None
    while True:
        levels = sorted(r._j for r in todo.select("_j").distinct().collect())  # HALVINGS + 1 at most at first
        grid = shown.select(*bucket, *([F.col(apart).alias("_apart")] if apart else []), F.col(key).alias("partner"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(F.array(*map(F.lit, levels or [0]))).alias("_j"))
        grid = grid.withColumn("_cx", at("_x", "_j")).withColumn("_cy", at("_y", "_j"))
        around = todo.withColumn("_bx", at(x, "_j")).withColumn("_by", at(y, "_j"))
        around = around.withColumn("_dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("_dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        around = around.withColumn("_cx", F.col("_bx") + F.col("_dx")).withColumn("_cy", F.col("_by") + F.col("_dy"))
        d = F.sqrt(F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2))
        n = parts_of(pts.sparkSession, 18 * todo.count())  # nine cells a site, with a few points each
        around = around.drop("_bx", "_by", "_dx", "_dy").repartition(n, *cells)
        near = around.join(grid.repartition(n, *cells), cells).withColumn("distance", d).filter("distance > 0")
        near = near.filter((F.col("distance") <= size("_j")) | (F.col("_span") <= size("_j")))
        if apart:
            near = near.filter(F.col(apart) != F.col("_apart"))
        w = Window.partitionBy("_site").orderBy("distance", "partner")
        near = written(near.select("_site", "partner", "distance", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k))
        # certain: k within one cell, or everything there is was compared
        full = near.groupBy("_site").agg(F.count(F.lit(1)).alias("_c"), F.max("distance").alias("_far"))
        sure = ((F.coalesce("_c", F.lit(0)) >= k) & (F.col("_far") <= size("_j"))) | (F.col("_span") <= size("_j"))
        state = written(todo.join(full, "_site", "left").select("_site", F.coalesce(sure, F.lit(False)).alias("_sure")))
        got = written(near.join(state.filter("_sure"), "_site", "left_semi"))
        out = got if out is None else out.unionByName(got)
        todo = written(todo.join(state.filter("not _sure"), "_site", "left_semi").withColumn("_j", F.col("_j") - 1))
        if todo.isEmpty():
            break
    askers = pts if asking is None else pts.join(asking.select(key), key, "left_semi")
    return askers.select(key, F.xxhash64(*site).alias("_site")).join(out, "_site").select(key, "partner", "distance", "rank")


def match_swaps(df: DataFrame, bucket: list[str], key: str, group: str, x: str, y: str, prob: str, k: int, rate: float, seed: int, cell: float) -> DataFrame:
    """Pairs (hh_1, hh_2, distance), both ways round: rows that swap, until ``rate`` of all rows (an even number, rounded down) are in a pair.

    A row starts a swap where its seeded uniform is below ``prob``.  In each round every such row that is still free proposes to one of its k
    nearest free rows at a distance over zero with the same bucket and another block ``group``, however far; of the proposals that meet in a row
    the one with the least seeded number stands, and a pair is made where it stands at both ends.  Each round makes a pair as long as there are proposals; a
    row without a partner is left.  Rounds are joins and sums, so no bucket is one task; pairs differ from a sequential pass.
    """
    rows = written(df.select(*bucket, key, group, x, y, prob))
    wanted = int(rate * rows.count()) // 2
    starts = written(rows.filter(uniform(seed, key) < F.col(prob)).select(key))
    pairs, made, turn = None, 0, 0
    free = rows
    while made < wanted:
        found = written(nearest_partners(free, bucket, key, x, y, k, cell, apart=group, asking=starts))
        most = found.groupBy(key).agg(F.max("rank").alias("_n"))
        pick = F.floor(uniform(seed, F.lit(f"partner {turn}"), key) * F.col("_n")) + 1
        asked = found.join(most, key).filter(F.col("rank") == pick)
        asked = written(asked.select(F.col(key).alias("a"), F.col("partner").alias("b"), "distance", uniform(seed, F.lit(f"turn {turn}"), key).alias("u")))
        ends = asked.select(F.col("a").alias("e"), "u", "a").union(asked.select("b", "u", "a"))
        best = ends.groupBy("e").agg(F.min(F.struct("u", "a")).alias("m"))
        stands = asked.join(best.withColumnRenamed("e", "a").withColumnRenamed("m", "ma"), "a").join(best.withColumnRenamed("e", "b").withColumnRenamed("m", "mb"), "b")
        stands = written(stands.filter("ma.a = a and mb.a = a").select("a", "b", "distance", "u"))
        n = stands.count()
        if n == 0:
            break
        if made + n > wanted:
            stands = first_rows(stands, ["u", "a"], wanted - made)
        stands = written(stands.select(F.col("a").alias("hh_1"), F.col("b").alias("hh_2"), "distance"))
        pairs = stands if pairs is None else pairs.unionByName(stands)
        made += min(n, wanted - made)
        turn += 1
        taken = stands.select(F.col("hh_1").alias(key)).union(stands.select("hh_2"))
        free = written(free.join(taken, key, "left_anti"))
        starts = written(starts.join(taken, key, "left_anti"))
    if pairs is None:
        blank = rows.select(F.col(key).alias("hh_1"), F.col(key).alias("hh_2"), F.lit(0.0).alias("distance"))
        return blank.limit(0)
    return pairs.unionByName(pairs.select(F.col("hh_2").alias("hh_1"), F.col("hh_1").alias("hh_2"), "distance"))


def apply_swaps(df: DataFrame, pairs: DataFrame, key: str, geography: list[str]) -> DataFrame:
    """Swapped rows take their partner's geography; ``swapped`` marks them."""
    partner = df.select(F.col(key).alias("hh_2"), *[F.col(c).alias(f"_{c}") for c in geography])
    moves = pairs.select("hh_1", "hh_2").join(partner, "hh_2")
    out = df.join(moves.withColumnRenamed("hh_1", key), key, "left")
    swapped = F.col("hh_2").isNotNull()
    return out.select(*[F.when(swapped, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in geography else F.col(c) for c in df.columns], swapped.alias("swapped"))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 3958.7613 * F.asin(F.sqrt(a))
