"""Demonstration queries of vectors, the solver, chains, noise and swapping, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockweave.functions import bounds, chance, vectors
from blockweave.operators import chains, dist, noise, solve, spectrum, swap, transitions
from blockweave.operators.assemble import to_output
from blockweave.plans import town
from blockweave.plans.catalog_tables import UNI, Tables, r
from blockweave.sources import blocks as table_blocks
from blockweave.sources import households
from blockweave.sources.scratch import parts_of, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The toy instance: four household types of three counts, and an area with counts (5, 1, 5).
TOY = [((0, 1, 1), 0.25), ((1, 0, 1), 0.25), ((1, 1, 1), 0.25), ((2, 0, 1), 0.25)]
TOY_COUNTS = (5, 1, 5)


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def toy_elements(spark: SparkSession) -> DataFrame:
    return solve.lexicographic(spark.createDataFrame([(list(v), p) for v, p in TOY], "v array<int>, p double"))


def toy_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("toy", list(TOY_COUNTS))], "block string, counts array<int>")


# -- vectors of event counts per user: click, error, purchase, signup, view

KINDS = ("click", "error", "purchase", "signup", "view")
VEC_SQL = "SELECT user_id, [" + ", ".join(f"count(*) FILTER (event_type = '{k}')" for k in KINDS) + "] AS v FROM events GROUP BY 1"


def _vec(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array(*[F.count_if(F.col("event_type") == k) for k in KINDS]).alias("v"))


def text(c):
    """A vector as text: hashes of results need no nested types."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def sql_text(v: str) -> str:
    return f"array_to_string({v}, ',')"


@query(f"SELECT user_id, {sql_text('v')} AS v FROM ({VEC_SQL})")
def vector_encode(t):
    return _vec(t).select("user_id", text(F.col("v")).alias("v"))


@query(f"SELECT user_id, {sql_text('list_transform(range(5), lambda j: CASE WHEN j = user_id % 5 THEN 1 ELSE 0 END)')} AS v FROM (SELECT DISTINCT user_id FROM events)")
def one_hot(t):
    return t.events.select("user_id").distinct().select("user_id", text(vectors.one_hot(5, (F.col("user_id") % 5).cast("int"))).alias("v"))


RH_SQL = ", ".join(f"count(*) FILTER (l_linenumber = {1 + i % 7} AND l_returnflag {'=' if i < 7 else '<>'} 'N')" for i in range(14))


@query(f"""WITH a AS (SELECT l_suppkey, [{RH_SQL}] AS v, count(*) FILTER (l_linestatus = 'O') AS n18 FROM lineitem GROUP BY 1)
    SELECT l_suppkey, {sql_text("list_concat(list_transform(range(1, 8), lambda k: v[k] + v[k + 7]), [list_sum(v[8:14])::BIGINT, n18])")} AS v FROM a""")
def level_reduce(t):
    cells = [F.count_if((F.col("l_linenumber") == 1 + i % 7) & ((F.col("l_returnflag") == "N") == (i < 7))).cast("int") for i in range(14)]
    d = t.lineitem.groupBy("l_suppkey").agg(F.array(*cells, F.count_if(F.col("l_linestatus") == "O").cast("int"), F.lit(1)).alias("v"))
    return d.select("l_suppkey", text(to_output(F.col("v"), 2, True)).alias("v"))


@query(f"""SELECT user_id, round(list_product(list_transform(v, lambda x: x + 1.0)), 3) AS product, list_sum(v)::BIGINT AS total, {sql_text("list_transform(v, lambda x: x - 1)")} AS less, {sql_text("list_transform(v, lambda x: x * 3)")} AS thrice, list_min(v) > 0 AS all_positive, list_max(v) = 0 AS zero,
    list_sum(v)::BIGINT - len(v) AS slack FROM ({VEC_SQL})""")
def array_algebra(t):
    ones = F.array(*[F.lit(1).cast("long")] * 5)
    v = F.col("v")
    return _vec(t).select(
        "user_id", r(vectors.product(F.transform(v, lambda x: x + F.lit(1.0))), 3).alias("product"), vectors.total(v).alias("total"), text(vectors.minus(v, ones)).alias("less"),
        text(vectors.times(v, 3)).alias("thrice"), vectors.is_nonneg(vectors.minus(v, ones)).alias("all_positive"), vectors.is_zero(v).alias("zero"), vectors.slack(v, ones).alias("slack"),
    )


@query(f"SELECT a.user_id, b.k AS elem FROM ({VEC_SQL}) a, (VALUES (1, [1,0,0,0,1]), (2, [0,2,0,1,0]), (3, [2,2,2,2,2])) b(k, w) WHERE list_bool_and(list_transform(range(1, 6), lambda i: b.w[i] <= a.v[i]))")
def eligibility_filter(t):
    e = t.spark.createDataFrame([(1, [1, 0, 0, 0, 1]), (2, [0, 2, 0, 1, 0]), (3, [2, 2, 2, 2, 2])], "elem int, w array<bigint>")
    return _vec(t).join(F.broadcast(e), vectors.fits("w", "v")).select("user_id", "elem")  # three types


@query(f"SELECT user_id, CAST(least(v[1] // 2, v[3], v[5] // 3) AS BIGINT) AS most FROM ({VEC_SQL})")
def max_multiplicity(t):
    return _vec(t).select("user_id", vectors.max_multiplicity("v", F.array(*map(F.lit, (2, 0, 1, 0, 3)))).alias("most"))


LM = "lgamma(list_sum(v) + 1) - list_sum(list_transform(v, lambda x: lgamma(x + 1)))"


@query(f"SELECT user_id, round({LM}, 6) AS ln_orders FROM ({VEC_SQL})")
def log_multinomial(t):
    return _vec(t).select("user_id", r(vectors.log_multinomial("v")).alias("ln_orders"))


PROBS = (0.4, 0.05, 0.1, 0.15, 0.3)
LL = f"list_sum(list_transform(range(1, 6), lambda i: v[i] * ln([{', '.join(map(str, PROBS))}][i]))) + {LM}"


@query(f"SELECT user_id, round({LL}, 6) AS log_w FROM ({VEC_SQL})")
def log_likelihood(t):
    return _vec(t).select("user_id", r(vectors.log_likelihood("v", F.array(*map(F.lit, PROBS)))).alias("log_w"))


@query(f"SELECT user_id, round({LL} - 0.8 * (sum_all - list_sum(v)), 6) AS log_w FROM (SELECT *, max(list_sum(v)) OVER () AS sum_all FROM ({VEC_SQL}))")
def gamma_penalty(t):
    d = _vec(t).withColumn("s", vectors.total("v"))
    d = d.crossJoin(F.broadcast(d.agg(F.max("s").alias("most"))))  # one row
    return d.select("user_id", r(vectors.log_likelihood("v", F.array(*map(F.lit, PROBS))) - 0.8 * (F.col("most") - F.col("s"))).alias("log_w"))


LC = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1)"


@query(f"""SELECT user_id, round(least(list_sum(list_transform(range(1, 6), lambda i: {LC.format(n='v[i] + i + 1 - 1', k='i + 1 - 1')})), {LC.format(n='list_sum(v) + 20 - 1', k='19')}), 5) AS ln_bound FROM ({VEC_SQL})""")
def solution_bound(t):
    return _vec(t).select("user_id", r(vectors.ln_solution_bound("v", F.array(*map(F.lit, (2, 3, 4, 5, 6)))), 5).alias("ln_bound"))


@query(f"SELECT user_id, {sql_text('flatten(list_transform(range(1, 6), lambda i: list_transform(range(v[i]), lambda j: chr(CAST(96 + i AS INT)))))')} AS items FROM ({VEC_SQL})")
def multiset_expand(t):
    return _vec(t).select("user_id", F.array_join(vectors.expand_multiset(F.array(*map(F.lit, "abcde")), "v"), ",").alias("items"))


@query(f"SELECT {sql_text('v')} AS v, CAST(row_number() OVER (ORDER BY v) AS INT) AS elem_id FROM (SELECT DISTINCT v FROM ({VEC_SQL}))")
def lexi_order(t):
    return solve.lexicographic(_vec(t).select("v").distinct()).select(text(F.col("v")).alias("v"), "elem_id")


# -- records into groups, and groups into rows


@query("SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS grp FROM conversations")
def forward_fill_groups(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.sum((F.col("role") == "user").cast("int")).over(w).alias("grp"))


@query("""SELECT conv_id, grp, count(*) FILTER (role <> 'user') AS people, least(count(*), 7) AS size, max(length(text))::BIGINT AS longest FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations)
    GROUP BY 1, 2 HAVING count(*) FILTER (role <> 'user') > 0""")
def household_struct(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = t.conversations.withColumn("grp", F.sum((F.col("role") == "user").cast("int")).over(w))
    g = d.groupBy("conv_id", "grp").agg(F.count_if(F.col("role") != "user").alias("people"), F.least(F.count(F.lit(1)), F.lit(7)).alias("size"), F.max(F.char_length("text")).cast("long").alias("longest"))
    return g.filter("people > 0")


@query("SELECT l_orderkey, l_linenumber, i AS hh_num FROM lineitem, LATERAL (SELECT unnest(range(0, CAST(l_quantity AS BIGINT) // 10))::INT AS i)")
def explode_position(t):
    n = F.floor(F.col("l_quantity") / 10).cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.posexplode(F.array_repeat(F.lit(1), n)).alias("hh_num", "one")).drop("one")


@query("""SELECT o_orderkey, person, CASE WHEN person < k THEN 1 ELSE 0 END AS adult FROM (SELECT o_orderkey, o_custkey % 4 AS n, o_orderkey % 3 AS k FROM orders), LATERAL (SELECT unnest(range(0, n))::INT AS person)""")
def explode_persons(t):
    n, k = (F.col("o_custkey") % 4).cast("int"), (F.col("o_orderkey") % 3).cast("int")
    people = F.transform(F.sequence(F.lit(0), n), lambda i: (i < k).cast("int"))
    return t.orders.select("o_orderkey", F.posexplode(F.slice(people, F.lit(1), n)).alias("person", "adult"))


# -- the solver


@query("SELECT * FROM (VALUES ('toy', '0,4,1,0', round(ln(5), 6), 0.2::DOUBLE), ('toy', '1,3,0,1', round(ln(20), 6), 0.8::DOUBLE)) x(block, ms, ln_orders, p)")
def knapsack_enumerate(t):
    got = solve.solution_probs(solve.enumerate_solutions(toy_targets(t.spark), toy_elements(t.spark), "block", "counts"), "block")
    ms = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.coalesce(F.element_at(F.map_from_entries("elems"), i), F.lit(0)))
    return got.select("block", text(ms).alias("ms"), r(vectors.log_multinomial(ms)).alias("ln_orders"), r("p").alias("p"))


@query(f"""WITH RECURSIVE e(i, v) AS (VALUES {", ".join(f"({i}, {list(v)})" for i, (v, _) in enumerate(sorted(TOY), 1))}),
    w(i, rest, ms) AS (SELECT 0, {list(TOY_COUNTS)}, CAST([] AS INT[]) UNION ALL
      SELECT w.i + 1, list_transform(range(1, 4), lambda j: w.rest[j] - e.v[j] * k.k), list_append(w.ms, k.k) FROM w JOIN e ON e.i = w.i + 1 JOIN (SELECT unnest(range(0, 7))::INT AS k) k ON list_min(list_transform(range(1, 4), lambda j: w.rest[j] - e.v[j] * k.k)) >= 0)
    SELECT 'toy' AS block, {sql_text('ms')} AS ms FROM w WHERE i = 4 AND list_max(rest) = 0""")
def knapsack_recursive(t):
    toy_targets(t.spark).createOrReplaceTempView("_toy_targets")
    toy_elements(t.spark).createOrReplaceTempView("_toy_elements")
    return solve.recursive_solutions(t.spark, "_toy_targets", "_toy_elements").select("block", text(F.col("ms")).alias("ms"))


# areas from the data: an order's number of lines and its returned lines, to be made of three sizes of parcels
PARCELS = [((1, 0), 0.5), ((1, 1), 0.2), ((2, 1), 0.3)]
TARGET_SQL = "SELECT l_orderkey AS block, count(*) AS c1, count(*) FILTER (l_returnflag = 'R') AS c2 FROM lineitem GROUP BY 1"
# x parcels (1,0), y of (1,1), z of (2,1): x + y + 2z = c1, y + z = c2
SOL_SQL = f"SELECT block, c1 - c2 - z AS x, c2 - z AS y, z FROM (SELECT *, unnest(range(0, c2 + 1)) AS z FROM ({TARGET_SQL})) WHERE c1 - c2 - z >= 0"
COST_SQL = f"SELECT *, x * -ln(0.5) + y * -ln(0.2) + z * -ln(0.3) AS cost, -(x * -ln(0.5) + y * -ln(0.2) + z * -ln(0.3)) + lgamma(x + y + z + 1) - lgamma(x + 1) - lgamma(y + 1) - lgamma(z + 1) AS log_w FROM ({SOL_SQL})"


def _areas(t: Tables) -> DataFrame:
    n, back = F.count(F.lit(1)), F.count_if(F.col("l_returnflag") == "R")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("block")).agg(F.array(n.cast("int"), back.cast("int")).alias("counts"))


def _parcels(t: Tables) -> DataFrame:
    return solve.lexicographic(t.spark.createDataFrame([(list(v), p) for v, p in PARCELS], "v array<int>, p double"))


def _n(i: int):
    return F.when(F.col("elems").isNotNull(), F.coalesce(F.element_at(F.map_from_entries("elems"), i), F.lit(0)).cast("long"))


@query(f"SELECT block, CAST(rank AS INT) AS sol_rank, x, y, z, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY round(cost, 9), x DESC, y DESC) AS rank FROM ({COST_SQL})) WHERE rank <= 2")
def topn_solutions(t):
    got = solve.enumerate_solutions(_areas(t), _parcels(t), "block", "counts", n_best=2)
    return got.select("block", "sol_rank", _n(1).alias("x"), _n(2).alias("y"), _n(3).alias("z"), r("cost").alias("cost"))


# areas of a customer's orders in a quarter, the types of these orders: returned lines, other lines, and the order itself
_HOMES = """SELECT o_custkey * 100 + (year(o_orderdate) - 1990) * 4 + quarter(o_orderdate) - 1 AS block, r, m FROM orders JOIN
    (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R')::INT AS r, count(*) FILTER (l_returnflag <> 'R')::INT AS m FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""


@query(f"""WITH RECURSIVE homes AS ({_HOMES}),
    types AS (SELECT row_number() OVER (ORDER BY r, m) AS id, r, m, -ln(count(*)::DOUBLE / (SELECT count(*) FROM homes)) AS cost FROM homes GROUP BY r, m),
    areas AS (SELECT block, sum(r) AS r, sum(m) AS m, count(*) AS k FROM homes GROUP BY block),
    sets(k, ids, r, m, cost) AS (SELECT 0, CAST([] AS BIGINT[]), 0, 0, 0.0::DOUBLE UNION ALL
      SELECT s.k + 1, list_append(s.ids, t.id), s.r + t.r, s.m + t.m, s.cost + t.cost FROM sets s JOIN types t ON s.k = 0 OR t.id >= s.ids[s.k] WHERE s.k < (SELECT max(k) FROM areas)),
    ranked AS (SELECT block, row_number() OVER (PARTITION BY block ORDER BY round(cost, 9), list_transform(list_distinct(ids).list_sort(), lambda i: [i, -len(list_filter(ids, lambda j: j = i))])) AS sol_rank, ids, cost
      FROM areas JOIN sets USING (k, r, m))
    SELECT block, sol_rank::INT AS sol_rank, array_to_string(ids, ',') AS homes, round(cost, 6) AS cost FROM ranked WHERE sol_rank <= 10""")
def block_solutions(t):
    """The ten likeliest ways to make up each area of the types of all orders; SQL tries all multisets."""
    flags = [F.count_if(c).cast("int").alias(n) for n, c in (("r", F.col("l_returnflag") == "R"), ("m", F.col("l_returnflag") != "R"))]
    home = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*flags).select("o_orderkey", F.array("r", "m", F.lit(1)).alias("v"))
    block = (F.col("o_custkey") * 100 + (F.year("o_orderdate") - 1990) * 4 + F.quarter("o_orderdate") - 1).alias("block")
    homes = written(t.orders.join(home, "o_orderkey").select(block, "v"))
    areas = homes.groupBy("block").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(3)]).cast("array<int>").alias("counts"))
    got = solve.enumerate_solutions(areas, solve.lexicographic(dist.empirical(homes, ["v"])), "block", "counts", n_best=10)
    ids = F.flatten(F.transform("elems", lambda x: F.array_repeat(x.elem_id, x.n)))
    return got.select("block", "sol_rank", F.array_join(ids.cast("array<string>"), ",").alias("homes"), r("cost").alias("cost"))


@query(f"SELECT block, x, y, z, round(exp(log_w - m) / sum(exp(log_w - m)) OVER (PARTITION BY block), 6) AS p FROM (SELECT *, max(log_w) OVER (PARTITION BY block) AS m FROM ({COST_SQL}))")
def solution_probabilities(t):
    got = solve.solution_probs(solve.enumerate_solutions(_areas(t), _parcels(t), "block", "counts"), "block")
    return got.select("block", _n(1).alias("x"), _n(2).alias("y"), _n(3).alias("z"), r("p").alias("p"))


@query(f"SELECT block, round(m + ln(sum(exp(log_w - m - lgamma(x + y + z + 1)))), 6) AS log_z FROM (SELECT *, max(log_w) OVER (PARTITION BY block) AS m FROM ({COST_SQL})) GROUP BY block, m")
def dp_partition_function(t):
    return solve.partition_function(_areas(t), _parcels(t), "block", "counts").select("block", r("log_z").alias("log_z"))


@query(TARGET_SQL)
def partition_draws(t):
    """One draw for every area: its parcels add up to the area's counts."""
    got = solve.partition_draws(_areas(t), _parcels(t), "block", "counts", seed=7)
    x, y, z = _n(1), _n(2), _n(3)
    return got.select("block", (x + y + 2 * z).alias("c1"), (y + z).alias("c2"))


@query("SELECT d, c, count(*) AS n_elements, round(sum(2.0::DOUBLE / (d * (d + 1))), 6) AS p, sum(CASE WHEN i = j THEN 2 ELSE 0 END)::BIGINT AS twos FROM range(3, 7) a(d), range(4, 9, 2) b(c), LATERAL (SELECT unnest(range(1, d + 1)) AS i), range(1, 7) e(j) WHERE j BETWEEN i AND d GROUP BY 1, 2")
def knapsack_instances(t):
    elements, targets = solve.instances(t.spark, [4, 6, 8], [3, 4, 5, 6])
    most = F.array_max("v")
    return elements.join(targets, "d").groupBy(F.col("d").cast("long").alias("d"), F.col("c").cast("long").alias("c")).agg(F.count(F.lit(1)).alias("n_elements"), F.round(F.sum("p"), 6).alias("p"), F.sum(F.when(most == 2, 2).otherwise(0)).cast("long").alias("twos"))


@query("""WITH g AS (SELECT n_nationkey, c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)),
    x AS (SELECT c_nationkey, c_mktsegment, min(c_acctbal) AS m FROM customer WHERE c_acctbal > 9900 GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY coalesce(m, 'Infinity'::DOUBLE), g.c_mktsegment) AS rn FROM g LEFT JOIN x ON n_nationkey = c_nationkey AND g.c_mktsegment = x.c_mktsegment)
    SELECT n_nationkey, CASE WHEN m IS NOT NULL THEN c_mktsegment END AS c_mktsegment, round(m, 4) AS least FROM k WHERE rn = 1""")
def best_over_grid(t):
    found = t.customer.filter("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.min("c_acctbal").alias("least"))
    grid = t.nation.select("n_nationkey").crossJoin(t.customer.select("c_mktsegment").distinct())  # two short lists of parameters
    got = solve.best_over_grid(found, grid, ["n_nationkey"], "c_mktsegment", "least")
    return got.select("n_nationkey", "c_mktsegment", F.when(F.col("c_mktsegment").isNotNull(), r("least", 4)).alias("least"))


@query(f"""WITH a AS ({TARGET_SQL}), l1 AS (SELECT DISTINCT block FROM a WHERE c2 * 2 = c1 OR c2 = 0)
    SELECT block, CASE WHEN block IN (SELECT block FROM l1) THEN 1 WHEN c2 <= c1 AND c1 > c2 THEN 2 WHEN c1 <= 4 THEN 3 END AS level FROM a""")
def level_relaxation(t):
    """Level 1 has parcels (1,0) alone or (2,1) alone; level 2 needs one parcel (1,0) at least; level 3 only counts up to four lines."""
    spark = t.spark
    a = _areas(t).withColumn("c", F.col("counts"))
    only = F.when(F.col("c")[1] == 0, F.col("c")).when(F.col("c")[1] * 2 == F.col("c")[0], F.col("c")).otherwise(F.array(F.lit(0), F.lit(1)))
    two = F.when(F.col("c")[0] > F.col("c")[1], F.array(F.col("c")[0], F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    d = a.select("block", only.alias("k1"), two.alias("k2"), F.when(F.col("c")[0] <= 4, F.array(F.col("c")[0])).otherwise(F.array(F.lit(-1))).alias("k3"))
    e1 = solve.lexicographic(spark.createDataFrame([([1, 0], 0.5), ([2, 1], 0.5)], "v array<int>, p double"))
    e2 = solve.lexicographic(spark.createDataFrame([([1, 0], 0.5), ([1, 1], 0.5)], "v array<int>, p double"))
    e3 = solve.lexicographic(spark.createDataFrame([([1], 1.0)], "v array<int>, p double"))
    got = solve.relax(d, [(1, "k1", e1), (2, "k2", e2), (3, "k3", e3)], "block")
    undecided = F.col("level").isNotNull() & F.col("elems").isNull()
    return got.select("block", F.when(undecided, F.raise_error(F.lit("a search was cut off")).cast("int")).otherwise(F.col("level")).alias("level")).distinct()


# -- chains


def _distinct_areas(t: Tables) -> DataFrame:
    """(counts, area) of the distinct counts, which name the area; worked out from the lines once for all graphs of a query."""
    if "_areas_once" not in t.__dict__:
        c = F.col("counts")
        t._areas_once = written(_areas(t).select("counts", (c[0] * 100 + c[1]).cast("long").alias("area")).distinct())
    return t._areas_once


def _area_graph(t: Tables, kind: str, param: float) -> DataFrame:
    """The graphs of all areas; areas with the same counts have the same graph, named by the counts."""
    return transitions.transition_graphs(_distinct_areas(t), _parcels(t), "area", "counts", kind, param)


def _only(i: int):
    return lambda x: F.when(x == i, x)


def _parcel_text(elems: str):
    """How many parcels of each size a state has."""
    return F.concat_ws(",", *[F.size(F.array_compact(F.transform(elems, _only(i)))).cast("string") for i in (1, 2, 3)])


AREA_SQL = f"SELECT DISTINCT c1 * 100 + c2 AS area, c1, c2 FROM ({TARGET_SQL})"
WEIGHT = "x * ln(0.5) + y * ln(0.2) + z * ln(0.3) + lgamma(x + y + z + 1) - lgamma(x + 1) - lgamma(y + 1) - lgamma(z + 1)"


def _state_sql(gamma: float) -> str:
    """All multisets of parcels within the counts of an area: left_, lw (log weight), m (sizes that fit)."""
    return f"""SELECT *, {WEIGHT} - {gamma} * left_ AS lw, (c1 >= 1)::INT + (c1 >= 1 AND c2 >= 1)::INT + (c1 >= 2 AND c2 >= 1)::INT AS m
        FROM (SELECT *, c1 - x - y - 2 * z + c2 - y - z AS left_ FROM ({AREA_SQL}), LATERAL (SELECT unnest(range(0, c1 + 1)) AS x), LATERAL (SELECT unnest(range(0, c2 + 1)) AS y), LATERAL (SELECT unnest(range(0, c2 + 1)) AS z))
        WHERE x + y + 2 * z <= c1 AND y + z <= c2"""


def _line_sql(kind: str, gamma: float) -> str:
    """(area, src, dst, weight, lw, left_, left_to): moves between states that differ in one size, and loops."""
    weight = "exp(b.lw) / b.mass / (2 * a.m)" if kind == "gibbs" else "least(1.0, exp(b.lw - a.lw)) / (2 * a.m * a.most)"
    return f"""WITH s AS ({_state_sql(gamma)}), l AS (SELECT *, sum(exp(lw)) OVER (PARTITION BY area, e, k1, k2) AS mass FROM (
          SELECT *, 'x' AS e, y AS k1, z AS k2, x AS n, c1 AS most FROM s UNION ALL SELECT *, 'y', x, z, y, least(c1, c2) FROM s UNION ALL SELECT *, 'z', x, y, z, least(c1 // 2, c2) FROM s)),
        moves AS (SELECT a.area, concat_ws(',', a.x, a.y, a.z) AS src, concat_ws(',', b.x, b.y, b.z) AS dst, {weight} AS weight, a.lw, a.left_, b.left_ AS left_to FROM l a JOIN l b USING (area, e, k1, k2) WHERE a.n <> b.n)
        SELECT * FROM moves UNION ALL SELECT s.area, concat_ws(',', x, y, z) AS src, concat_ws(',', x, y, z), 1 - coalesce(out, 0), lw, left_, left_ FROM s
        LEFT JOIN (SELECT area, src, sum(weight) AS out FROM moves GROUP BY 1, 2) o ON o.area = s.area AND o.src = concat_ws(',', x, y, z)"""


# two parcels, or the only one, are taken out (rx, ry, rz) and refilled by (a - b - fz, b - fz, fz) of the same counts (a, b)
REDUCED_SQL = f"""WITH s AS (SELECT *, {WEIGHT} AS lw, x + y + z AS n, least(2, x + y + z) AS k FROM (SELECT area, c1 - c2 - z AS x, c2 - z AS y, z FROM ({AREA_SQL}), LATERAL (SELECT unnest(range(0, c2 + 1)) AS z)) WHERE x >= 0),
    r AS (SELECT *, rx + ry + 2 * rz AS a, ry + rz AS b FROM s, range(0, 3) u(rx), range(0, 3) v(ry), range(0, 3) w(rz) WHERE rx + ry + rz = k AND rx <= x AND ry <= y AND rz <= z),
    f AS (SELECT r.*, x - rx + a - b - fz AS tx, y - ry + b - fz AS ty, z - rz + fz AS tz FROM r, range(0, 5) q(fz) WHERE fz <= b AND fz <= a - b),
    g AS (SELECT f.*, s.lw AS lw_to, exp(s.lw) / sum(exp(s.lw)) OVER (PARTITION BY f.area, f.x, f.y, f.z, rx, ry, rz) AS p FROM f JOIN s ON s.area = f.area AND s.x = tx AND s.y = ty AND s.z = tz),
    moves AS (SELECT area, concat_ws(',', x, y, z) AS src, concat_ws(',', tx, ty, tz) AS dst, sum(p / (2 * CASE k WHEN 2 THEN n * (n - 1) / 2 ELSE 1 END)) AS weight, lw FROM g WHERE (x, y, z) <> (tx, ty, tz) GROUP BY ALL)
    SELECT * FROM moves UNION ALL SELECT s.area, concat_ws(',', x, y, z) AS src, concat_ws(',', x, y, z), 1 - coalesce(out, 0), lw FROM s LEFT JOIN (SELECT area, src, sum(weight) AS out FROM moves GROUP BY 1, 2) o ON o.area = s.area AND o.src = concat_ws(',', x, y, z)"""


def _edge_rows(g: DataFrame) -> DataFrame:
    return g.select("area", _parcel_text("elems_src").alias("src"), _parcel_text("elems_dst").alias("dst"), r("weight", 9).alias("weight"))


@query(f"SELECT area, src, dst, round(weight, 9) AS weight FROM ({REDUCED_SQL})")
def transition_graph(t):
    """The chain over exact solutions that refills two parcels, for the counts of all areas."""
    return _edge_rows(_area_graph(t, "reduced", 2))


@query(f"SELECT area, src, dst, round(weight, 9) AS weight FROM ({_line_sql('gibbs', 0.8)})")
def gibbs_graph(t):
    return _edge_rows(_area_graph(t, "gibbs", 0.8))


@query(f"SELECT area, src, dst, round(weight, 9) AS weight FROM ({_line_sql('simple', 0.8)})")
def simple_graph(t):
    return _edge_rows(_area_graph(t, "simple", 0.8))


@query(" UNION ALL ".join(f"SELECT area, {g}::DOUBLE AS gamma, count(*) AS num_states, count(*) FILTER (left_ = 0) AS num_solutions, round(coalesce(sum(exp(lw)) FILTER (left_ = 0), 0) / sum(exp(lw)), 9) AS density FROM ({_state_sql(g)}) GROUP BY 1" for g in (0.0, 1.0, 2.0)))
def frontier_expand(t):
    """All multisets within the counts of each area, and the share of exact ones, for three penalties on what is left."""
    parts = [chains.solution_density(_area_graph(t, "gibbs", g), ["area", "param"]) for g in (0.0, 1.0, 2.0)]
    d = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return d.select("area", F.col("param").alias("gamma"), "num_states", "num_solutions", r("solution_density", 9).alias("density"))


def _kept_sql(kind: str, edges: str) -> str:
    """Whether a step keeps the distribution by the states' weights; taking two parcels out does where all solutions have as many."""
    return f"""SELECT area, '{kind}' AS kind, count(*) AS num_states, max(abs(pi - q)) < 1e-12 AS stationary FROM (
        SELECT area, src, exp(lw) / sum(exp(lw)) OVER (PARTITION BY area) AS pi FROM (SELECT area, src, any_value(lw) AS lw FROM ({edges}) GROUP BY 1, 2)) p JOIN (
        SELECT area, dst AS src, sum(exp(lw) * weight) / any_value(total) AS q FROM ({edges}) JOIN (SELECT area, sum(lw) AS total FROM (SELECT area, src, any_value(exp(lw)) AS lw FROM ({edges}) GROUP BY 1, 2) GROUP BY 1) USING (area) GROUP BY 1, 2) USING (area, src) GROUP BY 1"""


@query(" UNION ALL ".join(_kept_sql(k, e) for k, e in (("reduced", REDUCED_SQL), ("gibbs", _line_sql("gibbs", 0.8)), ("simple", _line_sql("simple", 0.8)))))
def stationarity_check(t):
    """Which chains keep the distribution by their states' weights: the largest change of a step is rounding."""
    out = []
    for kind, param in (("reduced", 2.0), ("gibbs", 0.8), ("simple", 0.8)):
        g = _area_graph(t, kind, param)
        n = g.groupBy("area").agg(F.count_distinct("src").alias("num_states"))
        out.append(chains.stationarity_error(g, ["area"]).join(n, "area").select("area", F.lit(kind).alias("kind"), "num_states", (F.col("error") < 1e-12).alias("stationary")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(None)
def spectral_gaps(t):
    """Gaps of the reduced chains of all areas; pytest holds the operator against all eigenvalues."""
    d = spectrum.spectral_gaps(_area_graph(t, "reduced", 2), ["kind", "area"])
    return d.select("kind", "area", "num_states", "is_connected", r("spectral_gap").alias("spectral_gap"))


@query(f"""WITH e AS (SELECT *, exp(lw) AS w FROM ({_line_sql('gibbs', 0.8)})), p AS (SELECT area, src, any_value(left_) AS layer, any_value(w) AS w FROM e GROUP BY 1, 2),
    pi AS (SELECT *, w / sum(w) OVER (PARTITION BY area) AS pi FROM p), cut AS (SELECT area, layer AS l, sum(sum(pi)) OVER (PARTITION BY area ORDER BY layer) AS inside, row_number() OVER (PARTITION BY area ORDER BY layer DESC) AS rn FROM pi GROUP BY 1, 2),
    q AS (SELECT cut.area, l, inside, sum(pi.pi * e.weight) AS q FROM cut JOIN pi ON pi.area = cut.area AND pi.layer <= l JOIN e ON e.area = pi.area AND e.src = pi.src AND e.left_to > l WHERE rn > 1 GROUP BY ALL)
    SELECT area, round(min(q / least(inside, 1 - inside)), 6) AS conductance, round(min(q / (inside * (1 - inside))), 6) AS product_form FROM q GROUP BY 1""")
def layer_conductance(t):
    g = _area_graph(t, "gibbs", 0.8)
    a, b = chains.layer_conductance(g, ["area"]), chains.layer_conductance(g, ["area"], True)
    return a.join(b.withColumnRenamed("conductance", "product_form"), "area").select("area", r("conductance").alias("conductance"), r("product_form").alias("product_form"))


@query(f"SELECT DISTINCT area, 400::BIGINT AS n_steps, true AS near FROM ({AREA_SQL}) WHERE c2 <= c1")
def empirical_steps(t):
    """400 seeded steps of the sampler out of the likeliest solution of each area, against that state's row of the graph."""
    targets = _distinct_areas(t)
    graph = _area_graph(t, "reduced", 2)
    expand = lambda x: F.flatten(F.transform(x, lambda e: F.array_repeat(e.elem_id, e.n)))
    start = solve.enumerate_solutions(targets, _parcels(t), "area", "counts", n_best=1).select("area", expand("elems").alias("src"))
    made = chains.sample_chains(targets, _parcels(t), "area", "counts", steps=1, k=2, chains=400, seed=5).select("area", expand("elems").alias("dst"))
    far = transitions.empirical_row(made.join(start, "area"), graph, "area")
    return far.select("area", "n_steps", (F.col("tvd") < 0.12).alias("near"))


# pairs of solutions of an area, the likeliest and each other: what can go from the first so that the second remains possible
@query(f"""WITH s AS (SELECT area, c1 - c2 - z AS x, c2 - z AS y, z FROM ({AREA_SQL}), LATERAL (SELECT unnest(range(0, c2 + 1)) AS z) WHERE c1 - c2 - z >= 0),
    p AS (SELECT a.area, a.x, a.y, a.z, b.x AS bx, b.y AS bY2, b.z AS bz FROM s a JOIN s b ON a.area = b.area AND (a.x, a.y, a.z) <> (b.x, b.y, b.z))
    SELECT area, concat_ws(',', x, y, z) AS a, concat_ws(',', bx, bY2, bz) AS b, concat_ws(',', rx, ry, rz) AS removed, concat_ws(',', rx + ry + 2 * rz, ry + rz, rx + ry + rz) AS sub
    FROM p, range(0, 4) u(rx), range(0, 4) v(ry), range(0, 4) w(rz) WHERE rx + ry + rz = 3 AND rx <= x AND ry <= y AND rz <= z AND x - rx <= bx AND y - ry <= bY2 AND z - rz <= bz""")
def consistent_removals(t):
    """Removals of three parcels that lead from one solution of an area to another, for all pairs of solutions."""
    targets = _distinct_areas(t)
    found = solve.enumerate_solutions(targets, _parcels(t), "area", "counts")
    one = written(found.select("area", F.flatten(F.transform("elems", lambda e: F.array_repeat(e.elem_id, e.n))).alias("a")))
    pairs = one.join(one.withColumnRenamed("a", "b"), "area").filter("a <> b")
    parcels = _parcels(t).withColumn("v", F.concat("v", F.array(F.lit(1))))
    got = transitions.consistent_removals(pairs, parcels, "a", "b", 3)
    return got.select("area", *[_parcel_text(x).alias(x) for x in ("a", "b", "removed")], F.concat_ws(",", F.transform("sub", lambda x: x.cast("string"))).alias("sub"))


NEXT_SQL = "SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"


def _moves(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).filter("dst is not null")


@query(f"SELECT src, dst, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 9) AS weight FROM ({NEXT_SQL}) WHERE dst IS NOT NULL GROUP BY 1, 2")
def transition_matrix(t):
    n = _moves(t).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return n.select("src", "dst", r(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 9).alias("weight"))


EDGE_SQL = "SELECT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem"


def _bipartite(t: Tables) -> DataFrame:
    """Parts (even nodes) and the suppliers they were bought from (odd ones)."""
    pairs = t.lineitem.select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"))
    return pairs.repartition(parts_of(t.spark, t.lineitem.count()), "src", "dst").distinct()


@query(f"WITH RECURSIVE e AS (SELECT src, dst FROM ({EDGE_SQL}) UNION SELECT dst, src FROM ({EDGE_SQL})), w AS (SELECT 2::BIGINT AS node UNION SELECT dst FROM w JOIN e ON src = node) SELECT node FROM w")
def reachability(t):
    e = _bipartite(t)
    e = written(e)
    return chains.reachable(e.union(e.select("dst", "src")), t.spark.range(2, 3).withColumnRenamed("id", "node"))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({EDGE_SQL}) UNION SELECT dst, src FROM ({EDGE_SQL})), w(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM e
    UNION SELECT e.dst, min(w.component) FROM w JOIN e ON e.src = w.node JOIN recurring.w AS old ON old.node = e.dst WHERE w.component < old.component GROUP BY e.dst) SELECT node, component FROM w""")
def components(t):
    from blockweave.operators.graph import components as run

    return run(_bipartite(t))


@query(f"""WITH RECURSIVE n AS (SELECT src, dst, count(*) AS n FROM ({NEXT_SQL}) WHERE dst IS NOT NULL GROUP BY 1, 2), p AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM n), s AS (SELECT DISTINCT src AS k FROM p),
    x(i, k, m) AS (SELECT 0, k, 1.0::DOUBLE / (SELECT count(*) FROM s) FROM s UNION ALL SELECT i + 1, dst, sum(m * w) FROM x JOIN p ON k = src WHERE i < 20 GROUP BY i + 1, dst) SELECT k AS event_type, round(m, 9) AS mass FROM x WHERE i = 20""")
def power_iteration(t):
    from blockweave.operators.graph import power_iteration as run

    n = _moves(t).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    p = n.select("src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("src"))).alias("weight"))
    return run(p, 20).select(F.col("node").alias("event_type"), r("mass", 9).alias("mass"))


E_SQL = repr(bounds.EPSILON)


@query(f"""SELECT o_orderkey, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE floor((1 / gap - 1) * {math.log(1 / (2 * bounds.EPSILON))!r}) END AS lower, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE ceil(ln(n / {E_SQL}) / gap) END AS upper,
    round(floor((1 / gap - 1) * ln(3 / (4 * {E_SQL} * gap))) / (gap * (1 + 2 * {E_SQL} / 3)), 4) AS expected_lower FROM (SELECT o_orderkey, 1 + o_orderkey % 9 AS n, (1 + o_custkey % 97) / 101.0::DOUBLE AS gap FROM orders)""")
def mixing_bounds(t):
    d = t.orders.select("o_orderkey", (1 + F.col("o_orderkey") % 9).alias("n"), ((1 + F.col("o_custkey") % 97) / F.lit(101.0)).alias("gap"))
    g = F.col("gap")
    low, up = bounds.reduced_bounds(F.col("n"), g, g, F.lit(True))
    simple = bounds.simple_bounds(F.col("n"), g, g, g)
    return d.select("o_orderkey", low.alias("lower"), up.alias("upper"), r(simple[2], 4).alias("expected_lower"))


@query(None)
def mcmc_reduced(t):
    got = chains.sample_chains(_areas(t), _parcels(t), "block", "counts", seed=4)
    return got.select("block", "chain", "exact", F.to_json("elems").alias("elems"))


@query(None)
def mcmc_gibbs(t):
    got = chains.sample_chains(toy_targets(t.spark), toy_elements(t.spark), "block", "counts", kind="gibbs", steps=200, gamma=0.8, chains=50, seed=4)
    return got.groupBy("exact", F.to_json("elems").alias("elems")).agg(F.count(F.lit(1)).alias("n"))


@query(None)
def sample_distance(t):
    """How far the chains' samples are from the enumerated solutions."""
    want = solve.enumerate_solutions(toy_targets(t.spark), toy_elements(t.spark), "block", "counts")
    out = None
    for kind in ("reduced", "metropolis"):
        made = chains.sample_chains(toy_targets(t.spark), toy_elements(t.spark), "block", "counts", kind=kind, steps=500, chains=200, seed=4)
        one = chains.sample_tvd(made, want, "block").select("block", F.lit(kind).alias("kind"), "tvd")
        out = one if out is None else out.unionByName(one)
    return out


# -- noise


@query(f"""SELECT node, level, n, round(n - b * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)), 6) AS n_noised FROM (SELECT *, {UNI.format("'31|' || node || '|n'")} + 0.5 / 4294967296.0 AS u, 2.0 / (1.0 * CASE level WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 ELSE 0.5 END) AS b FROM
    (SELECT r_name AS node, 0 AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT n_name, 1, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT c_mktsegment, 2, count(*) FROM customer GROUP BY 1))""")
def laplace_noise(t):
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = [c.groupBy(F.col(k).alias("node")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(i)) for i, k in enumerate(("r_name", "n_name", "c_mktsegment"))]
    d = noise.add_noise(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["n"], 1.0, (0.2, 0.3, 0.5), 31)
    return d.select("node", "level", "n", r("n_noised").alias("n_noised"))


PAIR_SQL = "SELECT c_custkey, c_acctbal - 5000 AS t, (c_custkey * 7919 % 10007) - 5003.0::DOUBLE AS v FROM customer"


@query(f"SELECT c_custkey, round(CASE WHEN v > t THEN greatest((t + v) / 2, 0) ELSE greatest(t, 0) END, 4) AS total, round(CASE WHEN v > t THEN greatest((t + v) / 2, 0) ELSE greatest(v, 0) END, 4) AS part FROM ({PAIR_SQL})")
def project_pair(t):
    a, b = noise.project_pair(F.col("c_acctbal") - 5000, F.col("c_custkey") * 7919 % 10007 - 5003.0)
    return t.customer.select("c_custkey", r(a, 4).alias("total"), r(b, 4).alias("part"))


@query("""WITH d AS (SELECT c_nationkey, c_custkey, c_acctbal, 20000.0::DOUBLE AS total FROM customer), s AS (SELECT *, row_number() OVER w AS rn, (sum(c_acctbal) OVER w - total) / row_number() OVER w AS shift FROM d WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)),
    k AS (SELECT c_nationkey, arg_max(shift, rn) AS theta FROM s WHERE c_acctbal - shift > 0 GROUP BY 1) SELECT c_custkey, round(greatest(c_acctbal - theta, 0), 4) AS adjusted FROM d JOIN k USING (c_nationkey)""")
def simplex_projection(t):
    d = t.customer.select("c_nationkey", "c_custkey", "c_acctbal", F.lit(20000.0).alias("total"))
    return noise.simplex_projection(d, ["c_nationkey"], "c_acctbal", "total", "c_custkey").select("c_custkey", r("adjusted", 4).alias("adjusted"))


GEO = "lpad(cast(n_regionkey AS {s}), 2, '0') || lpad(cast(n_nationkey AS {s}), 3, '0') || lpad(cast(c_custkey % 3 AS {s}), 6, '0') || cast(c_custkey % 2 AS {s}) || '000'"


@query(f"""WITH l AS (SELECT {GEO.format(s="VARCHAR")} AS g, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT unnest([0, 1, 2, 3, 4])::INT AS level)
    SELECT level, g[1:[2, 5, 11, 12, 15][level + 1]] AS node, CASE WHEN level > 0 THEN g[1:[2, 5, 11, 12, 15][level]] END AS parent, count(*) AS n FROM l, p GROUP BY ALL""")
def rollup_levels(t):
    d = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.expr(GEO.format(s="string")).alias("g"), F.lit(1).alias("n"))
    return noise.rollup_levels(d, "g", ["n"]).select("level", "node", "parent", F.col("n").cast("long").alias("n"))


def _top_down(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves, true counts and adjusted counts of customers (tot) and of those with over 2000 (vap)."""
    d = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = d.select(F.concat(F.lit("01"), F.expr(GEO.format(s="string")).substr(3, 13)).alias("g"), F.lit(1).alias("tot"), (F.col("c_acctbal") > 2000).cast("int").alias("vap"))
    truth = written(noise.rollup_levels(leaves, "g", ["tot", "vap"]).withColumn("measure", F.lit("all")))
    nodes = noise.add_noise(truth, ["tot", "vap"], 1.0, noise.SPLITS["equal"], 5)
    done = noise.top_down(nodes.select("node", "parent", "level", "measure", F.col("tot_noised").alias("tot"), F.col("vap_noised").alias("vap")))
    return leaves, truth, done


@query(None)
def topdown_levels(t):
    return _top_down(t)[2].select("node", "level", r("tot", 4).alias("tot"), r("vap", 4).alias("vap"))


@query("SELECT c_mktsegment AS g, count(*)::DOUBLE AS tot, count(*) FILTER (c_acctbal > 2000)::DOUBLE AS vap, count(DISTINCT c_nationkey) AS nodes, true AS ordered FROM customer GROUP BY 1")
def l1_adjustment(t):
    """Noised counts of each segment's nations, adjusted to the segment's own with the least absolute change."""
    d = t.customer.groupBy(F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("tot"), F.count_if(F.col("c_acctbal") > 2000).alias("vap"))
    up = d.groupBy("g").agg(F.sum("tot").alias("tot_parent"), F.sum("vap").alias("vap_parent"))
    noised = d.withColumns({c: F.col(c) + chance.laplace(chance.uniform(c, "g", "node"), 4.0) for c in ("tot", "vap")})
    got = noise.adjust_children_l1(noised.join(up, "g"), ["g"], "node")
    fits = (F.col("vap") > -1e-6) & (F.col("vap") < F.col("tot") + 1e-6)
    return got.groupBy("g").agg(F.round(F.sum("tot"), 6).alias("tot"), F.round(F.sum("vap"), 6).alias("vap"), F.count(F.lit(1)).alias("nodes"), F.min(fits).alias("ordered"))


LEAF_SQL = f"SELECT '01' || substr({GEO.format(s='varchar')}, 3, 13) AS g, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"""WITH l AS ({LEAF_SQL}), n AS (SELECT k AS level, substr(g, 1, w) AS node, count(*) AS tot, count(*) FILTER (c_acctbal > 2000) AS vap FROM l, (VALUES (0, 2), (1, 5), (2, 11), (3, 12), (4, 15)) p(k, w) GROUP BY 1, 2)
    SELECT level, count(*) AS nodes, sum(tot)::BIGINT AS tot, sum(vap)::BIGINT AS vap, true AS ordered, true AS adds_up FROM n GROUP BY 1""")
def topdown_checks(t):
    """Adjusted counts and their errors: at each level, counts less errors are the true totals, 0 <= vap <= tot, and every parent's children add up to it."""
    _, truth, done = _top_down(t)
    told = written(noise.with_error(done, truth, ["tot", "vap"]).join(truth.select("node", "measure", "parent"), ["node", "measure"]))
    kids = told.groupBy(F.col("parent").alias("node")).agg(F.sum("tot").alias("t"), F.sum("vap").alias("v"))
    off = told.join(kids, "node", "left").withColumn("off", F.coalesce(F.greatest(F.abs(F.col("t") - F.col("tot")), F.abs(F.col("v") - F.col("vap"))), F.lit(0.0)))
    out = off.groupBy("level").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.round(F.sum(F.col("tot") - F.col("tot_error"))).cast("long").alias("tot"),
        F.round(F.sum(F.col("vap") - F.col("vap_error"))).cast("long").alias("vap"),
        F.min((F.col("vap") > -1e-6) & (F.col("vap") < F.col("tot") + 1e-6)).alias("ordered"),
        (F.max("off") < 1e-5).alias("adds_up"),
    )
    return out.withColumn("level", F.col("level").cast("int"))


@query(f"SELECT g, count(*) AS customers, count(*) FILTER (c_acctbal > 2000) AS rich, true AS all_fits FROM ({LEAF_SQL}) GROUP BY 1")
def topdown_leaves(t):
    """The adjusted leaves beside their blocks' own counts; no leaf is lost."""
    leaves, _, done = _top_down(t)
    blocks = leaves.groupBy("g").agg(F.sum("tot").cast("long").alias("customers"), F.sum("vap").cast("long").alias("rich"))
    out = noise.leaf_tables(done, blocks, "g", ["all"])
    return out.select("g", "customers", "rich", (F.col("all_vap") <= F.col("all_tot") + 1e-6).alias("all_fits"))


# -- swapping

PTS_SQL = "SELECT c_mktsegment AS b, c_nationkey AS g, c_custkey AS id, c_acctbal AS x, c_custkey * 7919 % 10007 + 0.0::DOUBLE AS y FROM customer"


def _points(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_mktsegment").alias("b"), F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("y"))


@query(f"WITH p AS ({PTS_SQL}) SELECT id, partner, CAST(rn AS INT) AS rank, round(d, 6) AS distance FROM (SELECT a.id, c.id AS partner, sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2), c.id) AS rn FROM p a JOIN p c ON a.b = c.b AND a.g = c.g AND a.id <> c.id WHERE (a.x - c.x) ** 2 + (a.y - c.y) ** 2 > 0) WHERE rn <= 3")
def knn_swap_candidates(t):
    return swap.nearest_partners(_points(t), ["b", "g"], "id", "x", "y", 3, 2000.0).select("id", "partner", "rank", r("distance").alias("distance"))


@query("SELECT floor(0.1 * count(*) / 2)::BIGINT * 2 AS swapped, floor(0.1 * count(*) / 2)::BIGINT * 2 AS distinct_rows, 0::BIGINT AS astray, 0::BIGINT AS one_sided FROM customer")
def greedy_swap(t):
    """A tenth of the customers swap: all pairs are disjoint, in one segment, of two nations, apart, and told from both sides."""
    d = _points(t).withColumn("prob", F.lit(0.5))
    pairs = written(swap.match_swaps(d, ["b"], "id", "g", "x", "y", "prob", 5, 0.1, 1, 2000.0))
    one, two = (d.select(F.col("id").alias(f"hh_{i}"), F.col("b").alias(f"b{i}"), F.col("g").alias(f"g{i}")) for i in (1, 2))
    wrong = pairs.join(one, "hh_1").join(two, "hh_2").filter("b1 <> b2 or g1 = g2 or distance <= 0")
    back = pairs.select(F.col("hh_1").alias("hh_2"), F.col("hh_2").alias("hh_1"), "distance")
    counts = pairs.agg(F.count(F.lit(1)).alias("swapped"), F.count_distinct("hh_1").alias("distinct_rows"))
    return counts.crossJoin(wrong.agg(F.count(F.lit(1)).alias("astray"))).crossJoin(pairs.exceptAll(back).agg(F.count(F.lit(1)).alias("one_sided")))  # one row each


@query("SELECT round(2 * 3958.7613 * asin(sqrt(sin(radians(b.la - a.la) / 2) ** 2 + cos(radians(a.la)) * cos(radians(b.la)) * sin(radians(b.lo - a.lo) / 2) ** 2)), 6) AS miles, a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT n_nationkey, n_nationkey * 3.0 - 30 AS la, n_nationkey * 7.0 - 80 AS lo FROM nation) a JOIN (SELECT n_nationkey, n_nationkey * 3.0 - 30 AS la, n_nationkey * 7.0 - 80 AS lo FROM nation) b ON a.n_nationkey < b.n_nationkey")
def pair_distance(t):
    n = t.nation.select("n_nationkey", (F.col("n_nationkey") * 3.0 - 30).alias("la"), (F.col("n_nationkey") * 7.0 - 80).alias("lo"))
    a, b = (n.select(F.col("n_nationkey").alias(s), F.col("la").alias(f"la{s}"), F.col("lo").alias(f"lo{s}")) for s in "ab")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select(r(swap.haversine_miles(F.col("laa"), F.col("loa"), F.col("lab"), F.col("lob"))).alias("miles"), "a", "b")  # 25 nations


@query("SELECT c.c_custkey, coalesce(p.c_nationkey, c.c_nationkey) AS c_nationkey, p.c_custkey IS NOT NULL AS swapped FROM customer c LEFT JOIN customer p ON c.c_custkey % 10 IN (0, 1) AND p.c_custkey = CASE c.c_custkey % 10 WHEN 0 THEN c.c_custkey + 1 ELSE c.c_custkey - 1 END")
def swap_apply(t):
    c = t.customer.select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    pairs = c.filter(k % 10 < 2).select(k.alias("hh_1"), F.when(k % 10 == 0, k + 1).otherwise(k - 1).alias("hh_2"))
    return swap.apply_swaps(c, pairs, "c_custkey", ["c_nationkey"])


@query(f"SELECT o_orderkey, round(-2.0 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)), 6) AS noise FROM (SELECT o_orderkey, {UNI.format(chr(39) + '13|' + chr(39) + ' || o_orderkey')} + 0.5 / 4294967296.0 AS u FROM orders)")
def laplace_draws(t):
    return t.orders.select("o_orderkey", r(chance.laplace(chance.uniform(13, "o_orderkey"), 2.0)).alias("noise"))


@query(None)
def household_pipeline(t):
    """The whole plan on made-up blocks and households whose counts come from the customers of a nation."""
    from blockweave.plans.demo import demo_microdata

    return demo_microdata(t.spark, t.customer)


# the town: customers are blocks, their orders households, the orders' lines people
PEOPLE_SQL = """SELECT o_orderkey, o_custkey, l_linenumber AS nth, CASE WHEN l_partkey % 29 = 0 THEN 2 ELSE ([1, 1, 1, 1, 1, 1, 2, 2, 6, 11])[(o_orderkey + o_custkey) % 10 + 1] END AS code, (o_orderkey % 8 = 0)::INT AS eth,
    CASE WHEN l_linenumber <= 1 + o_orderkey % 2 OR o_orderkey % 5 = 0 THEN 20 + l_partkey % 60 ELSE l_partkey % 18 END AS age, o_orderkey % 4 + 1 AS family FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber <= 7"""
RACE_SQL = "CASE code WHEN 6 THEN 4 WHEN 11 THEN 7 ELSE code END"


def _people(t: Tables) -> DataFrame:
    """Lines of an order that have the same number follow each other as in the table: its files by name, then their rows."""
    return town.people_of(t.orders, t.lineitem.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("at")))


def _list(column: str):
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string")))


@query(f"""WITH p AS (SELECT *, {RACE_SQL} AS race FROM ({PEOPLE_SQL})), h AS (SELECT o_orderkey, arg_min(race, nth) AS holder_race, min(eth) AS holder_eth, count(*) AS size, min(family) AS family, CASE WHEN count(*) = 1 AND o_orderkey % 9 = 0 THEN 1 ELSE count(*) FILTER (age >= 18) END AS n_adults,
      {", ".join(f"count(*) FILTER (race = {k} AND eth = {e}) AS c{e}{k}" for e in (0, 1) for k in range(1, 8))} FROM p GROUP BY 1)
    SELECT concat_ws(',', {", ".join(f"c{e}{k}" for e in (0, 1) for k in range(1, 8))}) AS rh, n_adults::INT AS n_adults, holder_race::INT AS holder_race, holder_eth::INT AS holder_eth, family <= 3 AND size > 1 AS is_family, least(size, 7)::INT AS size_7, count(*) AS n,
      count(*) FILTER (o_orderkey % 9 = 0 AND n_adults < size) AS contradict FROM h GROUP BY ALL""")
def microdata_scan(t):
    """The household types of all orders, written as text files of header and person records and read back in splits."""
    homes = written(households.parse_households(town.record_lines(t.spark, _people(t))))
    wrong = households.check_ages(homes).select("file", "hh", F.lit(1).alias("wrong"))
    d = households.household_tuple(homes.join(wrong, ["file", "hh"], "left"))
    return d.groupBy(_list("rh").alias("rh"), "n_adults", "holder_race", "holder_eth", "is_family", "size_7").agg(F.count(F.lit(1)).alias("n"), F.count("wrong").alias("contradict"))


@query(f"""WITH p AS (SELECT * REPLACE (CASE WHEN o_orderkey % 9 = 0 AND count(*) OVER (PARTITION BY o_orderkey) = 1 THEN greatest(age, 18) ELSE age END AS age), {RACE_SQL} AS race FROM ({PEOPLE_SQL}) WHERE o_orderkey % 3 = 0), h AS (SELECT o_orderkey, concat_ws(',', {", ".join(f"count(*) FILTER (race = {k})" for k in range(1, 8))}, sum(eth)::INT, count(*) FILTER (age >= 18)) AS key,
      string_agg(concat(race, eth, (age >= 18)::INT), ',' ORDER BY race, eth, age >= 18) AS people FROM p GROUP BY 1)
    SELECT key, people, round(count(*) / sum(count(*)) OVER (PARTITION BY key), 9) AS p FROM h GROUP BY 1, 2""")
def people_lists(t):
    """For each 9-vector of the sample's households the lists of (race, ethnicity, adult) that it stands for."""
    lists = households.people_by_type(households.parse_households(town.record_lines(t.spark, _people(t).filter(town.is_sample()))))
    text = F.concat_ws(",", F.transform("people", lambda x: F.concat(x.race, x.eth, x.adult)))
    return lists.select(_list("key").alias("key"), text.alias("people"), r("p", 9).alias("p"))


@query(f"""WITH p AS (SELECT *, {RACE_SQL} AS race FROM ({PEOPLE_SQL})), h AS (SELECT o_custkey, o_orderkey, arg_min(race, nth) AS holder, count(*) AS size, count(*) FILTER (age >= 18) AS adults, sum(eth) AS hisp FROM p GROUP BY 1, 2),
    b AS (SELECT o_custkey AS c, sum(size)::INT AS people, count(*)::INT AS homes, sum(adults)::INT AS adults, sum(hisp)::INT AS hispanic FROM h GROUP BY 1)
    SELECT printf('%03d-%06d-%04d', c // 1000000, c % 1000000 // 1000, c % 1000) AS identifier, people, homes, adults, hispanic, c % 7 <> 0 AS age_valid, 0 AS age_gap, 0 AS err FROM b""")
def block_csv_scan(t):
    """The block table of all customers, written as a CSV file with a header and read back with its check columns."""
    blocks, _ = town.read_town(written(_people(t)))
    told = table_blocks.validate(blocks)
    hispanic = sum((F.col(c) for c in table_blocks.race_by_ethnicity()[7:]), F.lit(0))
    d = blocks.select("identifier", F.col("H7X001").alias("people"), F.col("H8M001").alias("homes"), F.col("H8A003").alias("adults"), hispanic.alias("hispanic"), table_blocks.age_is_valid().alias("age_valid"))
    return d.join(told.select("identifier", "age_gap", "err"), "identifier")
