"""Demonstration queries of the relational operators on the star-schema tables, each with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.functions import chance, keys, report
from blockweave.operators import audit, dist, pick, stats, swap
from blockweave.sources import shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy readers of one folder's tables: ``t.orders`` is a scan of orders.parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None):
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# -- scans, projections, keys


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 0 AND l_discount >= 0.05")
def scan_filter(t):
    return t.lineitem.filter("l_quantity > 0 AND l_discount >= 0.05").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def project_prefix(t):
    df = t.lineitem
    keep = [c for c in df.columns if c in ("l_orderkey", "l_linenumber") or c[:4] in ("l_re", "l_sh") or c == "l_linestatus"]
    return df.select(*keep)


KEY_SQL = "printf('%03d-%06d-%04d', c_nationkey, c_custkey, o_orderkey % 10000)"


def _keyed(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return d.select("o_orderkey", keys.padded_key([("c_nationkey", 3), ("c_custkey", 6), (F.col("o_orderkey") % 10000, 4)]).alias("identifier"))


@query(f"SELECT o_orderkey, {KEY_SQL} AS identifier FROM orders JOIN customer ON o_custkey = c_custkey")
def composite_key(t):
    return _keyed(t)


@query(f"SELECT o_orderkey, CAST(split_part(k, '-', 1) AS INT) AS a, CAST(split_part(k, '-', 2) AS INT) AS b, regexp_replace(k, '-[0-9]+$', '') AS stem FROM (SELECT o_orderkey, {KEY_SQL} AS k FROM orders JOIN customer ON o_custkey = c_custkey)")
def key_split(t):
    return _keyed(t).select("o_orderkey", keys.key_part("identifier", 0).alias("a"), keys.key_part("identifier", 1).alias("b"), keys.strip_suffix("identifier").alias("stem"))


@query("""SELECT n_regionkey, n_nationkey, c_custkey, CAST(grouping(n_regionkey)*4 + grouping(n_nationkey)*2 + grouping(c_custkey) AS BIGINT) AS gid, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey, c_custkey)""")
def geo_prefix_rollup(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return d.rollup("n_regionkey", "n_nationkey", "c_custkey").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN gap > 0.01 THEN 1 ELSE 0 END)::BIGINT AS mismatches, sum(CASE WHEN lines = 0 THEN 1 ELSE 0 END)::BIGINT AS empty, round(avg(CASE WHEN gap > 0.01 OR lines = 0 THEN 1.0 ELSE 0.0 END), 6) AS err_rate
    FROM (SELECT o_orderkey, o_orderstatus, abs(o_totalprice - coalesce(sum(l_extendedprice), 0)) AS gap, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus, o_totalprice) GROUP BY 1""")
def consistency_check(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("lines"))
    d = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderstatus", F.abs(F.col("o_totalprice") - F.coalesce("s", F.lit(0.0))).alias("gap"), F.coalesce("lines", F.lit(0)).alias("lines"))
    bad, none = F.col("gap") > 0.01, F.col("lines") == 0
    return d.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("mismatches"), F.sum(none.cast("long")).alias("empty"), r(F.avg(F.when(bad | none, 1.0).otherwise(0.0))).alias("err_rate"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def unpivot_positive(t):
    kinds = ["click", "error", "purchase", "signup", "view"]
    most = int(t.spark.conf.get("spark.sql.pivotMaxValues"))
    found = [x[0] for x in t.events.select("event_type").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError("more event types than a pivot takes")
    wide = t.events.groupBy("user_id").pivot("event_type", sorted({*kinds, *found})).count().na.fill(0)
    return wide.unpivot("user_id", wide.columns[1:], "event_type", "n").filter("n > 0")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def set_ops(t):
    return t.customer.select(F.col("c_custkey").alias("id")).intersect(t.orders.filter("o_totalprice > 100000").select("o_custkey"))


@query("""SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1""")
def multiset_diff(t):
    even, odd = (t.orders.filter(F.col("o_orderkey") % 2 == i).select("o_custkey", "o_orderpriority") for i in (0, 1))
    return even.exceptAll(odd)


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def conditional_zero(t):
    return t.customer.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


@query(r"SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/?(.*)$', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/?(.*)$', 2) AS host FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)/?(.*)$')")
def regex_params(t):
    got = t.pages.select("page_id", *shards.name_params(F.col("url"), r"^(https?)://([^/]+)/?(.*)$", ["scheme", "host", "path"]))
    return got.filter("scheme is not null").select("page_id", "scheme", "host")


# -- completeness


@query("""SELECT u.user_id, e.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) e
    WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = u.user_id AND x.event_type = e.event_type)""")
def completeness_audit(t):
    have = t.events.select("user_id", "event_type").distinct()
    kinds = t.events.select("event_type").distinct()
    return audit.missing(have.select("user_id").distinct().crossJoin(F.broadcast(kinds)), have, ["user_id", "event_type"])  # five types


@query("""SELECT event_type, low, points, CASE WHEN low > (SELECT min(user_id % 7) FROM events) THEN 'disconnected' WHEN points < (SELECT count(DISTINCT user_id % 7) FROM events) THEN 'incomplete' ELSE 'complete' END AS status
    FROM (SELECT event_type, min(user_id % 7) AS low, count(DISTINCT user_id % 7) AS points FROM events WHERE value > 90 OR user_id % 7 > 2 GROUP BY 1)""")
def classify_series(t):
    d = t.events.select("event_type", (F.col("user_id") % 7).alias("k"), "value")
    grid = d.agg(F.min("k").alias("lo"), F.count_distinct("k").alias("np"))
    per = d.filter("value > 90 or k > 2").groupBy("event_type").agg(F.min("k").alias("low"), F.count_distinct("k").alias("points"))
    status = F.when(F.col("low") > F.col("lo"), "disconnected").when(F.col("points") < F.col("np"), "incomplete").otherwise("complete")
    return per.crossJoin(F.broadcast(grid)).select("event_type", "low", "points", status.alias("status"))


@query("SELECT r_name, c.s AS c_mktsegment FROM region, (SELECT DISTINCT c_mktsegment AS s FROM customer) c")
def param_grid(t):
    return audit.param_grid(r_name=t.region.select("r_name"), c_mktsegment=t.customer.select("c_mktsegment").distinct())


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_anti_join(t):
    done = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return audit.resume(t.orders.select("o_orderkey"), done, ["o_orderkey"])


@query("""WITH e AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 1), a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 200000), f AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0)
    SELECT coalesce(e.id, f.id) AS id, CASE WHEN e.id IS NULL THEN 'unknown failure' WHEN a.id IS NOT NULL THEN 'done' WHEN f.id IS NOT NULL THEN 'failed' ELSE 'unfinished' END AS status
    FROM e LEFT JOIN a ON e.id = a.id FULL JOIN f ON e.id = f.id""")
def reconcile_jobs(t):
    c = t.customer.withColumnRenamed("c_custkey", "id")
    done = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("id"))
    return audit.reconcile(c.filter("id % 3 <> 1"), done, c.filter("c_acctbal < 0"), ["id"])


UNI = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0"


@query(f"""SELECT o_orderkey, CAST(slot AS BIGINT) AS slot, CAST(floor(slot / ceil(n / 7.0)) AS BIGINT) AS task FROM
    (SELECT o_orderkey, row_number() OVER (ORDER BY {UNI.format("'3|' || o_orderkey")}, o_orderkey) - 1 AS slot, count(*) OVER () AS n FROM orders)""")
def task_slices(t):
    return pick.task_slices(t.orders.select("o_orderkey"), 7, 3, "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice, part FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY part DESC) AS rn FROM
    (SELECT o_orderkey, o_totalprice, 1 AS part FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, round(o_totalprice * 2, 2), 2 FROM orders WHERE o_orderkey % 3 <> 1)) WHERE rn = 1""")
def dedup_last(t):
    a = t.orders.filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_totalprice", F.lit(1).alias("part"))
    b = t.orders.filter("o_orderkey % 3 <> 1").select("o_orderkey", r(F.col("o_totalprice") * 2, 2).alias("o_totalprice"), F.lit(2).alias("part"))
    return pick.last_wins(a.unionByName(b), ["o_orderkey"], "part")


@query("SELECT src, count(*) AS n FROM (SELECT 'c' AS src FROM customer UNION ALL SELECT 's' FROM supplier UNION ALL SELECT 'p' FROM part) GROUP BY 1")
def multi_source_union(t):
    parts = [d.select(F.lit(s).alias("src")) for s, d in (("c", t.customer), ("s", t.supplier), ("p", t.part))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


# -- joins


FLAGS_SQL = "l_returnflag, l_linestatus, CAST(floor(l_quantity / 10) AS BIGINT)"


def _flags(t):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t.lineitem.select(key.alias("id"), "l_returnflag", "l_linestatus", F.floor(F.col("l_quantity") / 10).alias("q"), "l_extendedprice")


@query(f"SELECT l_orderkey * 10 + l_linenumber AS id, count(*) OVER (PARTITION BY {FLAGS_SQL}) AS frequency FROM lineitem")
def frequency_window(t):
    return swap.frequency(_flags(t), ["l_returnflag", "l_linestatus", "q"]).select("id", "frequency")


@query(f"""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice, count(*) OVER (PARTITION BY {FLAGS_SQL}) AS frequency, count(*) OVER () AS n FROM lineitem),
    p AS (SELECT *, row_number() OVER (ORDER BY frequency, l_extendedprice, id) AS place FROM f),
    k AS (SELECT id, frequency, CASE WHEN place <= floor(n * 0.05) THEN 4 WHEN place <= floor(n * 0.05) + floor(n * 0.15) THEN 3 WHEN place <= floor(n * 0.05) + floor(n * 0.15) + floor(n * 0.3) THEN 2 ELSE 1 END AS risk FROM p)
    SELECT id, frequency, risk, CASE risk WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.6::DOUBLE WHEN 2 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS prob FROM k""")
def risk_flag(t):
    return swap.flag_risk(_flags(t), ["l_returnflag", "l_linestatus", "q"], "l_extendedprice", "id").select("id", "frequency", "risk", "prob")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_join_validate(t):
    right = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return audit.join_checked(t.orders.select("o_orderkey", "o_custkey"), right, ["o_custkey"], "left", "m:1").select("o_orderkey", "c_mktsegment")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def inner_join_validate(t):
    right = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    return audit.join_checked(t.nation, right, ["n_regionkey"], "inner", "m:1").select("n_name", "r_name")


@query("""WITH y AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, round(abs(coalesce(b.s, 0) - coalesce(a.s, 0)), 2) AS change, CAST(sign(coalesce(b.n, 0) - coalesce(a.n, 0)) AS INT) AS direction
    FROM (SELECT * FROM y WHERE y = 1995) a FULL JOIN (SELECT * FROM y WHERE y = 1996) b ON a.k = b.k""")
def before_after(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("y", F.year("o_orderdate"))
    sums = d.filter("y in (1995, 1996)").groupBy(F.col("c_nationkey").alias("nation")).agg(
        *[f(F.when(F.col("y") == y, v)).alias(name) for y, tag in ((1995, "before"), (1996, "after")) for f, v, name in ((F.count, F.lit(1), f"n_{tag}"), (F.sum, F.col("o_totalprice"), f"s_{tag}"))]
    )
    change = F.abs(F.coalesce("s_after", F.lit(0.0)) - F.coalesce("s_before", F.lit(0.0)))
    return sums.select("nation", "n_before", "n_after", r(change, 2).alias("change"), F.signum(F.col("n_after") - F.col("n_before")).cast("int").alias("direction"))


@query("""SELECT a.n_name AS src, b.n_name AS dst, count(*) AS n, round(sum(CASE WHEN a.n_regionkey <> b.n_regionkey THEN 1 ELSE 0 END) / 2.0, 6) AS crossing
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY 1, 2""")
def pair_source_dest(t):
    na = F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src"), F.col("n_regionkey").alias("ra")))
    nb = F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"), F.col("n_regionkey").alias("rb")))
    d = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    d = d.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    d = d.groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(na, "s_nationkey").join(nb, "c_nationkey")
    return d.select("src", "dst", "n", r(F.when(F.col("ra") != F.col("rb"), F.col("n")).otherwise(0) / 2.0).alias("crossing"))


@query("""SELECT a.k AS custkey, round(b.s / a.s, 6) AS ratio FROM (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k""")
def ratio_join(t):
    a, b = (t.orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("custkey")).agg(F.sum("o_totalprice").alias(s)) for s in "FO")
    return a.join(b, "custkey").select("custkey", r(F.col("O") / F.col("F")).alias("ratio"))


# -- distributions


@query("SELECT l_returnflag, l_linestatus, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM lineitem GROUP BY 1, 2")
def empirical_dist(t):
    return dist.empirical(t.lineitem, ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", r("p", 9).alias("p"))


@query("SELECT o_orderpriority, round(exp(x - max(x) OVER ()) / sum(exp(x - m)) OVER (), 9) AS p FROM (SELECT *, max(x) OVER () AS m FROM (SELECT o_orderpriority, avg(o_totalprice) / 10000 AS x FROM orders GROUP BY 1))")
def softmax_normalize(t):
    d = t.orders.groupBy("o_orderpriority").agg((F.avg("o_totalprice") / 10000).alias("x"))
    return dist.softmax(d, "x", []).select("o_orderpriority", r("p", 9).alias("p"))


@query("SELECT event_type, round(max(value) + ln(sum(exp(value - m))), 6) AS lse FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1")
def logsumexp(t):
    return dist.logsumexp(t.events, "value", ["event_type"]).select("event_type", r("lse").alias("lse"))


@query("SELECT least(l_linenumber, 3) AS k, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS p FROM lineitem GROUP BY 1")
def coarsen_dist(t):
    fine = dist.empirical(t.lineitem, ["l_linenumber"])
    return dist.coarsen(fine, {"k": F.least("l_linenumber", F.lit(3))}).select("k", r("p", 9).alias("p"))


@query("SELECT least(n, 7) AS size, count(*) AS n_orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def capped_hist(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).groupBy(F.least("n", F.lit(7)).alias("size")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("SELECT CAST(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 21 ELSE floor(o_totalprice / 25000) + 1 END AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
def fixed_bins(t):
    return stats.fixed_bins(t.orders, F.col("o_totalprice"), 0.0, 500000.0, 20)


@query("SELECT c_mktsegment, o_orderpriority, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 9) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def conditional_dist(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return dist.empirical(d, ["o_orderpriority"], within=["c_mktsegment"]).select("c_mktsegment", "o_orderpriority", r("p", 9).alias("p"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_per_group(t):
    return pick.first_per_group(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (value > 50) AS n_high, round(coalesce(sum(value) FILTER (value > 50), 0), 4) AS s_high FROM events GROUP BY 1")
def filtered_agg(t):
    high = F.col("value") > 50
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(high).alias("n_high"), r(F.coalesce(F.sum(F.when(high, F.col("value"))), F.lit(0.0)), 4).alias("s_high"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def block_aggregate(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), r(F.avg("o_totalprice"), 6).alias("mean"))


@query("SELECT round(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END), 9) AS mixed FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1)")
def array_predicate_share(t):
    kinds = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    return kinds.agg(r(F.avg((F.size("s") > 1).cast("double")), 9).alias("mixed"))


@query("SELECT l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_suppkey, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def argmin_per_group(t):
    d = t.lineitem.select("l_partkey", "l_extendedprice", "l_suppkey", "l_orderkey", "l_linenumber")
    return pick.argmin_per_group(d, ["l_partkey"], "l_extendedprice", ["l_suppkey", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT c_mktsegment, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY avg(o_totalprice), 1 LIMIT 1")
def best_param(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.avg("o_totalprice").alias("m"))
    return d.orderBy("m", "c_mktsegment").limit(1).select("c_mktsegment", r("m", 4).alias("mean"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def argmax_global(t):
    return t.orders.agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("o_orderkey"), F.col("m.o_totalprice").alias("o_totalprice"))


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 9) AS open_share FROM orders GROUP BY 1")
def fraction_true(t):
    return t.orders.groupBy("o_orderpriority").agg(r(F.avg((F.col("o_orderstatus") == "O").cast("double")), 9).alias("open_share"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def top_k(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


# -- statistics


@query("""SELECT c_mktsegment, count(o_totalprice) AS n, round(avg(o_totalprice), 3) AS mean, round(stddev(o_totalprice), 3) AS std, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 3) AS q25, round(quantile_cont(o_totalprice, 0.5), 3) AS q50, round(quantile_cont(o_totalprice, 0.75), 3) AS q75, max(o_totalprice) AS high
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def describe(t):
    d = stats.describe(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "o_totalprice", ["c_mktsegment"])
    return d.select("c_mktsegment", "n", *[r(c, 3).alias(c) for c in ("mean", "std")], "low", *[r(c, 3).alias(c) for c in ("q25", "q50", "q75")], "high")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def mean_std(t):
    return stats.mean_std(t.events, "value", ["event_type"]).select("event_type", r("mean").alias("mean"), r("std").alias("std"))


PROBS_SQL = "SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS p FROM orders"


def _probs(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    return t.orders.select(F.col("o_custkey").alias("id"), F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).alias("rank"), (F.col("o_totalprice") / F.sum("o_totalprice").over(w)).alias("p"))


@query(f"""WITH p AS ({PROBS_SQL}), b AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY p DESC, rank) AS best FROM p)
    SELECT id, max(n) AS n, round(sum(p), 6) AS total, round(max(CASE WHEN rank = n THEN p END), 6) AS last, round(sum(CASE WHEN rank > n - 3 THEN p ELSE 0 END), 6) AS last_part, round(sum(CASE WHEN rank <= 3 THEN p ELSE 0 END), 6) AS first_part, round(sum(CASE WHEN rank <= 5 THEN p ELSE 0 END), 6) AS first_head, round(sum(CASE WHEN best <= 5 THEN p ELSE 0 END), 6) AS best_head FROM b GROUP BY id""")
def coverage_metrics(t):
    d = stats.coverage(_probs(t), ["id"], "rank", "p", tail=3, head=5)
    return d.select("id", "n", *[r(c).alias(c) for c in ("total", "last", "last_part", "first_part", "first_head", "best_head")])


@query(f"SELECT id, rank, round(sum(p) OVER (PARTITION BY id ORDER BY rank), 6) AS cumulative FROM ({PROBS_SQL})")
def cumulative_prob(t):
    return stats.cumulative(_probs(t), ["id"], ["rank"], "p").select("id", "rank", r("cumulative").alias("cumulative"))


@query(f"SELECT id, min(CASE WHEN c > 0.5 THEN rank END) AS half, min(CASE WHEN c > 0.9 THEN rank END) AS most FROM (SELECT id, rank, sum(p) OVER (PARTITION BY id ORDER BY rank) AS c FROM ({PROBS_SQL})) GROUP BY 1")
def quantile_index(t):
    return stats.first_above(stats.cumulative(_probs(t), ["id"], ["rank"], "p", "c"), ["id"], "rank", "c", {"half": 0.5, "most": 0.9})


@query("SELECT event_type, max(CASE WHEN rn = floor(n * 0.5) + 1 THEN value END) AS mid, max(CASE WHEN rn = floor(n * 0.95) + 1 THEN value END) AS high FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def rank_quantiles(t):
    return stats.rank_quantiles(t.events, ["event_type"], "value", {"mid": 0.5, "high": 0.95})


@query("SELECT k AS n_orders, count(*) AS n, round(sum(count(*)) OVER (ORDER BY k DESC) / sum(count(*)) OVER (), 9) AS ccdf FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) GROUP BY k")
def ccdf(t):
    d = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return stats.ccdf(d, "n_orders").select("n_orders", "n", r("ccdf", 9).alias("ccdf"))


@query("SELECT label, CAST(pos - 1 AS INT) AS pos, round(sum(x), 4) AS total FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def vector_sum(t):
    return stats.vector_sum(t.embeddings, ["label"], "embedding").select("label", "pos", r("total", 4).alias("total"))


@query("SELECT round(100 * avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS level_1, round(100 * avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS level_2, round(100 * avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END), 6) AS level_3 FROM orders")
def share_by_level(t):
    return t.orders.agg(*[r(100 * F.avg((F.col("o_orderstatus") == s).cast("double"))).alias(f"level_{i}") for i, s in enumerate("FOP", 1)])


@query("SELECT user_id, round(abs(sum(-p * ln(p))), 6) AS entropy FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) GROUP BY 1")
def entropy(t):
    return stats.entropy(t.events, ["user_id"], "event_type").select("user_id", r(F.abs("entropy")).alias("entropy"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def ols_simple(t):
    return stats.ols(t.lineitem, "l_extendedprice", "l_quantity", ["l_returnflag"]).select("l_returnflag", r("slope", 4).alias("slope"), r("intercept", 2).alias("intercept"), r("r2").alias("r2"))


@query("""SELECT round(regr_slope(ln(c), ln(k)), 6) AS slope, round(regr_intercept(ln(c), ln(k)), 6) AS intercept FROM (SELECT k, sum(count(*)) OVER (ORDER BY k DESC) / sum(count(*)) OVER () AS c FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) GROUP BY k)""")
def power_law_loglog(t):
    d = stats.ccdf(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")), "k")
    return stats.ols(d.select(F.log(F.col("k").cast("double")).alias("x"), F.log("ccdf").alias("y")), "y", "x").select(r("slope").alias("slope"), r("intercept").alias("intercept"))


@query(None)
def power_law_fit(t):
    per = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window

    counts = per.groupBy("c_mktsegment", "k").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c_mktsegment")
    curve = counts.select("c_mktsegment", "k", (F.sum("n").over(w.orderBy(F.desc("k"))) / F.sum("n").over(w)).alias("c"))
    return stats.power_law(curve, ["c_mktsegment"], "k", "c").select("c_mktsegment", r("a").alias("a"), r("b").alias("b"), r("sse").alias("sse"))


# -- comparison


SEG_SQL = "SELECT c_mktsegment AS s, o_orderpriority AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


def segment_tvd(t):
    """Flagship of the first slice: how far each segment's order priorities are from all orders'."""
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), "o_orderpriority").agg(F.count(F.lit(1)).alias("p"))
    every = d.groupBy("o_orderpriority").agg(F.sum("p").alias("p"))
    segments = d.groupBy("segment").agg(F.sum("p").alias("n"))
    return dist.tvd(d, segments.crossJoin(every).select("segment", "o_orderpriority", "p"), ["o_orderpriority"], ["segment"]).join(segments, "segment").select("segment", "n", r("tvd").alias("tvd"))  # priorities x segments


@query(f"""WITH d AS ({SEG_SQL}), g AS (SELECT k, sum(n) / (SELECT sum(n) FROM d) AS q FROM d GROUP BY k), s AS (SELECT s, sum(n) AS t FROM d GROUP BY s)
    SELECT s.s AS segment, CAST(s.t AS BIGINT) AS n, round(sum(abs(coalesce(d.n, 0) / s.t - g.q)) / 2, 6) AS tvd FROM s CROSS JOIN g LEFT JOIN d ON d.s = s.s AND d.k = g.k GROUP BY 1, 2""")
def tvd(t):
    return segment_tvd(t)


@query(f"""WITH d AS (SELECT l_linenumber AS s, l_returnflag AS k, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS a FROM lineitem), p AS (SELECT s, k, sum(a) AS x, sum(1 - a) AS y FROM d GROUP BY 1, 2),
    q AS (SELECT s, k, x / sum(x) OVER (PARTITION BY s) AS px, y / sum(y) OVER (PARTITION BY s) AS py, x FROM p)
    SELECT round(sum(w * t), 6) AS tvd FROM (SELECT s, sum(abs(px - py)) / 2 AS t, sum(x) / (SELECT sum(x) FROM p) AS w FROM q GROUP BY s)""")
def conditional_tvd(t):
    d = t.lineitem.select(F.col("l_linenumber").alias("s"), F.col("l_returnflag").alias("k"), (F.col("l_orderkey") % 2).alias("h"))
    a, b = (dist.empirical(d.filter(F.col("h") == h), ["s", "k"]) for h in (0, 1))
    return dist.size_adjusted_tvd(a, b, "s", ["k"]).select(r("tvd").alias("tvd"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS q FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT round(coalesce(sum(CASE WHEN q IS NULL THEN p END), 0), 6) AS missing, round(sum(abs(p - coalesce(q, 0))) / 2, 6) AS one_sided_tvd FROM a LEFT JOIN b USING (k)""")
def missing_mass(t):
    a, b = (dist.empirical(t.orders.filter(F.col("o_orderstatus") == s), ["o_custkey"]) for s in "FP")
    return dist.missing_mass(a, b, ["o_custkey"]).select(r("missing").alias("missing"), r("one_sided_tvd").alias("one_sided_tvd"))


PQ_SQL = """a AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) / (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 0) AS p FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
    b AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) / (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 1) AS q FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1, 2)"""


def _halves(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), (F.col("l_orderkey") % 2).alias("h"))
    return tuple(dist.empirical(d.filter(F.col("h") == h), ["f", "s"]).select("f", "s", "p") for h in (0, 1))


@query(f"WITH {PQ_SQL}, x AS (SELECT f, sum(p) AS own FROM a GROUP BY 1), y AS (SELECT f, sum(q) AS goal FROM b GROUP BY 1) SELECT a.f, a.s, round(p * coalesce(goal / own, 1), 9) AS p FROM a JOIN x USING (f) LEFT JOIN y USING (f)")
def reweight_marginal(t):
    a, b = _halves(t)
    return dist.reweight(a, b, ["f"]).select("f", "s", r("p", 9).alias("p"))


@query(f"WITH {PQ_SQL} SELECT coalesce(a.f, b.f) AS f, coalesce(a.s, b.s) AS s, round((coalesce(q, 0) + 0.001) / (coalesce(p, 0) + 0.001) * CASE WHEN coalesce(a.f, b.f) = 'R' THEN 2 ELSE 1 END, 6) AS ratio FROM a FULL JOIN b ON a.f = b.f AND a.s = b.s")
def dist_adjustment(t):
    a, b = _halves(t)
    return dist.adjustment(a, b, ["f", "s"], double=F.col("f") == "R").select("f", "s", r("ratio").alias("ratio"))


@query(f"""WITH {PQ_SQL}, j AS (SELECT a.f, a.s, p * coalesce((coalesce(q, 0) + 0.001) / (p + 0.001), 1) AS w FROM a LEFT JOIN b ON a.f = b.f AND a.s = b.s) SELECT f, s, round(w / sum(w) OVER (), 9) AS p FROM j""")
def apply_adjustment(t):
    a, b = _halves(t)
    return dist.apply_adjustment(a, dist.adjustment(a, b, ["f", "s"]), ["f", "s"]).select("f", "s", r("p", 9).alias("p"))


@query(f"""WITH d AS (SELECT o_orderpriority AS k, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS p FROM orders GROUP BY 1), c AS (SELECT k, p, sum(p) OVER (ORDER BY k) AS hi FROM d), r AS (SELECT CAST(floor(i / 200) AS BIGINT) AS rep, {UNI.format("'5|' || i")} AS u FROM range(20 * 200) t(i)),
    h AS (SELECT rep, (SELECT k FROM c WHERE hi > u OR hi = (SELECT max(hi) FROM c) ORDER BY hi LIMIT 1) AS k FROM r), q AS (SELECT rep, k, count(*) / 200.0 AS q FROM h GROUP BY 1, 2)
    SELECT g.rep, round(sum(abs(c.p - coalesce(q.q, 0))) / 2, 6) AS tvd FROM (SELECT DISTINCT rep FROM r) g CROSS JOIN c LEFT JOIN q ON q.rep = g.rep AND q.k = c.k GROUP BY 1""")
def bootstrap_tvd(t):
    d = dist.empirical(t.orders, ["o_orderpriority"]).select(F.col("o_orderpriority").alias("k"), "p")
    return dist.bootstrap_tvd(d, ["k"], 200, 20, seed=5).select("rep", r("tvd").alias("tvd"))


@query("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS declared, round(sum(s), 2) AS summed, round(sum(abs(o_totalprice - s)), 2) AS l1, sum(CASE WHEN s < o_totalprice THEN 1 ELSE 0 END)::BIGINT AS under FROM (SELECT o_orderkey, o_orderstatus, o_totalprice, sum(l_extendedprice) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY 1""")
def validation_totals(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    d = t.orders.join(s, "o_orderkey")
    return d.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("declared"), r(F.sum("s"), 2).alias("summed"), r(F.sum(F.abs(F.col("o_totalprice") - F.col("s"))), 2).alias("l1"), F.count_if(F.col("s") < F.col("o_totalprice")).alias("under"))


# -- sampling


@query(f"SELECT o_orderkey FROM orders ORDER BY {UNI.format(chr(39) + '11|' + chr(39) + ' || o_orderkey')}, o_orderkey LIMIT 50")
def seeded_sample(t):
    return pick.seeded_sample(t.orders.select("o_orderkey"), 50, 11, "o_orderkey")


@query("\nUNION ALL\n".join(f"SELECT * FROM (SELECT o_orderkey, '{n}' AS stratum FROM orders WHERE {c} ORDER BY {UNI.format(f'{chr(39)}{21 + i}|{chr(39)} || o_orderkey')}, o_orderkey LIMIT 20)" for i, (n, c) in enumerate((("low", "o_totalprice < 50000"), ("mid", "o_totalprice BETWEEN 40000 AND 150000"), ("high", "o_totalprice > 150000")))))
def stratified_sample(t):
    price = F.col("o_totalprice")
    strata = [("low", price < 50000), ("mid", price.between(40000, 150000)), ("high", price > 150000)]
    return pick.stratified_sample(t.orders.select("o_orderkey", "o_totalprice"), strata, 20, 21, "o_orderkey").select("o_orderkey", "stratum")


@query(f"""WITH p AS ({PROBS_SQL}), c AS (SELECT id, rank, sum(p) OVER (PARTITION BY id ORDER BY rank) AS hi, count(*) OVER (PARTITION BY id) AS n, {UNI.format("'7|' || id")} AS u FROM p)
    SELECT id, min(rank) AS rank FROM c WHERE u < hi OR rank = n GROUP BY id""")
def weighted_sample(t):
    return pick.weighted_draw(_probs(t), ["id"], "p", ["rank"], 7).select("id", "rank")


@query(f"""WITH d AS (SELECT o_orderstatus AS s, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2), c AS (SELECT s, k, sum(n / t) OVER (PARTITION BY s ORDER BY k) AS hi, row_number() OVER (PARTITION BY s ORDER BY k) AS rk, m FROM (SELECT *, sum(n) OVER (PARTITION BY s) AS t, count(*) OVER (PARTITION BY s) AS m FROM d)),
    o AS (SELECT o_orderkey, o_orderstatus AS s, {UNI.format("'9|' || o_orderkey")} AS u FROM orders)
    SELECT o_orderkey, min(k) AS k FROM o JOIN c USING (s) WHERE u < hi OR rk = m GROUP BY 1""")
def conditional_sample(t):
    d = dist.empirical(t.orders.select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("k")), ["k"], within=["s"]).select("s", "k", "p")
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("s"))
    return pick.conditional_draw(rows, d, ["s"], ["o_orderkey"], ["k"], 9).select("o_orderkey", "k")


@query(f"""SELECT p_partkey, string_agg(v, ',' ORDER BY u) AS flags FROM (SELECT p_partkey, CASE WHEN i <= p_size % 4 THEN '1' ELSE '0' END AS v, {UNI.format("'2|' || p_partkey || '|' || i")} AS u FROM part, LATERAL (SELECT unnest(range(1, 7)) AS i)) GROUP BY 1""")
def fallback_assign(t):
    return t.part.select("p_partkey", F.array_join(F.transform(pick.fallback_flags(F.lit(6), F.col("p_size") % 4, 2, "p_partkey"), lambda x: x.cast("string")), ",").alias("flags"))


@query(f"SELECT o_orderkey, {UNI.format(chr(39) + '1|' + chr(39) + ' || o_orderkey')} AS u FROM orders")
def uniform_key(t):
    return t.orders.select("o_orderkey", chance.uniform(1, "o_orderkey").alias("u"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_pairs(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("""SELECT name, CASE WHEN v = floor(v) THEN format('{:,}', v::BIGINT) WHEN abs(v) < 0.001 THEN printf('%.2e', v) ELSE printf('%.2f', v) END AS formatted FROM
    (SELECT 'orders' AS name, count(*)::DOUBLE AS v FROM orders UNION ALL SELECT 'mean', avg(o_totalprice) FROM orders UNION ALL SELECT 'tiny', 1.0 / (1234567 + count(*)) FROM orders)""")
def report_format(t):
    o = t.orders.agg(F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("mean"), (F.lit(1.0) / (1234567 + F.count(F.lit(1)))).alias("tiny"))
    return o.unpivot([], ["orders", "mean", "tiny"], "name", "v").select("name", report.format_value(F.col("v")).alias("formatted"))
