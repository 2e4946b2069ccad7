"""Pieces the training-data operators share: written intermediates, exact distributed ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH = ("67108864b", "64MB", "64m")
#: Bits of the filter that is broadcast ahead of a join, and of one of Spark's bitmaps.
FILTER_BITS = 1 << 25
#: Rows of a few numbers that may be broadcast: some MB on the driver.
BROADCAST_ROWS = 100_000
_PAGE = 32768
_own_dir: list[str] = []


@contextmanager
def _set(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    """The session's settings ``held`` meanwhile; what they were before afterwards."""
    before = {key: spark.conf.get(key, None) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def told_broadcasts(spark: SparkSession):
    """Only what F.broadcast names is broadcast meanwhile.

    Spark judges a table by its compressed bytes.  Ids, and token lists that repeat row after row, take up to a hundred
    times as much on the driver, which builds the relation, so ten MB of them are more than it holds.
    """
    return _set(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})


def counted_broadcast(written: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, for a join: broadcast if it has BROADCAST_ROWS rows at most, else never."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only in local mode."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="blockweave-"))
    return _own_dir[0]


def materialize(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends in a file that outlives executors.

    The write's shuffle files go with it, as nothing reads them again; the Parquet files go when the driver's JVM ends.
    Whole texts go to Python in batches of about 8 MB meanwhile where the session has Spark's default of 64 MB.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    held = {CLEANUP: "true"} | ({BATCH_BYTES: "8m"} if spark.conf.get(BATCH_BYTES) in DEFAULT_BATCH else {})
    with _set(spark, held):
        df.write.options(**options).parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete the files of intermediates that nothing reads any more: all that came of them is written too."""
    for df in written:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of about 8 MB where the session has Spark's default of 64 MB."""
    if spark.conf.get(BATCH_BYTES) in DEFAULT_BATCH:
        spark.conf.set(BATCH_BYTES, "8m")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def shuffle_key(seed: int, *cols: Column) -> Column:
    """60 seeded pseudo-random bits of the values of ``cols`` (null counts as empty)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def likely_in(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows of which ``key`` (a long) may be among ``wanted_key``: none that is among them is missing, most others are.

    A bitmap of the wanted keys is broadcast: FILTER_BITS / 8 = 4 MiB at most, whatever the input.  It spares a join
    that follows the shuffle of rows that have no partner; with far more wanted keys than bits it spares nothing.
    """
    page_of = lambda c: (F.pmod(c, F.lit(FILTER_BITS)) / _PAGE).cast("int")
    bit_of = lambda c: F.pmod(c, F.lit(_PAGE))
    pages = wanted.select(page_of(wanted_key).alias("_page"), bit_of(wanted_key).alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumns({"_page": page_of(key), "_bit": bit_of(key)}).join(F.broadcast(pages), "_page")
    return found.filter(F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(1) == 1).select(*rows.columns)


def ordered_numbers(keys: DataFrame, key: str, number: str) -> DataFrame:
    """``keys`` (distinct) with a long that ascends with ``key``, below 2 ** 33 times the number of partitions."""
    ranges = keys.repartitionByRange(key).sortWithinPartitions(key)
    return materialize(ranges.withColumn(number, F.monotonically_increasing_id()), "numbers")


def distributed_rank(df: DataFrame, groups: list[str], bucket: str, order: list[str], rank: str, total: str) -> DataFrame:
    """0-based exact rank of each row in its group, and the group's row count, without one task per group.

    ``bucket`` is an integer column that ascends with ``order``; rows are numbered inside (group, bucket) and
    shifted by the running count of the buckets before, which is a table of at most one row per (group, bucket).
    ``df`` is read twice, so it should be a scan or a materialised table.
    """
    keys = [*groups, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(total))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, keys)
        .withColumn(rank, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id = smallest id reachable) for every id that occurs in ``edges`` (u, v).

    Alternates large-star and small-star; each is written, so lineage stays short and nothing is collected.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = _fingerprint(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialize(small, "cc-edges")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id").union(edges.select("v", "v").distinct()).groupBy("id").agg(F.min("component_id").alias("component_id"))


def nearby_least(edges: DataFrame, hops: int = 2) -> DataFrame:
    """(id, component_id) where component_id is the smallest id within ``hops`` edges: ids that share it are connected."""
    both = materialize(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both-ways")
    label = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    for _ in range(hops - 1):
        far = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.least("u", F.min("m")).alias("m"))
        label = materialize(far, "labels")
    return label.select(F.col("u").alias("id"), F.col("m").alias("component_id"))
