"""Hierarchical fixed-width household and person records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import RACES

# Record layout (1-based start, length) and the eleven race codes.
LAYOUT = {"race": (37, 2), "eth": (28, 1), "age": (22, 2), "family": (58, 1), "under_18": (63, 2), "weight": (48, 2)}
RACE_OF_CODE = {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 4, 7: 5, 8: 5, 9: 5, 10: 6, 11: 7}
FAMILY_CODES_UP_TO = 3
MAX_SIZE = 7
#: Lines of a split that are numbered together.
PIECE = 1 << 17


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, line) of the lines of text files that are not empty.

    A file is read by as many tasks as it has splits (spark.sql.files.maxPartitionBytes).  ``split`` is the byte at which a line's split
    starts, ``at`` ascends with the place within the split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return lines.filter("line <> ''")


def number_households(lines: DataFrame) -> DataFrame:
    """``lines`` with ``person`` and ``hh``, the number of the last header of the file up to this line (0 before the first).

    Headers are numbered within pieces of a split and moved on by the headers of the pieces before, so a household that goes on in the next
    piece keeps its number.  A piece has PIECE lines at most; the pieces of a file, one row each, meet in a window.
    """
    d = lines.withColumn("person", F.col("line").startswith("P")).withColumn("piece", F.floor(F.col("at") / PIECE))
    header = (~F.col("person")).cast("long")
    before = Window.partitionBy("file").orderBy("split", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("file", "split", "piece").agg(F.sum(header).alias("headers")).select("file", "split", "piece", F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("file", "split", "piece").orderBy("at")
    dealt = d.repartition(_parts(lines), "file", "split", "piece")
    return dealt.withColumn("hh", F.sum(header).over(inside)).join(starts, ["file", "split", "piece"]).withColumn("hh", F.col("hh") + F.col("first")).drop("first", "piece")


def _parts(lines: DataFrame) -> int:
    """Parts for a shuffle of ``lines``: four for each split that is read, so that a part is a quarter of a split however long the files are."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, 4 * lines.rdd.getNumPartitions())


def field(name: str) -> Column:
    start, length = LAYOUT[name]
    return F.substring("line", start, length).cast("int")


def parse_households(lines: DataFrame) -> DataFrame:
    """(file, hh, holder, people, under_18, is_family, size, n_adults, weight) of households with people, from the lines of read_lines.

    A line that starts with P is a person of the last header; any other is a header.  The first person is the
    householder.  A household of one is not a family, and its person counts as an adult when the header says so.
    """
    d = number_households(lines)
    codes = F.create_map(*[F.lit(x) for kv in RACE_OF_CODE.items() for x in kv])
    race = codes[field("race")]
    race = F.when(F.col("person") & race.isNull(), F.raise_error(F.lit("unknown race code"))).otherwise(race)
    person = F.struct(F.col("split"), F.col("at"), race.alias("race"), field("eth").alias("eth"), field("age").alias("age"))
    g = d.repartition(_parts(lines), "file", "hh").groupBy("file", "hh").agg(
        F.array_sort(F.collect_list(F.when(F.col("person"), person))).alias("p"),
        F.max(F.when(~F.col("person"), field("family"))).alias("family"),
        F.max(F.when(~F.col("person"), field("under_18"))).alias("under_18"),
    ).filter("size(p) > 0 and hh > 0")
    size = F.size("p")
    bump = (size == 1) & (F.col("under_18") == 0)
    people = F.transform("p", lambda x: F.struct(x["race"].alias("race"), x["eth"].alias("eth"), F.when(bump & (x["age"] < 18), 18).otherwise(x["age"]).alias("age")))
    g = g.withColumn("people", people).withColumn("n_adults", F.size(F.filter("people", lambda x: x["age"] >= 18)))
    return g.select("file", "hh", F.col("people")[0].alias("holder"), "people", "under_18", ((F.col("family") <= FAMILY_CODES_UP_TO) & (size > 1)).alias("is_family"), size.alias("size"), "n_adults", F.lit(1).alias("weight"))


def check_ages(households: DataFrame) -> DataFrame:
    """Households whose number of adults contradicts their header."""
    return households.filter("n_adults <> size - under_18")


def _of(race: int, eth: int):
    return lambda x: (x["race"] == race) & (x["eth"] == eth)


def race_eth_counts() -> Column:
    """14 counts: seven races without, then with Hispanic ethnicity."""
    return F.array(*[F.size(F.filter("people", _of(r, e))) for e in (0, 1) for r in range(1, 8)])


def household_tuple(households: DataFrame) -> DataFrame:
    """The 19 fields of a household type: rh (14), n_18, holder_race, holder_eth, is_family, size (at most 7)."""
    return households.select("*", race_eth_counts().alias("rh"), F.col("holder.race").alias("holder_race"), F.col("holder.eth").alias("holder_eth"), F.least("size", F.lit(MAX_SIZE)).alias("size_7"))


def encode_household(level: int, use_age: bool = True) -> Column:
    """Vector of a household (columns of household_tuple) in the places of the block encoding of this level."""
    n18 = F.col("n_adults")
    if level == 1:
        at_holder = [F.when(F.col("holder_race") == r, n18).otherwise(0) for r in range(1, 8)]
        kinds = []
        for g in range(1, 9):
            own = (F.col("holder_race") == g) if g < 8 else (F.col("holder_eth") == 1)
            kinds += [(own & (F.col("is_family") == f) & (F.col("size_7") == s)).cast("int") for f in (False, True) for s in range(1, 8)]
        return F.concat(F.col("rh"), F.array(*at_holder, n18 * F.col("holder_eth"), *kinds, F.lit(1)))
    if level == 2:
        return F.concat(F.col("rh"), F.array(*([n18] if use_age else []), F.lit(1)))
    if level == 3:
        races = [F.col("rh")[r] + F.col("rh")[7 + r] for r in range(7)]
        hispanic = F.aggregate(F.slice("rh", 8, 7), F.lit(0), lambda a, x: a + x)
        return F.array(*races, hispanic, *([n18] if use_age else []))
    raise ValueError("levels are 1, 2 and 3")


def output_vector(use_age: bool = True) -> Column:
    return encode_household(3, use_age)


def household_distribution(households: DataFrame, level: int, use_age: bool = True, ratios: DataFrame | None = None) -> DataFrame:
    """(v, p): the empirical distribution of household vectors at a level.

    ``ratios`` (key, ratio) multiply the weights of households by their 9-vector; keys without a ratio keep theirs.
    """
    from blockweave.operators.dist import empirical

    d = household_tuple(households).select(encode_household(level, use_age).alias("v"), "weight", output_vector().alias("key"))
    if ratios is not None:
        d = d.join(ratios.select("key", "ratio"), "key", "left").withColumn("weight", F.col("weight") * F.coalesce("ratio", F.lit(1.0)))
    return empirical(d, ["v"], F.col("weight")).select("v", "p")


def people_by_type(households: DataFrame) -> DataFrame:
    """(key, people, p): for each 9-vector the distribution of its sorted lists of (race, eth, adult)."""
    from blockweave.operators.dist import empirical

    people = F.array_sort(F.transform("people", lambda x: F.struct(x["race"].alias("race"), x["eth"].alias("eth"), (x["age"] >= 18).cast("int").alias("adult"))))
    d = household_tuple(households).select(output_vector().alias("key"), people.alias("list"), "weight")
    return empirical(d, ["list"], F.col("weight"), within=["key"]).select("key", F.col("list").alias("people"), "p")


def category_names() -> list[str]:
    rh = [f"{r}_{e}" for e in (0, 1) for r in RACES]
    kinds = [f"{g}_{f}_{s}" for g in (*RACES, "H") for f in (False, True) for s in range(1, 8)]
    return [*rh, *[f"n_18_{r}" for r in RACES], "n_18_HISP", *kinds, "num_hh"]
