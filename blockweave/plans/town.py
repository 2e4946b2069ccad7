"""A town made of the orders table, in the entry files' layouts: orders are households, their lines are people, customers are blocks.

Every rule is one that SQL can say over the same tables.  A third of the households is the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.functions.keys import block_identifier
from blockweave.operators.assemble import conserved, persons
from blockweave.plans.generate import generate
from blockweave.sources.blocks import ADULT_TABLES, HISPANIC_ADULT_TABLE, check_identifiers, read_blocks, type_column
from blockweave.sources.households import parse_households, people_by_type, read_lines
from blockweave.sources.scratch import parts_of, scratch_path, until_exit, written
from blockweave.sources.shards import write_csv

#: Race codes of the file, by the number that an order's rule gives: most are 1.
CODES = [1, 1, 1, 1, 1, 1, 2, 2, 6, 11]
MAX_PEOPLE = 7


def people_of(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(o_orderkey, o_custkey, nth from 1, at, code, eth, age, family): at most MAX_PEOPLE line numbers of an order are its people.

    Line numbers may occur again in an order: ``at`` of the lines (of any type that has an order; 0 where they have none) says which of them
    comes first.
    All have the household's race, but for one in 29 lines; the first, and in every other order the second, are grown up, and so are all in
    every fifth.
    """
    o = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, CODES)), (1 + (o + F.col("o_custkey")) % len(CODES)).cast("int"))
    code = F.when(F.col("l_partkey") % 29 == 0, 2).otherwise(code)
    adult = (F.col("l_linenumber") <= 1 + o % 2) | (o % 5 == 0)
    age = F.when(adult, 20 + F.col("l_partkey") % 60).otherwise(F.col("l_partkey") % 18)
    n = parts_of(orders.sparkSession, lineitem.count())
    at = F.col("at") if "at" in lineitem.columns else F.lit(0).cast("long")
    lines = orders.repartition(n, "o_orderkey").join(lineitem.filter(F.col("l_linenumber") <= MAX_PEOPLE).repartition(n, "l_orderkey"), o == F.col("l_orderkey"))
    return lines.select("o_orderkey", "o_custkey", F.col("l_linenumber").cast("int").alias("nth"), at.alias("at"), code.cast("int").alias("code"), (o % 8 == 0).cast("int").alias("eth"), age.cast("int").alias("age"), (o % 4 + 1).cast("int").alias("family"))


def _placed(*fields: tuple[int, Column]) -> Column:
    """A line with fields at their places (from 1), blank between."""
    parts, at = [], 1
    for start, value in fields:
        if start > at:
            parts.append(F.lit(" " * (start - at)))
        parts.append(value)
        at = start + {1: 1, 22: 2, 28: 1, 37: 2, 48: 2, 58: 1, 63: 2}[start]
    return F.concat(*parts)


def records(people: DataFrame) -> DataFrame:
    """(o_orderkey, nth, at, line): a header (nth 0) and a line for each person.  A header counts no children in every ninth order."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    homes = people.groupBy("o_orderkey").agg(F.min("family").alias("family"), F.sum((F.col("age") < 18).cast("int")).alias("children"))
    children = F.when(F.col("o_orderkey") % 9 == 0, 0).otherwise(F.col("children"))
    heads = homes.select("o_orderkey", F.lit(0).alias("nth"), F.lit(None).cast(people.schema["at"].dataType).alias("at"), _placed((1, F.lit("H")), (48, F.lit("10")), (58, F.col("family").cast("string")), (63, two(children))).alias("line"))
    rows = people.select("o_orderkey", "nth", "at", _placed((1, F.lit("P")), (22, two(F.col("age"))), (28, F.col("eth").cast("string")), (37, two(F.col("code")))).alias("line"))
    return heads.unionByName(rows)


def write_records(people: DataFrame) -> str:
    """The records as text files, each household's lines together and in order; the path."""
    path = scratch_path(people.sparkSession, "records")
    people = written(people)
    n = parts_of(people.sparkSession, people.count())
    rows = records(people).repartitionByRange(n, "o_orderkey").sortWithinPartitions("o_orderkey", "nth", "at")
    rows.select("line").write.text(path)
    return until_exit(people.sparkSession, path)


def record_lines(spark: SparkSession, people: DataFrame) -> DataFrame:
    return read_lines(spark, write_records(people))


def is_sample() -> Column:
    return F.col("o_orderkey") % 3 == 0


def block_table(people: DataFrame) -> DataFrame:
    """The wide block table: counts of each customer's households.  Every seventh customer's adults are counted at one more than there are people of."""
    race = F.when(F.col("code") == 6, 4).when(F.col("code") == 11, 7).otherwise(F.col("code"))
    p = people.withColumn("race", race).withColumn("adult", (F.col("age") >= 18).cast("int"))
    p = p.repartition(parts_of(people.sparkSession, people.count()), "o_custkey")  # of both groupings
    homes = p.groupBy("o_custkey", "o_orderkey").agg(F.min_by("race", F.struct("nth", "at")).alias("holder"), F.min("eth").alias("eth"), F.min("family").alias("family"), F.count(F.lit(1)).alias("size"), F.sum("adult").alias("adults"), *[F.sum((F.col("race") == r).cast("int")).alias(f"r{r}") for r in range(1, 8)])
    family = (F.col("family") <= 3) & (F.col("size") > 1)
    n = lambda c, where=F.lit(True): F.sum(F.when(where, c).otherwise(0)).cast("int")
    hispanic = F.col("eth") == 1
    cells = [n(F.col("size")).alias("H7X001"), *[n(F.col(f"r{r}")).alias(f"H7X{1 + r:03d}") for r in range(1, 8)]]
    cells += [n(F.col(f"r{r}"), hispanic == h).alias(f"H7Z{at + r:03d}") for h, at in ((False, 2), (True, 10)) for r in range(1, 8)]
    odd = (F.max("o_custkey") % 7 == 0).cast("int")
    cells += [(n(F.col("size")) + odd).cast("int").alias("H8A001"), n(F.col("adults")).alias("H8A003"), F.count(F.lit(1)).cast("int").alias("H8M001")]
    cells += [n(F.col("adults"), F.col("holder") == r).alias(f"H9{x}003") for r, x in enumerate(ADULT_TABLES, 1)] + [n(F.col("adults"), hispanic).alias(f"H9{HISPANIC_ADULT_TABLE}003")]
    for g in range(1, 9):
        own = hispanic if g == 8 else F.col("holder") == g
        for f in (False, True):
            cells += [n(F.lit(1), own & (family == f) & (F.col("size") == s)).alias(name) for s in range(1, 8) if (name := type_column(g, f, s))]
    g = homes.groupBy("o_custkey").agg(*cells)
    c = F.col("o_custkey")
    place = [(c / 1_000_000).cast("int").alias("COUNTYA"), F.floor(c % 1_000_000 / 1000).cast("int").alias("TRACTA"), (c % 1000).cast("int").alias("BLOCKA")]
    d = g.select(F.lit(2010).alias("YEAR"), F.lit("Town").alias("STATE"), F.lit(1).alias("STATEA"), *place, "*")
    return d.withColumn("identifier", block_identifier())


def read_town(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, households of the sample) as read back from a CSV file of blocks and text files of records."""
    spark = people.sparkSession
    path = scratch_path(spark, "blocks")
    write_csv(block_table(people), path)
    blocks = written(read_blocks(spark, until_exit(spark, path)))
    check_identifiers(blocks)
    return blocks, written(parse_households(record_lines(spark, people.filter(is_sample()))))


def town_microdata(people: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(blocks, sample, household rows, unsolved blocks) of the whole plan."""
    blocks, sample = read_town(written(people))
    rows, unsolved = generate(blocks, sample, **options)
    return blocks, sample, written(rows), written(unsolved)


def town_persons(rows: DataFrame, sample: DataFrame, seed: int = 0) -> DataFrame:
    """One row per person of the household rows; an error if a household's people do not add up to it."""
    key = ["identifier", "HH_NUM"]
    out = F.array(*[F.col(c) for c in ("W", "B", "AI_AN", "AS", "H_PI", "OTH", "TWO_OR_MORE", "NUM_HISP", "18_PLUS")])
    homes = written(rows.select(*key, out.alias("out")))
    people = written(persons(homes, people_by_type(sample), key, seed))
    lost = conserved(people, homes, key).limit(1).collect()
    if lost:
        raise RuntimeError(f"the people of {tuple(lost[0])} do not add up")
    return people
