"""From solutions to household rows, and from households to persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.operators.pick import conditional_draw, fallback_flags

RACE_COLUMNS = ("W", "B", "AI_AN", "AS", "H_PI", "OTH", "TWO_OR_MORE")
COUNTS = (*RACE_COLUMNS, "NUM_HISP", "18_PLUS")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0), lambda a, x: a + x)


def to_output(v: Column, level: int, use_age: bool) -> Column:
    """Races (7), Hispanic and adults from an encoded vector; adults are null where the level has none."""
    if level == 3:
        return F.concat(F.slice(v, 1, 8), F.array(v[8] if use_age else F.lit(None).cast("int")))
    races = [v[r] + v[7 + r] for r in range(7)]
    adults = _sum(F.slice(v, 15, 7)) if level == 1 else v[14] if use_age else F.lit(None).cast("int")
    return F.array(*races, _sum(F.slice(v, 8, 7)), adults)


def household_rows(chosen: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """(key, pos, elem_id, v): one row per household of each chosen solution; ``pos`` counts from 0 in an area."""
    listed = F.flatten(F.transform("elems", lambda e: F.array_repeat(e["elem_id"], e["n"])))
    rows = chosen.select(key, F.posexplode(listed).alias("pos", "elem_id"))
    return rows.join(elements.select("elem_id", "v"), "elem_id").select(key, "pos", "elem_id", "v")


def add_adults(rows: DataFrame, dist: DataFrame, seed: int) -> DataFrame:
    """Rows (identifier, HH_NUM, out) whose last place is null get it from a draw of the full 9-vectors that agree in the first eight."""
    known = rows.filter(F.col("out")[8].isNotNull())
    open_ = rows.filter(F.col("out")[8].isNull()).withColumn("head", F.slice("out", 1, 8)).drop("out")
    full = dist.select(F.slice("v", 1, 8).alias("head"), F.col("v").alias("out"), "p")
    drawn = conditional_draw(open_, full, ["head"], ["identifier", "HH_NUM"], ["out"], seed)
    return known.unionByName(drawn.select(*known.columns))


def microdata(rows: DataFrame, blocks: DataFrame, identity: list[str]) -> DataFrame:
    """One row per household with block columns; ``rows`` has identifier, HH_NUM, out, ACCURACY, AGE_ACCURACY."""
    b = blocks.select("identifier", *identity, F.col("H7X001").alias("BLOCK_TOTAL"), F.col("H8A003").alias("BLOCK_18_PLUS"))
    out = F.col("out")
    counts = [out[i].alias(c) for i, c in enumerate(COUNTS)]
    d = rows.join(b, "identifier")
    return d.select(*identity, "BLOCK_TOTAL", "BLOCK_18_PLUS", _sum(F.slice("out", 1, 7)).alias("TOTAL"), *counts, "HH_NUM", "ACCURACY", "AGE_ACCURACY", "identifier")


def persons(households: DataFrame, lists: DataFrame, key: list[str], seed: int) -> DataFrame:
    """One row per person (key, person, race, eth, adult, known).

    A household draws one of the people lists with its 9-vector ``out``; where the sample has none, ethnicity
    and adulthood are dealt to its people by independent seeded orders, so its counts are kept.
    """
    have = households.join(lists.select(F.col("key").alias("out")).distinct(), "out", "left_semi")
    drawn = conditional_draw(have, lists.withColumnRenamed("key", "out"), ["out"], key, ["people"], seed)
    drawn = drawn.select(*key, F.posexplode("people").alias("person", "x")).select(*key, "person", "x.race", "x.eth", "x.adult", F.lit(True).alias("known"))
    rest = households.join(lists.select(F.col("key").alias("out")).distinct(), "out", "left_anti")
    n = F.aggregate(F.slice("out", 1, 7), F.lit(0), lambda a, x: a + x)
    races = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda r: F.array_repeat(r, F.element_at("out", r))))
    eth, adult = fallback_flags(n, F.col("out")[7], seed + 1, *key), fallback_flags(n, F.col("out")[8], seed + 2, *key)
    rest = rest.select(*key, F.posexplode(F.arrays_zip(races.alias("race"), eth.alias("eth"), adult.alias("adult"))).alias("person", "x"))
    return drawn.unionByName(rest.select(*key, "person", "x.race", "x.eth", "x.adult", F.lit(False).alias("known")))


def conserved(people: DataFrame, households: DataFrame, key: list[str]) -> DataFrame:
    """Households whose people do not add up to their counts (none, if all is well)."""
    sums = people.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("eth").alias("eth"), F.sum("adult").alias("adult"), *[F.sum((F.col("race") == r).cast("int")).alias(f"r{r}") for r in range(1, 8)])
    d = households.join(sums, key, "left")
    wrong = (F.coalesce("eth", F.lit(0)) != F.col("out")[7]) | (F.coalesce("adult", F.lit(0)) != F.col("out")[8])
    for r in range(1, 8):
        wrong = wrong | (F.coalesce(f"r{r}", F.lit(0)) != F.col("out")[r - 1])
    return d.filter(wrong).select(*key)
