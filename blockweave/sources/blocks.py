"""Block tables: wide CSV of counts per census block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockweave.functions.keys import block_identifier

# Identity columns and prefixes of the count tables, and the letters of the tables by householder.
IDENTITY = {"YEAR": "int", "STATE": "string", "STATEA": "int", "COUNTY": "string", "COUNTYA": "int", "COUSUBA": "int", "TRACTA": "int", "BLKGRPA": "int", "BLOCKA": "int", "NAME": "string"}
COUNT_PREFIXES = ("H7", "H8", "H9", "IA")
RACES = ("WHITE", "BLACK", "AI_AN", "ASIAN", "H_PI", "OTHER", "TWO_OR_MORE")
ADULT_TABLES = "STUVWXY"
HISPANIC_ADULT_TABLE = "Z"
TYPE_TABLES = "JKLMNOPQ"  # seven races, then Hispanic


def keep(column: str) -> bool:
    return column in IDENTITY or column[:2] in COUNT_PREFIXES


def type_column(group: int, family: bool, size: int) -> str | None:
    """Count column of households by group (1-8), kind and size (1-7); families of one do not exist."""
    if family and size == 1:
        return None
    return f"IA{TYPE_TABLES[group - 1]}{(1 if family else 9) + size:03d}"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Clean block table: wanted columns with their types, blocks with people, ``identifier`` added.

    The header decides the columns; nothing is inferred from values.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType() if IDENTITY.get(c, "int") == "string" or not keep(c) else T.IntegerType()) for c in header])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.select(*[c for c in header if keep(c)]).filter("H7X001 > 0").withColumn("identifier", block_identifier())


def read_keyed(spark: SparkSession, path: str, keys: list[str], numbers: list[str]) -> DataFrame:
    """A CSV file with a header, whose ``keys`` stay text (leading zeros are kept) and whose ``numbers`` are whole; the other columns are text too.

    A number that is none is an error, an empty one is null.
    """
    header = spark.read.option("header", True).csv(path).columns
    lost = [c for c in (*keys, *numbers) if c not in header]
    if lost:
        raise ValueError(f"columns are missing: {lost}")
    schema = T.StructType([T.StructField(c, T.LongType() if c in numbers else T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def check_identifiers(blocks: DataFrame) -> None:
    row = blocks.agg(F.count(F.lit(1)), F.count_distinct("identifier"), F.max(F.length("identifier"))).first()
    if row[0] != row[1]:
        raise ValueError("identifiers are not unique")
    if row[2] not in (None, 15):
        raise ValueError("an identifier is too wide")


def _sum(columns: list[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c)
    return out


def adult_columns() -> list[str]:
    return [f"H9{x}003" for x in ADULT_TABLES]


def age_is_valid() -> Column:
    return (F.col("H7X001") == F.col("H8A001")) & (_sum(adult_columns()) == F.col("H8A003"))


def validate(blocks: DataFrame) -> DataFrame:
    """Per block: age_gap, no_households, err (0 or 1 even if both hold)."""
    gap = F.abs(F.col("H8A003") - _sum(adult_columns()))
    none = F.col("H8M001") == 0
    return blocks.select("identifier", gap.alias("age_gap"), none.alias("no_households"), ((gap > 0) | none).cast("int").alias("err"))


def race_by_ethnicity() -> list[str]:
    return [f"H7Z{2 + r:03d}" for r in range(1, 8)] + [f"H7Z{10 + r:03d}" for r in range(1, 8)]


def encode(level: int, use_age: bool = True) -> Column:
    """Count vector of a block: level 1 has 135 places, level 2 16 (15 without age), level 3 9 (8)."""
    rh = [F.col(c) for c in race_by_ethnicity()]
    adults = [F.col(c) for c in adult_columns()]
    if level == 1:
        types = [F.lit(0) if (c := type_column(g, f, s)) is None else F.col(c) for g in range(1, 9) for f in (False, True) for s in range(1, 8)]
        parts = [*rh, *adults, F.col(f"H9{HISPANIC_ADULT_TABLE}003"), *types, F.col("H8M001")]
    elif level == 2:
        parts = [*rh, *([_sum(adult_columns())] if use_age else []), F.col("H8M001")]
    elif level == 3:
        parts = [*[rh[r] + rh[7 + r] for r in range(7)], sum(rh[8:], rh[7]), *([_sum(adult_columns())] if use_age else [])]
    else:
        raise ValueError("levels are 1, 2 and 3")
    return F.array(*[p.cast("int") for p in parts])
