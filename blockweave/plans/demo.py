"""Made-up block and household tables in the real layouts, derived from the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.plans.generate import generate
from blockweave.sources.blocks import ADULT_TABLES, HISPANIC_ADULT_TABLE, TYPE_TABLES, block_identifier
from blockweave.sources.households import parse_households


def record(kind: str, fields: dict[int, str]) -> str:
    line = [" "] * 70
    line[0] = kind
    for at, value in fields.items():
        line[at - 1 : at - 1 + len(value)] = value
    return "".join(line)


def person(race: int, eth: int, age: int) -> str:
    return record("P", {22: f"{age:02d}", 28: str(eth), 37: f"{race:02d}"})


def header(family: int, under_18: int) -> str:
    return record("H", {48: "10", 58: str(family), 63: f"{under_18:02d}"})


#: Households of the sample: (family code, people as (race code, ethnicity, age)).
SAMPLE = [
    (1, [(1, 0, 40), (1, 0, 38)]),
    (1, [(2, 0, 35), (2, 0, 9)]),
    (4, [(1, 0, 70)]),
    (4, [(2, 0, 30)]),
    (1, [(1, 1, 44), (1, 1, 41), (1, 1, 7)]),
    (4, [(1, 0, 25), (2, 0, 27)]),
    (4, [(6, 0, 50)]),
]


def sample_households(spark: SparkSession) -> DataFrame:
    lines = []
    for family, people in SAMPLE:
        lines += [header(family, sum(a < 18 for _, _, a in people)), *[person(*p) for p in people]]
    return parse_households(spark.createDataFrame([("sample", 0, i, x) for i, x in enumerate(lines)], "file string, split long, at long, line string"))


def blocks_of(members: DataFrame) -> DataFrame:
    """Blocks whose counts are those of the sample households placed in them: (county, tract, block, kind) per household."""
    d = members
    weights = {}

    def add(column: str, kind: int, n: int) -> None:
        weights.setdefault(column, {})
        weights[column][kind] = weights[column].get(kind, 0) + n

    for k, (family, people) in enumerate(SAMPLE):
        adults, size, holder = sum(a >= 18 for _, _, a in people), len(people), people[0]
        race = {1: 1, 2: 2, 6: 4}
        add("H7X001", k, size)
        add("H8A001", k, size)
        add("H8A003", k, adults)
        add("H8M001", k, 1)
        for rc, eth, _ in people:
            add(f"H7Z{(10 if eth else 2) + race[rc]:03d}", k, 1)
            add(f"H7X{1 + race[rc]:03d}", k, 1)
        add(f"H9{ADULT_TABLES[race[holder[0]] - 1]}003", k, adults)
        groups = [race[holder[0]]] + ([8] if holder[1] else [])
        if holder[1]:
            add(f"H9{HISPANIC_ADULT_TABLE}003", k, adults)
        for g in groups:
            add(f"IA{TYPE_TABLES[g - 1]}{(1 if family <= 3 and size > 1 else 9) + size:03d}", k, 1)
    wanted = [f"H7X{i:03d}" for i in range(1, 9)] + [f"H7Z{i:03d}" for i in [*range(3, 10), *range(11, 18)]] + ["H8A001", "H8A003", "H8M001"]
    wanted += [f"H9{x}003" for x in ADULT_TABLES + HISPANIC_ADULT_TABLE] + [f"IA{g}{i:03d}" for g in TYPE_TABLES for i in [*range(3, 9), *range(10, 17)]]
    cells = []
    for c in wanted:
        value = F.lit(0)
        for kind, n in weights.get(c, {}).items():
            value = value + F.when(F.col("kind") == kind, n).otherwise(0)
        cells.append(F.sum(value).cast("int").alias(c))
    g = d.groupBy("COUNTYA", "TRACTA", "BLOCKA").agg(*cells)
    return g.select(F.lit(2010).alias("YEAR"), F.lit("Demo").alias("STATE"), F.lit(1).alias("STATEA"), "*", block_identifier().alias("identifier"))


def demo_microdata(spark: SparkSession, customer: DataFrame) -> DataFrame:
    """Each customer is a household of the sample; blocks are small cells of customers of one nation."""
    members = customer.select(F.col("c_nationkey").alias("COUNTYA"), (F.col("c_custkey") % 50).cast("int").alias("TRACTA"), F.floor(F.col("c_custkey") / 500).cast("int").alias("BLOCKA"), F.pmod(F.hash("c_custkey"), F.lit(len(SAMPLE))).alias("kind"))
    rows, unsolved = generate(blocks_of(members), sample_households(spark))
    lost = unsolved.limit(5).collect()
    if lost:
        raise RuntimeError(f"blocks without a solution, or (level given) whose search was cut off: {[tuple(x) for x in lost]}")
    return rows
