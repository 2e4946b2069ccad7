"""Parameters in file names, and tables written by parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def name_params(name: Column, pattern: str, fields: list[str]) -> list[Column]:
    """Groups of a pattern as columns; null where the name does not match."""
    hit = name.rlike(pattern)
    return [F.when(hit, F.regexp_extract(name, pattern, i)).alias(f) for i, f in enumerate(fields, 1)]


def read_shards(spark: SparkSession, folder: str, pattern: str, fields: list[str], schema=None) -> DataFrame:
    """All Parquet shards of a folder, with the file and the parameters in its name."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    d = reader.option("recursiveFileLookup", True).parquet(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return d.select("*", *name_params(F.col("file"), pattern, fields)).filter(F.col("file").rlike(pattern))


def latest(files: DataFrame, name: str, pattern: str) -> DataFrame:
    """(stem, name, n): of each stem the file with the largest number."""
    stem, n = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2).cast("long")
    d = files.filter(F.col(name).rlike(pattern)).select(stem.alias("stem"), n.alias("n"), name)
    return d.groupBy("stem").agg(F.max_by(name, "n").alias(name), F.max("n").alias("n"))


def write_once(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, unless the path is there already."""
    w = df.write.mode("ignore")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
