"""Written intermediates that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task of a shuffle whose parts are numbered gets on average.
TASK_ROWS = 500_000

_own: list[str] = []


def scratch_path(spark: SparkSession, what: str = "scratch") -> str:
    """A new path in the folder of spark.checkpoint.dir (a temporary one only in local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="blockweave-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which is there already and goes when the driver ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def parts_of(spark: SparkSession, rows: int) -> int:
    """Parts to shuffle ``rows`` rows into: a part has TASK_ROWS rows at most on average, however many there are.

    A number that is given is kept: parts that compress well are not merged to tasks of many times the rows.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the scratch folder, read back."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(until_exit(spark, path))
