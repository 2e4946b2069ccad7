"""Result shards that arrive as files: each area is kept once, whenever and however often its shard comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from blockweave.operators.audit import resume
from blockweave.operators.pick import last_wins


def follow(spark: SparkSession, schema: StructType, folder: str, sink: str, checkpoint: str, key: str = "id", version: str = "version", files_per_batch: int = 100):
    """Start a query that appends new areas of arriving Parquet shards to ``sink``; ends when all files present are read.

    Within a batch the latest version of an area wins; areas that the sink has already are left out, so a batch that
    is run again after a failure adds nothing twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = last_wins(batch, [key], version)
        try:
            done = batch.sparkSession.read.parquet(sink)
        except Exception as e:  # the sink is made by the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            new = resume(new, done, [key])
        new.write.mode("append").parquet(sink)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
