"""Run a stream over everything that is there now and read the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from obsframe.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input and return the result as a table, not through the driver."""
    spark = stream.sparkSession
    out, schema = scratch(spark, "stream"), stream.schema
    writer = stream.writeStream.option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    writer.start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


def run_batches(stream: DataFrame, sink) -> None:
    """Process all available input through a `foreachBatch` sink."""
    spot = scratch(stream.sparkSession, "stream-checkpoint")
    stream.writeStream.option("checkpointLocation", spot).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
