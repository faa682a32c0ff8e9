"""Results as they come: files of frames in, decisions out, by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def follow(spark: SparkSession, source: str, schema: str, decide: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Start a query that decides each new batch of whole clips and appends to ``sink``.

    A batch's results go to a folder named by the batch, which is overwritten if the
    batch is run again after a failure: each clip's result appears once.
    """

    def write(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").option("header", True).csv(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
