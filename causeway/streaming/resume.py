"""Resumable batches as a stream over files: what is done stays done across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def run_available(spark: SparkSession, source: str, schema: StructType | str, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str, files_at_once: int = 100) -> None:
    """Processes every file of ``source`` that no run with this checkpoint has seen, and appends the results to ``sink`` (Parquet).

    A batch that is run again after a failure leaves out keys that the sink already has, so each key is written once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        try:
            done = spark.read.parquet(sink).select(key).distinct()
            batch = batch.join(done, key, "left_anti")
        except Exception as e:  # the sink does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        process(batch.dropDuplicates([key])).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
