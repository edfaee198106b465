"""Incremental ingest, an extension: JSON lines that land in a folder are normalised by the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import SCHEMA


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, normalise: Callable[[DataFrame], DataFrame] = lambda df: df, schema: str = SCHEMA) -> StreamingQuery:
    """All files that are there now, then stop; run again for later ones. A batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        normalise(batch).write.mode("overwrite").json(f"{out}/batch={number}")

    lines = spark.readStream.schema(schema).json(folder)
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
