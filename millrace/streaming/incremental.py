"""The same steps over a file stream that takes what is there and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def available_now(spark: SparkSession, folder: str, schema, kind: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> int:
    """Runs row-wise steps over new files of the folder and appends the result as Parquet; the number of batches.

    A stream knows files by path: one written anew under its name is not taken again. Use the checkpoint log for that.
    """
    reader = spark.readStream.schema(schema)
    rows = reader.parquet(folder) if kind == "parquet" else reader.json(folder)
    query = step(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)
