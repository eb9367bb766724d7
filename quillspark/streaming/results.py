"""Result logs as streams: files of JSON that arrive are kept once a key and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Results without an error of files that arrive in `folder`, one row a key among those within `late` of each other.

    The schema has `at timestamp`; state older than the watermark is dropped, so it doesn't grow with the log.
    """
    rows = spark.readStream.schema(schema).json(folder)
    return rows.where(F.coalesce("error", F.lit("")) == "").withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def appended(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to Parquet at `path` and ends; run again, it goes on from `checkpoint`."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
