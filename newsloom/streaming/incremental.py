"""Bucketing of articles as they arrive: an extension, the batch cascade over a file stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from newsloom.operators.classify import bucketed
from newsloom.sources.readers import POOL


def bucket_stream(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Read new JSON-lines files of articles, bucket them and append them as Parquet; returns the query.

    The cascade is a narrow projection, so the stream keeps no state.
    """
    rows = spark.readStream.schema(POOL).json(folder)
    day = F.to_date(F.substring("datetime", 1, 10), "yyyy-MM-dd")
    ready = rows.select(F.col("gkg_record_id").alias("record_id"), "url", day.cast("string").alias("scan_date"), F.year(day).alias("year"), F.coalesce("article", F.lit("")).alias("text"))
    return bucketed(ready).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
