"""Streams of log lines: stateless redaction, dedup by place, counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import Registry
from ..functions.redact import match_count, redact


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of the text files in a folder, with the file they come from."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def redacted(rows: DataFrame, salt: str, registry: Registry | None = None) -> DataFrame:
    return redact(rows, "text", "redacted", registry, salt).drop("text")


def once(rows: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts(rows: DataFrame, text: str, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", registry: Registry | None = None) -> DataFrame:
    """Rows and matches per tumbling window."""
    total = F.lit(0).cast("long")
    for pattern in (registry or Registry()).patterns:
        total = total + match_count(F.col(text), pattern)
    return rows.withWatermark(time, late).withColumn("_n", total).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("matches"))
