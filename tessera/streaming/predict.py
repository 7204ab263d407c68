"""Prediction over a stream: the batch transform on readStream, and windowed counts of its answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import new_path


def predict_stream(spark: SparkSession, path: str, schema: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """transform applied to files as they arrive under path; it must be a row-wise plan."""
    return transform(spark.readStream.schema(schema).parquet(path))


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window start, by, n); rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there now into a Parquet table of the shared folder; the table of its answers."""
    spark = stream.sparkSession
    path, state = new_path(spark, "answers"), new_path(spark, "progress")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
