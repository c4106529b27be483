"""Sensor measurements: batch and streaming readers with one fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficgraph.schemas import MEASUREMENT_SCHEMA


def read_measurements_csv(spark: SparkSession, path: str) -> DataFrame:
    """Measurement CSV files (comma, no header) as a batch ``DataFrame``."""
    return (spark.read.schema(MEASUREMENT_SCHEMA)
            .option("sep", ",").option("header", False).csv(path))


def stream_measurements_csv(spark: SparkSession, path: str,
                            max_files_per_trigger: int | None = None) -> DataFrame:
    """A folder of measurement CSV files replayed as a stream.

    With ``max_files_per_trigger=1`` each file becomes one micro-batch, in file
    modification order, which simulates a live feed from recorded minutes.
    """
    reader = (spark.readStream.schema(MEASUREMENT_SCHEMA)
              .option("sep", ",").option("header", False))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.csv(path)


def valid_measurements(df: DataFrame) -> DataFrame:
    """Rows that can be placed in time and on the graph.

    The reference decodes rows into records with primitive fields, where a
    null time or detector cannot exist; such rows are dropped here. Null
    speeds or densities are kept and yield null class / distance downstream.
    """
    return df.where(F.col("eventTime").isNotNull() & F.col("detectorId").isNotNull())


def bucketed(df: DataFrame, bucket: str | None) -> DataFrame:
    """Event times truncated to ``bucket`` (``"minute"``, ``"hour"``, ...; None: as they are).

    For feeds whose records of one minute do not carry the same time stamp.
    """
    if bucket is None:
        return df
    kind = dict(df.dtypes)["eventTime"]
    return df.withColumn("eventTime", F.date_trunc(bucket, F.col("eventTime")).cast(kind))
