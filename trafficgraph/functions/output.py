"""Output shaping: message key and key/JSON value pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficgraph.constants import JSON_TIMESTAMP_FORMAT


def update_key(event_time: str = "eventTime", vertex: str = "id", final: str = "final") -> Column:
    """``<eventTime>_<vertex>_<final>`` as one string; a null part gives null."""
    return F.concat(F.col(event_time).cast("string"), F.lit("_"),
                    F.col(vertex).cast("string"), F.lit("_"),
                    F.col(final).cast("string"))


def with_key(df: DataFrame, vertex: str, event_time: str = "eventTime",
             final: str = "final") -> DataFrame:
    return df.withColumn("key", update_key(event_time, vertex, final))


def to_key_value(df: DataFrame, timestamp_format: str = JSON_TIMESTAMP_FORMAT) -> DataFrame:
    """``key string, value string``; the JSON holds every column, key included.

    Timestamps are written with an explicit layout for both timestamp kinds, so
    the text does not depend on JSON defaults.
    """
    opts = {"timestampFormat": timestamp_format, "timestampNTZFormat": timestamp_format}
    return df.select(F.col("key").cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns]), opts).alias("value"))
