"""The watermark and other settings shared by the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.constants import WATERMARK_DELAY
from trafficgraph.sources.measurements import bucketed, valid_measurements


def watermarked(measurements: DataFrame, delay: str = WATERMARK_DELAY,
                bucket: str | None = None) -> DataFrame:
    """Valid measurements, event times truncated to ``bucket``, with the watermark.

    The optimizer moves a plain filter below the watermark, where calm rows
    would no longer move it on. The jobs therefore filter nothing before their
    aggregation: calm rows lose their edge instead (``finals``).
    """
    m = valid_measurements(measurements)
    if dict(m.dtypes)["eventTime"] != "timestamp":
        m = m.withColumn("eventTime", F.col("eventTime").cast("timestamp"))
    return bucketed(m, bucket).withWatermark("eventTime", delay)


def interval_ms(spark, interval: str) -> int:
    """Milliseconds of an interval string such as ``"30 seconds"``."""
    row = spark.sql(f"SELECT CAST(unix_micros(TIMESTAMP'1970-01-01 00:00:00 UTC' + "
                    f"INTERVAL {interval}) / 1000 AS BIGINT) AS ms").first()
    return int(row["ms"])
