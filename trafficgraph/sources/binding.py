"""Derive a road graph and measurements from the generic ``events`` table.

The test tables carry no road data, so each distinct ``user_id`` becomes a
detector. Detectors form a chain (u -> u+1) with a ramp every ten
(u -> u+10 when u % 10 = 0). Each event is one measurement of its detector:
``averageSpeed = floor(value)``, ``density = value``, free flow 70 km/h,
event time truncated to ``bucket``. The columns no analysis reads get fixed
values. The same rules are written as SQL for the oracle in
``trafficgraph.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficgraph.operators.materialize import materialize
from trafficgraph.sources.conform import conform
from trafficgraph.schemas import EDGE_SCHEMA, MEASUREMENT_SCHEMA

# --- fixed values of the binding --------------------------------------------
DETECTOR_PREFIX = "D"
DETECTOR_DIGITS = 10
RAMP_EVERY = 10
FREE_FLOW_KMH = 70.0
# ---------------------------------------------------------------------------


def detector_id(user: Column) -> Column:
    """Prefix and number, zero-padded to ``DETECTOR_DIGITS``; longer numbers are kept whole."""
    digits = user.cast("string")
    padded = F.when(F.length(digits) < DETECTOR_DIGITS,
                    F.lpad(digits, DETECTOR_DIGITS, "0")).otherwise(digits)
    return F.concat(F.lit(DETECTOR_PREFIX), padded)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def edges_from_events(events: DataFrame) -> DataFrame:
    """The chain-with-ramps road graph over all detectors in ``events``."""
    # Written once: the two self-joins read it four times.
    users = materialize(events.where(F.col("user_id").isNotNull())
                        .select(F.col("user_id").alias("u")).distinct())
    a = users.alias("a")
    chain = (a.join(users.alias("b"), F.col("b.u") == F.col("a.u") + F.lit(1))
             .select(F.col("a.u").alias("su"), F.col("b.u").alias("du")))
    ramps = (a.where(F.col("a.u") % RAMP_EVERY == 0)
             .join(users.alias("b"), F.col("b.u") == F.col("a.u") + F.lit(RAMP_EVERY))
             .select(F.col("a.u").alias("su"), F.col("b.u").alias("du")))
    pairs = chain.unionByName(ramps)
    return conform(pairs.select(
        detector_id(F.col("su")).alias("src"),
        detector_id(F.col("du")).alias("dst"),
        F.col("su").cast("double").alias("src_X"),
        F.lit(0.0).alias("src_Y"),
        F.col("du").cast("double").alias("dst_X"),
        F.lit(0.0).alias("dst_Y"),
        (F.col("du") == F.col("su") + F.lit(1)).alias("same_road"),
        F.lit(False).alias("is_dummy"),
    ), EDGE_SCHEMA)


def measurements_from_events(events: DataFrame, bucket: str = "day") -> DataFrame:
    """One measurement per event, time truncated to ``bucket``."""
    return conform(events.select(
        F.date_trunc(bucket, F.col("ts")).cast("timestamp").alias("eventTime"),
        detector_id(F.col("user_id")).alias("detectorId"),
        F.lit("R1").alias("road"),
        F.lit(0).alias("kmRef"),
        F.lit(1).alias("detectorNumber"),
        F.lit(0).alias("flowIn"),
        F.floor(F.col("value")).cast("int").alias("averageSpeed"),
        F.col("value").cast("double").alias("density"),
        F.lit(FREE_FLOW_KMH).alias("vFreeflowMin"),
        F.lit(0).alias("congestionClass"),
    ), MEASUREMENT_SCHEMA)


def road_tables(spark: SparkSession, sf_dir: str, bucket: str = "day") -> tuple[DataFrame, DataFrame]:
    """``(edges, measurements)`` bound to the events table under ``sf_dir``."""
    events = load_events(spark, sf_dir)
    return edges_from_events(events), measurements_from_events(events, bucket)
