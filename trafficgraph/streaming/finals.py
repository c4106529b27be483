"""Final labels at any graph size: per-edge state, distributed labelling.

The stream keeps one aggregate row per ``(eventTime, src, dst)`` in the
state store (spread over all state partitions) and emits it in **append**
mode once the watermark passes its event time. The watermark is global, so
every edge of an event time leaves the state in the same micro-batch; each
micro-batch then goes through the distributed batch operators in
``foreachBatch``. Each event time gets exactly one final result. Rows later
than the watermark are dropped by Spark and counted in the progress.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.constants import (CONGESTION_CLASS_THRESHOLD, CONGESTION_THRESHOLDS,
                                    DENGRAPH_EPSILON, DENGRAPH_ETA, DENGRAPH_WEIGHT_FIELD,
                                    WATERMARK_DELAY)
from trafficgraph.functions.distance import proximity_distance
from trafficgraph.functions.output import with_key
from trafficgraph.operators.density import clusters_from_distances
from trafficgraph.operators.graph import RoadGraph
from trafficgraph.operators.materialize import table_scope
from trafficgraph.operators.placement import place_on_edges
from trafficgraph.plans.congested import CLASS_COLUMN, component_labels, with_congestion_class
from trafficgraph.streaming.jobs import watermarked

BatchSink = Callable[[DataFrame, int], None]


# Rows without a congested edge are spread over this many keys that no sensor has.
_CALM_KEYS = 1024


def marked_congested_edges(measurements: DataFrame, graph: RoadGraph,
                           threshold: int = CONGESTION_CLASS_THRESHOLD,
                           thresholds: Sequence[float] = CONGESTION_THRESHOLDS,
                           watermark_delay: str = WATERMARK_DELAY,
                           bucket: str | None = None) -> DataFrame:
    """``(eventTime, src, dst, measurements)`` per congested edge, and one marker row
    (``src`` and ``dst`` null) per event time with calm rows.

    Nothing is filtered before the aggregation, so calm periods move the
    watermark; partial aggregation folds their rows to one marker each. Calm
    rows join on keys that match no edge, spread so that they are no hot key.
    """
    m = with_congestion_class(watermarked(measurements, watermark_delay, bucket), thresholds)
    jammed = F.coalesce(F.col(CLASS_COLUMN) >= F.lit(int(threshold)), F.lit(False))
    calm = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("detectorId"), F.lit(_CALM_KEYS)).cast("string"))
    keyed = m.select("eventTime", F.when(jammed, F.col("detectorId")).otherwise(calm).alias("detectorId"))
    placed = place_on_edges(keyed, graph.side("encoded", "dst", "srcNumericId", "dstNumericId"), how="left")
    return (placed.groupBy("eventTime", F.col("srcNumericId").alias("src"),
                           F.col("dstNumericId").alias("dst"))
            .agg(F.count(F.lit(1)).alias("measurements")))


def marked_edge_distances(measurements: DataFrame, graph: RoadGraph,
                          weight_field: str = DENGRAPH_WEIGHT_FIELD,
                          watermark_delay: str = WATERMARK_DELAY,
                          bucket: str | None = None) -> DataFrame:
    """``(eventTime, src, dst, distance)``: smallest distance per pair, and one marker row
    (``src`` and ``dst`` null) per event time with sensors that end no edge."""
    m = (watermarked(measurements, watermark_delay, bucket)
         .select("eventTime", "detectorId", F.col(weight_field).cast("double").alias("weight")))
    placed = place_on_edges(m, graph.side("edges", "src", "dst"), how="left")
    return (placed.select("eventTime", "src", "dst",
                          proximity_distance("src", "dst", "weight").alias("distance"))
            .groupBy("eventTime", "src", "dst").agg(F.min("distance").alias("distance")))


def final_congested_edges(measurements: DataFrame, graph: RoadGraph,
                          threshold: int = CONGESTION_CLASS_THRESHOLD,
                          thresholds: Sequence[float] = CONGESTION_THRESHOLDS,
                          watermark_delay: str = WATERMARK_DELAY,
                          bucket: str | None = None) -> DataFrame:
    """``(eventTime, src, dst, measurements)`` once per congested edge; append mode."""
    return marked_congested_edges(measurements, graph, threshold, thresholds, watermark_delay,
                                  bucket).where(F.col("src").isNotNull())


def final_edge_distances(measurements: DataFrame, graph: RoadGraph,
                         weight_field: str = DENGRAPH_WEIGHT_FIELD,
                         watermark_delay: str = WATERMARK_DELAY,
                         bucket: str | None = None) -> DataFrame:
    """``(eventTime, src, dst, distance)``: smallest distance per pair; append mode."""
    return marked_edge_distances(measurements, graph, weight_field, watermark_delay,
                                 bucket).where(F.col("src").isNotNull())


def components_handler(graph: RoadGraph, sink: BatchSink) -> BatchSink:
    """``foreachBatch`` function: label one batch of final edges and pass it on."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        with table_scope():   # the labels are consumed by the sink
            labels = component_labels(batch.select("eventTime", "src", "dst"), final=True)
            sink(with_key(graph.decode(labels), "id"), batch_id)
    return handle


def clusters_handler(sink: BatchSink, eps: float = DENGRAPH_EPSILON,
                     eta: int = DENGRAPH_ETA) -> BatchSink:
    """``foreachBatch`` function: cluster one batch of final pair distances."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        with table_scope():   # the labels are consumed by the sink
            c = clusters_from_distances(batch, eps, eta, ["eventTime"])
            out = c.select("clusterId", "eventTime", F.lit(True).alias("final"), "vertexId",
                           "vertexType")
            sink(with_key(out, "vertexId"), batch_id)
    return handle
