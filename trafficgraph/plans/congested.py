"""Congested components, batch: which sensors are jammed together per event time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.constants import CONGESTION_CLASS_THRESHOLD, CONGESTION_THRESHOLDS
from trafficgraph.functions.congestion import congestion_class
from trafficgraph.functions.output import with_key
from trafficgraph.operators.components import connected_components
from trafficgraph.operators.graph import RoadGraph
from trafficgraph.operators.placement import place_on_edges
from trafficgraph.sources.measurements import bucketed, valid_measurements

CLASS_COLUMN = "congestionClassStreaming"


def with_congestion_class(measurements: DataFrame,
                          thresholds: Sequence[float] = CONGESTION_THRESHOLDS) -> DataFrame:
    """All measurement columns plus the recomputed class."""
    return measurements.withColumn(CLASS_COLUMN, congestion_class(thresholds=thresholds))


def measurements_on_edges(measurements: DataFrame, graph: RoadGraph,
                          thresholds: Sequence[float] = CONGESTION_THRESHOLDS) -> DataFrame:
    """Classed measurements joined to every id-encoded edge ending at their sensor."""
    m = with_congestion_class(valid_measurements(measurements), thresholds)
    return place_on_edges(m, graph.side("encoded"))


def congested_edges(measurements: DataFrame, graph: RoadGraph,
                    threshold: int = CONGESTION_CLASS_THRESHOLD,
                    thresholds: Sequence[float] = CONGESTION_THRESHOLDS) -> DataFrame:
    """``(eventTime, src int, dst int)``: measured edges at class >= threshold.

    The filter is a ``Column`` on measurement columns only, so the optimizer
    applies it before the join with the edges, and only the three needed
    measurement columns are read.
    """
    m = with_congestion_class(valid_measurements(measurements), thresholds)
    m = m.where(F.col(CLASS_COLUMN) >= F.lit(int(threshold))).select("eventTime", "detectorId")
    return (place_on_edges(m, graph.side("encoded", "dst", "srcNumericId", "dstNumericId"))
            .select("eventTime", F.col("srcNumericId").alias("src"),
                    F.col("dstNumericId").alias("dst")))


def component_labels(cc_edges: DataFrame, final: bool = True) -> DataFrame:
    """``componentId, eventTime, final, vertexId`` (int ids) for congested edges."""
    cc = connected_components(cc_edges, "src", "dst", ["eventTime"], nearby=True)
    return cc.select(F.col("componentId").cast("int").alias("componentId"), "eventTime",
                     F.lit(bool(final)).alias("final"),
                     F.col("vertexId").cast("int").alias("vertexId"))


def register_views(graph: RoadGraph, result: "CongestedComponentsResult") -> list[str]:
    """Temporary views for SQL over the job's tables; returns their names."""
    views = {"road_edges": graph.edges, "vertex_ids": graph.ids, "congested_edges": result.edges,
             "congested_components": result.decoded}
    for name, df in views.items():
        if df is not None:
            df.createOrReplaceTempView(name)
    return [name for name, df in views.items() if df is not None]


@dataclass
class CongestedComponentsResult:
    graph: RoadGraph
    edges: DataFrame        # eventTime, src, dst (numeric, congested)
    labels: DataFrame       # componentId, eventTime, final, vertexId
    decoded: DataFrame      # + id
    keyed: DataFrame        # + key


def congested_components(measurements: DataFrame, edges: DataFrame | RoadGraph,
                         threshold: int = CONGESTION_CLASS_THRESHOLD,
                         thresholds: Sequence[float] = CONGESTION_THRESHOLDS,
                         bucket: str | None = None) -> CongestedComponentsResult:
    """The whole batch job, every event time (truncated to ``bucket``) at once.

    Call and consume it inside ``table_scope()`` to drop its tables and caches.
    """
    graph = edges if isinstance(edges, RoadGraph) else RoadGraph.build(edges)
    ce = congested_edges(bucketed(measurements, bucket), graph, threshold, thresholds)
    labels = component_labels(ce)
    decoded = graph.decode(labels)
    return CongestedComponentsResult(graph, ce, labels, decoded, with_key(decoded, "id"))
