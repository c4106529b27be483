"""DenGraph, batch: density clusters of sensors per event time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.constants import DENGRAPH_EPSILON, DENGRAPH_ETA, DENGRAPH_WEIGHT_FIELD
from trafficgraph.functions.output import with_key
from trafficgraph.operators.density import dengraph_clusters, with_distance
from trafficgraph.operators.graph import RoadGraph
from trafficgraph.operators.placement import place_on_edges
from trafficgraph.sources.measurements import bucketed, valid_measurements


def weighted_edges(measurements: DataFrame, edges: DataFrame | RoadGraph,
                   weight_field: str = DENGRAPH_WEIGHT_FIELD) -> DataFrame:
    """``(eventTime, src, dst, weight)``: a measurement field on each in-edge."""
    graph = edges if isinstance(edges, RoadGraph) else RoadGraph.build(edges, with_ids=False)
    m = valid_measurements(measurements).select("eventTime", "detectorId", weight_field)
    placed = place_on_edges(m, graph.side("edges", "src", "dst"))
    return placed.select("eventTime", "src", "dst", F.col(weight_field).cast("double").alias("weight"))


@dataclass
class DengraphResult:
    weighted: DataFrame     # eventTime, src, dst, weight, distance
    clusters: DataFrame     # clusterId, eventTime, final, vertexId, vertexType
    keyed: DataFrame        # + key


def dengraph(measurements: DataFrame, edges: DataFrame | RoadGraph,
             weight_field: str = DENGRAPH_WEIGHT_FIELD, eps: float = DENGRAPH_EPSILON,
             eta: int = DENGRAPH_ETA, final: bool = True,
             bucket: str | None = None) -> DengraphResult:
    """The whole batch job, every event time (truncated to ``bucket``) at once.

    Call and consume it inside ``table_scope()`` to drop its tables and caches.
    """
    w = weighted_edges(bucketed(measurements, bucket), edges, weight_field)
    c = dengraph_clusters(w, eps, eta, ["eventTime"])
    clusters = c.select("clusterId", "eventTime", F.lit(bool(final)).alias("final"),
                        "vertexId", "vertexType")
    return DengraphResult(with_distance(w), clusters, with_key(clusters, "vertexId"))
