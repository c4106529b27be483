"""Identity of clusters over time: matching of consecutive versions by overlap.

Cluster ids are ranks within one event time; a cluster that lives on has another id
at the next one. Here clusters of consecutive event times that share vertices
are matched: each cluster names as successor the later cluster that took most of its
vertices, and as predecessor the earlier one that most of its own came from
(ties: the smaller cluster id). A pair that names each other is one cluster; chains of
such pairs form a track, named after its first cluster. What else happened is
recorded: a cluster whose predecessor went on as another one *split* off, and
predecessors that name a successor which goes on from another one *merged* into it.

All steps are joins and aggregations on ``(time, vertex)`` or ``(time, cluster)``; tracks
are found by the components operator over the chains, so their length does not
matter, and nothing depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.operators.components import connected_components
from trafficgraph.operators.materialize import materialize
from trafficgraph.operators.numbering import dense_number

START, CONTINUE, SPLIT = "START", "CONTINUE", "SPLIT"


def _node(step: str, cluster: str) -> F.Column:
    """A name that sorts by time, then cluster."""
    return F.format_string("%010d.%010d", F.col(step).cast("long"), F.col(cluster).cast("long"))


def overlaps(members: DataFrame) -> DataFrame:
    """``(step, cluster, next, shared)``: vertices that clusters of consecutive steps share."""
    later = members.select((F.col("step") - 1).alias("step"), "vertex", F.col("cluster").alias("next"))
    return (members.join(later, ["step", "vertex"])
            .groupBy("step", "cluster", "next").agg(F.count(F.lit(1)).alias("shared")))


def track_clusters(clusters: DataFrame, time: str = "eventTime", cluster: str = "clusterId",
                   vertex: str = "vertexId") -> DataFrame:
    """``(time, cluster, trackId, origin, merged, vertices)`` for every cluster.

    ``clusters`` has one row per member vertex; rows with a null or negative cluster
    (noise) are left out. Event times are consecutive in the order of those that
    have a cluster. ``trackId`` is ``<step>.<cluster>`` of the track's first cluster,
    ``merged`` the number of earlier clusters that ended in this one.
    """
    rows = materialize(clusters.where(F.col(cluster) >= 0)
                       .select(F.col(time).alias("time"), F.col(cluster).alias("cluster"),
                               F.col(vertex).alias("vertex")))
    steps = dense_number(rows.select("time").distinct(), "time", name="step")
    members = materialize(rows.join(steps, "time"))
    shared = materialize(overlaps(members))

    def named(by: list[str], other: str, name: str) -> DataFrame:
        first = F.min(F.struct(-F.col("shared"), F.col(other))).alias("_best")
        return shared.groupBy(*by).agg(first).select(*by, F.col(f"_best.{other}").alias(name))

    successor = named(["step", "cluster"], "next", "next")
    predecessor = named(["step", "next"], "cluster", "cluster")
    kept = materialize(successor.join(predecessor, ["step", "cluster", "next"]))
    chain = kept.select(_node("step", "cluster").alias("a"),
                        F.format_string("%010d.%010d", (F.col("step") + 1).cast("long"),
                                        F.col("next").cast("long")).alias("b"))
    track = connected_components(chain, "a", "b", keys=(), vertex="node", component="trackId",
                                 nearby=True)
    at_next = [(F.col("step") + 1).alias("step"), F.col("next").alias("cluster")]
    merged = (successor.join(kept, ["step", "cluster", "next"], "left_anti")
              .groupBy(*at_next).agg(F.count(F.lit(1)).alias("merged")))
    came = predecessor.select(*at_next, F.lit(True).alias("_had"))
    went_on = kept.select(*at_next, F.lit(True).alias("_same"))
    nodes = (members.groupBy("time", "step", "cluster").agg(F.count(F.lit(1)).alias("vertices"))
             .withColumn("node", _node("step", "cluster")))
    origin = (F.when(F.col("_same"), F.lit(CONTINUE)).when(F.col("_had"), F.lit(SPLIT))
              .otherwise(F.lit(START)))
    return (nodes.join(track, "node", "left").join(merged, ["step", "cluster"], "left")
            .join(came, ["step", "cluster"], "left").join(went_on, ["step", "cluster"], "left")
            .select(F.col("time").alias(time), F.col("cluster").alias(cluster),
                    F.coalesce("trackId", "node").alias("trackId"), origin.alias("origin"),
                    F.coalesce("merged", F.lit(0)).cast("long").alias("merged"), "vertices"))
