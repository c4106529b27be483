"""Congested components at every congestion class at once.

A component at class ``c`` joins the edges of class ``c`` and above, so components of a
lower class contain those of a higher one. Everything that is needed for all classes
lies in a maximum spanning forest of each event time's edges, found by Boruvka
rounds: every component picks its highest edge, the picks are contracted by the
connected components operator, and of parallel edges only the highest stays. The
forest has fewer edges than vertices, so labelling its edges once per
class they reach costs at most ``vertices x classes`` rows, however many edges were measured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.constants import CONGESTION_THRESHOLDS
from trafficgraph.operators.components import connected_components
from trafficgraph.operators.graph import RoadGraph
from trafficgraph.operators.materialize import drop_table, write_table
from trafficgraph.operators.placement import place_on_edges
from trafficgraph.plans.congested import CLASS_COLUMN, with_congestion_class
from trafficgraph.sources.measurements import bucketed, valid_measurements

CLASS = "congestionClass"
NO_PARENT = -1


def edge_classes(measurements: DataFrame, graph: RoadGraph,
                 thresholds: Sequence[float] = CONGESTION_THRESHOLDS) -> DataFrame:
    """``(eventTime, src, dst, congestionClass)``: the highest class measured on each edge."""
    m = with_congestion_class(valid_measurements(measurements), thresholds)
    m = m.where(F.col(CLASS_COLUMN).isNotNull()).select("eventTime", "detectorId", CLASS_COLUMN)
    return (place_on_edges(m, graph.side("encoded", "dst", "srcNumericId", "dstNumericId"))
            .groupBy("eventTime", F.col("srcNumericId").alias("src"), F.col("dstNumericId").alias("dst"))
            .agg(F.max(CLASS_COLUMN).alias(CLASS)))


def maximum_spanning_forest(edges: DataFrame, weight: str, src: str = "src", dst: str = "dst",
                            keys: Sequence[str] = ("eventTime",)) -> DataFrame:
    """``(*keys, src, dst, weight)`` of a maximum spanning forest of each keyed graph.

    Edges of equal weight are ordered by their ends, so every run picks the same
    forest and no round's picks close a circle. Self-loops and null ends are left out.
    """
    k, spark = list(keys), edges.sparkSession
    edge = F.struct(F.col(weight).alias("w"), F.greatest(src, dst).alias("x"),
                    F.least(src, dst).alias("y"))
    best = F.max("_e").alias("_e")
    live, path = write_table(
        edges.where((F.col(src) != F.col(dst)) & F.col(weight).isNotNull())
        .select(*k, F.least(src, dst).alias("_a"), F.greatest(src, dst).alias("_b"), edge.alias("_e"))
        .groupBy(*k, "_a", "_b").agg(best))
    picked: list[DataFrame] = []
    while live.limit(1).count():
        both = (live.select(*k, F.col("_a").alias("_u"), "_a", "_b", "_e")
                .unionByName(live.select(*k, F.col("_b").alias("_u"), "_a", "_b", "_e")))
        picks, _ = write_table(both.groupBy(*k, "_u")
                               .agg(F.max(F.struct("_e", "_a", "_b")).alias("_p"))
                               .select(*k, F.col("_p._e").alias("_e"), F.col("_p._a").alias("_a"),
                                       F.col("_p._b").alias("_b")).distinct())
        picked.append(picks)
        label, _ = write_table(connected_components(picks, "_a", "_b", k, vertex="_v", component="_l",
                                                    nearby=True))
        for end in ("_a", "_b"):
            live = (live.join(label.withColumnRenamed("_v", end), [*k, end])
                    .drop(end).withColumnRenamed("_l", end))
        contracted = (live.where(F.col("_a") != F.col("_b"))
                      .select(*k, F.least("_a", "_b").alias("_x"), F.greatest("_a", "_b").alias("_y"), "_e")
                      .groupBy(*k, F.col("_x").alias("_a"), F.col("_y").alias("_b")).agg(best))
        live, last = write_table(contracted)
        drop_table(spark, path)
        path = last
    if not picked:
        return live.select(*k, F.col("_a").alias(src), F.col("_b").alias(dst), F.col("_e.w").alias(weight))
    forest = picked[0]
    for more in picked[1:]:
        forest = forest.unionByName(more)
    return forest.select(*k, F.col("_e.y").alias(src), F.col("_e.x").alias(dst), F.col("_e.w").alias(weight))


def components_by_class(classed: DataFrame, classes: Sequence[int]) -> DataFrame:
    """``(congestionClass, eventTime, vertexId, componentId)`` for each of ``classes``: its
    slice is the result of ``congested_components`` with that threshold."""
    forest = maximum_spanning_forest(classed, CLASS)
    loops = classed.where(F.col("src") == F.col("dst"))     # vertices no forest edge reaches
    reach = F.filter(F.array(*[F.lit(int(c)) for c in sorted(classes)]), lambda c: c <= F.col(CLASS))
    rows = (forest.unionByName(loops.select(*forest.columns))
            .select("eventTime", "src", "dst", F.explode(reach).alias(CLASS)))
    cc = connected_components(rows, "src", "dst", [CLASS, "eventTime"], nearby=True)
    return cc.select(CLASS, "eventTime", F.col("vertexId").cast("int").alias("vertexId"),
                     F.col("componentId").cast("int").alias("componentId"))


def nesting(labels: DataFrame) -> DataFrame:
    """The tree of components: ``(congestionClass, eventTime, componentId, vertices,
    parentId)``; the parent is the component of the next lower class that contains it
    (``NO_PARENT`` at the lowest class)."""
    parts = labels.groupBy(CLASS, "eventTime", "componentId").agg(F.count(F.lit(1)).alias("vertices"))
    lower = labels.groupBy().agg(F.sort_array(F.collect_set(CLASS)).alias("_all"))    # one row, a few classes
    classes = [int(c) for c in (lower.first()["_all"] or [])]
    below = F.lit(None).cast("int")
    for low, high in zip(classes, classes[1:]):
        below = F.when(F.col(CLASS) == high, F.lit(low)).otherwise(below)
    up = labels.select(F.col(CLASS).alias("_below"), "eventTime", F.col("vertexId").alias("componentId"),
                      F.col("componentId").alias("parentId"))
    return (parts.withColumn("_below", below)
            .join(up, ["_below", "eventTime", "componentId"], "left")
            .select(CLASS, "eventTime", "componentId", "vertices",
                    F.coalesce("parentId", F.lit(NO_PARENT)).alias("parentId")))


def congestion_hierarchy(measurements: DataFrame, graph: RoadGraph, classes: Sequence[int],
                         bucket: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels at every class, and the tree they form, for all event times at once."""
    labels = components_by_class(edge_classes(bucketed(measurements, bucket), graph), classes)
    labels, _ = write_table(labels)
    return labels, nesting(labels)
