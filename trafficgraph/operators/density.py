"""DenGraph density clustering of many graphs at once, order-free.

Per graph (one per key, i.e. per event time):

1. ``distance(src, dst)`` is the smallest distance measured on that ordered
   pair (``min`` needs no arrival order; negative weights give negative
   distances, so it is ``min`` distance and not ``max`` weight).
2. Neighbour rows: each pair within ``eps``, in both directions; a
   self-loop counts once. A reciprocal pair therefore counts twice.
3. CORE: at least ``eta`` neighbour rows.
4. Clusters: connected components of cores over core-core neighbour rows;
   a cluster is named by its smallest core.
5. BORDER: a non-core vertex with a core neighbour; it joins the adjacent
   cluster whose smallest core is smallest.
6. NOISE: every other end point of a measured edge, cluster -1.
7. ``clusterId``: 0-based dense rank of the cluster's smallest core within
   the graph.

Everything is keyed by ``(*keys, vertex)`` and computed with aggregations and
equi-joins, reusing the distributed connected components for step 4.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.constants import (BORDER, CORE, DENGRAPH_EPSILON, DENGRAPH_ETA, NOISE,
                                    NOISE_CLUSTER_ID)
from trafficgraph.functions.distance import proximity_distance
from trafficgraph.operators.components import connected_components
from trafficgraph.operators.materialize import materialize
from trafficgraph.operators.numbering import dense_number
from trafficgraph.operators.skew import (DEFAULT_HOT_ROWS, hot_keys, hot_threshold,
                                         salted_join)


def with_distance(weighted: DataFrame, src: str = "src", dst: str = "dst",
                  weight: str = "weight") -> DataFrame:
    return weighted.withColumn("distance", proximity_distance(src, dst, weight))


def edge_distances(weighted: DataFrame, keys: Sequence[str] = ("eventTime",), src: str = "src",
                   dst: str = "dst", weight: str = "weight") -> DataFrame:
    """``(*keys, src, dst, distance)``: smallest distance per ordered pair."""
    k = list(keys)
    d = weighted.select(*k, src, dst, proximity_distance(src, dst, weight).alias("distance"))
    return d.groupBy(*k, src, dst).agg(F.min("distance").alias("distance"))


def epsilon_edges(weighted: DataFrame, eps: float = DENGRAPH_EPSILON,
                  keys: Sequence[str] = ("eventTime",), src: str = "src", dst: str = "dst",
                  weight: str = "weight") -> DataFrame:
    """Ordered pairs whose smallest distance is within ``eps``."""
    return edge_distances(weighted, keys, src, dst, weight).where(F.col("distance") <= F.lit(eps))


def neighbour_rows(near: DataFrame, keys: Sequence[str] = ("eventTime",), src: str = "src",
                   dst: str = "dst") -> DataFrame:
    """``(*keys, vertexId, neighbourId)``: both directions, a self-loop once."""
    k = list(keys)
    fwd = near.select(*k, F.col(src).alias("vertexId"), F.col(dst).alias("neighbourId"))
    back = (near.where(F.col(src) != F.col(dst))
            .select(*k, F.col(dst).alias("vertexId"), F.col(src).alias("neighbourId")))
    return fwd.unionByName(back)


def neighbourhood_sizes(nb: DataFrame, keys: Sequence[str] = ("eventTime",)) -> DataFrame:
    """``(*keys, vertexId, neighbourhoodSize)`` for vertices with a neighbour."""
    k = list(keys)
    return nb.groupBy(*k, "vertexId").agg(F.count(F.lit(1)).cast("int").alias("neighbourhoodSize"))


def core_vertices(nb: DataFrame, eta: int = DENGRAPH_ETA,
                  keys: Sequence[str] = ("eventTime",)) -> DataFrame:
    """``(*keys, vertexId, neighbourhoodSize)`` of vertices with ``>= eta`` neighbour rows."""
    return neighbourhood_sizes(nb, keys).where(F.col("neighbourhoodSize") >= F.lit(int(eta)))


def _if_any(hot: DataFrame) -> DataFrame | None:
    """``hot`` when it has a row (one scalar action), else None (plain joins)."""
    return hot if hot.limit(1).count() else None


def dengraph_clusters(weighted: DataFrame, eps: float = DENGRAPH_EPSILON, eta: int = DENGRAPH_ETA,
                      keys: Sequence[str] = ("eventTime",), src: str = "src", dst: str = "dst",
                      weight: str = "weight", hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """``(clusterId int, *keys, vertexId, vertexType)`` for every edge end point."""
    pairs = edge_distances(weighted, keys, src, dst, weight)
    return clusters_from_distances(pairs, eps, eta, keys, src, dst, hot_rows=hot_rows)


def clusters_from_distances(pairs: DataFrame, eps: float = DENGRAPH_EPSILON,
                            eta: int = DENGRAPH_ETA, keys: Sequence[str] = ("eventTime",),
                            src: str = "src", dst: str = "dst",
                            distance: str = "distance",
                            hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Clusters from ``(*keys, src, dst, distance)``, one smallest distance per pair.

    Every pair's ends are reported, also far pairs and pairs without a distance.
    Neighbour rows are joined on both of their vertices; a vertex with more
    than ``hot_rows`` neighbour rows is split over several tasks there.
    """
    k = list(keys)
    # Read the input once: the checks, the components rounds and the final
    # labelling all start from this table in the checkpoint folder.
    pairs = materialize(pairs.select(*k, src, dst, distance))
    # A vertex has at most 2 * pairs neighbour rows and a cluster at most
    # 2 * pairs vertices: small inputs skip the hot-key checks (the count
    # reads parquet metadata only).
    n_pairs = pairs.count()
    hot_from = hot_threshold(2 * n_pairs, hot_rows)
    may_be_hot = 2 * n_pairs > hot_rows
    # Neighbour rows and sizes are each used several times: written once.
    nb = materialize(neighbour_rows(pairs.where(F.col(distance) <= F.lit(eps)), k, src, dst))
    sizes = materialize(neighbourhood_sizes(nb, k))
    core = sizes.where(F.col("neighbourhoodSize") >= F.lit(int(eta))).select(*k, "vertexId")
    # Neighbour rows are symmetric: a vertex has as many rows as neighbour.
    # One scalar action decides whether any vertex is hot; usually none is
    # and the joins stay plain.
    hot_v = (_if_any(hot_keys(sizes, [*k, "vertexId"], "neighbourhoodSize", hot_from))
             if may_be_hot else None)
    hot_n = None if hot_v is None else hot_v.withColumnRenamed("vertexId", "neighbourId")

    def by_vertex(big, small, how):
        return salted_join(big, small, [*k, "vertexId"], hot_v, ["neighbourId"], how)

    def by_neighbour(big, small, how):
        return salted_join(big, small, [*k, "neighbourId"], hot_n, ["vertexId"], how)

    # Clusters: components of cores over core-core rows, one direction of each;
    # every core also enters as a self-loop so that isolated cores form their
    # own cluster.
    one_way = nb.where(F.col("vertexId") < F.col("neighbourId"))
    core_rows = by_neighbour(by_vertex(one_way, core, "left_semi"),
                             core.withColumnRenamed("vertexId", "neighbourId"), "left_semi")
    cc_in = (core_rows.select(*k, "vertexId", "neighbourId")
             .unionByName(core.select(*k, "vertexId", F.col("vertexId").alias("neighbourId"))))
    core_labels = materialize(connected_components(cc_in, "vertexId", "neighbourId", k,
                                                   vertex="vertexId", component="_cluster",
                                                   hot_rows=hot_rows, nearby=True))
    border = (by_neighbour(by_vertex(nb, core, "left_anti"),
                           core_labels.withColumnRenamed("vertexId", "neighbourId"), "inner")
              .groupBy(*k, "vertexId").agg(F.min("_cluster").alias("_cluster")))
    # Only vertices with a cluster meet the ranks; noise is added by a union, so
    # no join ever has the (null) key that most vertices would share.
    clustered = materialize(core_labels.withColumn("vertexType", F.lit(CORE))
                            .unionByName(border.withColumn("vertexType", F.lit(BORDER))))
    ranks = dense_number(core_labels.select(*k, "_cluster").distinct(), "_cluster", k, name="_rank")
    hot_c = None
    if may_be_hot:
        load = clustered.groupBy(*k, "_cluster").agg(F.count(F.lit(1)).alias("_rows"))
        hot_c = _if_any(hot_keys(load, [*k, "_cluster"], "_rows", hot_from))
    ranked = (salted_join(clustered, ranks, [*k, "_cluster"], hot_c, ["vertexId"])
              .select((F.col("_rank") - F.lit(1)).cast("int").alias("clusterId"), *k, "vertexId",
                      "vertexType"))
    ends = (pairs.select(*k, F.col(src).alias("vertexId"))
            .unionByName(pairs.select(*k, F.col(dst).alias("vertexId")))
            .where(F.col("vertexId").isNotNull())
            .distinct())
    noise = (ends.join(clustered.select(*k, "vertexId"), [*k, "vertexId"], "left_anti")
             .select(F.lit(NOISE_CLUSTER_ID).cast("int").alias("clusterId"), *k, "vertexId",
                     F.lit(NOISE).alias("vertexType")))
    return ranked.unionByName(noise)
