"""Vertex table of the road graph and numeric vertex ids (encode / decode: ``RoadGraph``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.operators.numbering import dense_number


def road_vertices(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every sensor that is an end of some edge, once: ``id string``."""
    return (edges.select(F.col(src).alias("id"))
            .union(edges.select(F.col(dst).alias("id")))
            .where(F.col("id").isNotNull())
            .distinct())


def vertex_numeric_ids(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``numericId int, id string``: 1-based, in order of ``id``.

    Materialised once (a written table inside the numbering), so the three
    consumers (two encode joins, one decode join) see the same numbers.
    """
    numbered = dense_number(road_vertices(edges, src, dst), "id", name="numericId")
    return numbered.select(F.col("numericId").cast("int").alias("numericId"), "id")
