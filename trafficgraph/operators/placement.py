"""Place measurements on the graph: every edge whose ``dst`` is the sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def place_on_edges(measurements: DataFrame, edges: DataFrame, detector: str = "detectorId",
                   dst: str = "dst", how: str = "inner") -> DataFrame:
    """Join ``detector = dst``: one row per measurement and in-edge.

    With ``how="inner"`` sensors without an in-edge drop out; with ``"left"``
    they keep one row without an edge. ``edges`` comes from
    ``RoadGraph.side``, broadcast when its measured size is under the bound, so
    a sensor holding a large share of all measurements causes no skewed
    shuffle; above the bound the join shuffles and adaptive execution splits
    skewed keys. Works for a streaming ``measurements`` frame as well.
    """
    return measurements.join(edges, F.col(detector) == edges[dst], how)
