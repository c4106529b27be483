"""The static road graph, materialised once with its sizes known."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.operators.materialize import (DEFAULT_BROADCAST_MAX_BYTES, Size, broadcast_within,
                                                materialize_sized)
from trafficgraph.operators.numbering import dense_number
from trafficgraph.operators.vertices import road_vertices


@dataclass
class RoadGraph:
    """Edges, numeric vertex ids and id-encoded edges of one road network.

    All three are written to the shared checkpoint folder once, so the
    batch jobs, the stream-static joins and the decode join read the same
    numbers without recomputing them, and their measured sizes decide whether a
    join may ship the columns it needs to every executor.
    """

    edges: DataFrame                # src, dst, ... (edge schema)
    ids: DataFrame | None           # numericId int, id string
    encoded: DataFrame | None       # edges + srcNumericId, dstNumericId
    sizes: dict[str, Size]
    broadcast_max_bytes: int | None = DEFAULT_BROADCAST_MAX_BYTES

    @classmethod
    def build(cls, edges: DataFrame, src: str = "src", dst: str = "dst",
              broadcast_max_bytes: int | None = DEFAULT_BROADCAST_MAX_BYTES,
              with_ids: bool = True) -> "RoadGraph":
        """Materialise ``edges``; with ``with_ids`` also number and encode vertices."""
        e, edge_size = materialize_sized(edges)
        if not with_ids:
            return cls(e, None, None, {"edges": edge_size}, broadcast_max_bytes)
        numbered = dense_number(road_vertices(e, src, dst), "id", name="numericId")
        ids, id_size = materialize_sized(
            numbered.select(F.col("numericId").cast("int").alias("numericId"), "id"))
        small_ids = broadcast_within(ids, id_size, broadcast_max_bytes)
        s = small_ids.select(F.col("id").alias("_sid"), F.col("numericId").alias("srcNumericId"))
        d = small_ids.select(F.col("id").alias("_did"), F.col("numericId").alias("dstNumericId"))
        encoded, size = materialize_sized(e.join(s, F.col(src) == F.col("_sid")).drop("_sid")
                                          .join(d, F.col(dst) == F.col("_did")).drop("_did"))
        sizes = {"edges": edge_size, "ids": id_size, "encoded": size}
        return cls(e, ids, encoded, sizes, broadcast_max_bytes)

    @property
    def edge_count(self) -> int:
        return self.sizes["edges"].rows

    def side(self, which: str = "encoded", *columns: str) -> DataFrame:
        """Columns of a static table for a join, hinted as broadcast when their size allows."""
        df = getattr(self, which)
        if df is None:
            raise ValueError(f"graph was built without {which!r}")
        return broadcast_within(df.select(*columns) if columns else df, self.sizes[which],
                                self.broadcast_max_bytes)

    def decode(self, df: DataFrame, vertex: str = "vertexId") -> DataFrame:
        """Add the string ``id`` of a numeric vertex column (inner join)."""
        ids = self.side("ids")
        return df.join(ids, F.col(vertex) == ids["numericId"]).drop("numericId")
