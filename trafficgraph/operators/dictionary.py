"""An append-only dictionary of vertex numbers, in versions.

``RoadGraph`` numbers the vertices of one road network by their order, so a new
sensor renumbers all that sort after it, and ids written earlier mean something
else. Here a vertex keeps its number: each extension numbers only vertices that
no earlier version holds, in the next free range, so numbers stay dense and
every earlier result still decodes. A version is a folder ``version=N`` of
``(numericId, id)``; it counts once its commit file is there, and an extension that
fails half-way is overwritten by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficgraph.operators.materialize import path_exists
from trafficgraph.operators.numbering import dense_number
from trafficgraph.operators.vertices import road_vertices

SCHEMA = T.StructType([T.StructField("numericId", T.LongType()), T.StructField("id", T.StringType()),
                       T.StructField("version", T.IntegerType())])


class VertexDictionary:
    """The dictionary below ``path`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={int(version)}"

    def version(self) -> int:
        """The newest committed version, 0 for an empty dictionary."""
        n = 0
        while path_exists(self.spark, f"{self._folder(n + 1)}/_SUCCESS"):
            n += 1
        return n

    def vertices(self, version: int | None = None) -> DataFrame:
        """``(numericId, id, version)`` as of a version (default: the newest)."""
        last = self.version() if version is None else int(version)
        folders = [self._folder(v) for v in range(1, last + 1)]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*folders)

    def extend(self, edges: DataFrame, src: str = "src", dst: str = "dst") -> int:
        """Number the vertices of ``edges`` that have no number yet; returns the version.

        Old vertices are not sorted or numbered again: the ends of the edges meet them in
        one anti join, and the new ones take the range after the largest number.
        """
        known = self.vertices()
        new = road_vertices(edges, src, dst).join(known.select("id"), "id", "left_anti")
        if not new.limit(1).count():
            return self.version()
        taken = known.agg(F.max("numericId")).first()[0] or 0
        version = self.version() + 1
        (dense_number(new, "id", name="_n")
         .select((F.col("_n") + F.lit(int(taken))).alias("numericId"), "id")
         .write.mode("overwrite").parquet(self._folder(version)))
        return version

    def encode(self, edges: DataFrame, src: str = "src", dst: str = "dst",
               version: int | None = None) -> DataFrame:
        """Edges with ``srcNumericId`` and ``dstNumericId`` (inner joins)."""
        ids = self.vertices(version).select("id", "numericId")
        for end in (src, dst):
            edges = edges.join(ids.select(F.col("id").alias(end), F.col("numericId").alias(f"{end}NumericId")),
                               end)
        return edges

    def decode(self, df: DataFrame, vertex: str = "vertexId", version: int | None = None) -> DataFrame:
        """Add the string ``id`` of a numeric vertex column (inner join)."""
        ids = self.vertices(version).select(F.col("numericId").alias(vertex), "id")
        return df.join(ids, vertex)
