"""Static road graph: directed sensor-to-sensor edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trafficgraph.schemas import EDGE_SCHEMA
from trafficgraph.sources.conform import conform


def read_edges_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Edge CSV with a header line, read with the fixed 8-column schema."""
    return spark.read.schema(EDGE_SCHEMA).option("header", header).csv(path)


def read_edges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Edges from any file format Spark reads; conformed to the edge schema."""
    if fmt == "csv":
        return read_edges_csv(spark, path)
    return conform(spark.read.format(fmt).load(path), EDGE_SCHEMA)
