"""Explicit schemas of inputs and outputs (never inferred)."""

from pyspark.sql import types as T

EDGE_SCHEMA = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("src_X", T.DoubleType()),
    T.StructField("src_Y", T.DoubleType()),
    T.StructField("dst_X", T.DoubleType()),
    T.StructField("dst_Y", T.DoubleType()),
    T.StructField("same_road", T.BooleanType()),
    T.StructField("is_dummy", T.BooleanType()),
])

MEASUREMENT_SCHEMA = T.StructType([
    T.StructField("eventTime", T.TimestampType()),
    T.StructField("detectorId", T.StringType()),
    T.StructField("road", T.StringType()),
    T.StructField("kmRef", T.IntegerType()),
    T.StructField("detectorNumber", T.IntegerType()),
    T.StructField("flowIn", T.IntegerType()),
    T.StructField("averageSpeed", T.IntegerType()),
    T.StructField("density", T.DoubleType()),
    T.StructField("vFreeflowMin", T.DoubleType()),
    T.StructField("congestionClass", T.IntegerType()),
])

# Connected-components output, one row per vertex and event time.
COMPONENT_SCHEMA = T.StructType([
    T.StructField("componentId", T.IntegerType()),
    T.StructField("eventTime", T.TimestampType()),
    T.StructField("final", T.BooleanType()),
    T.StructField("vertexId", T.IntegerType()),
])

# Density-clustering output, one row per vertex and event time.
CLUSTER_SCHEMA = T.StructType([
    T.StructField("clusterId", T.IntegerType()),
    T.StructField("eventTime", T.TimestampType()),
    T.StructField("final", T.BooleanType()),
    T.StructField("vertexId", T.StringType()),
    T.StructField("vertexType", T.StringType()),
])
