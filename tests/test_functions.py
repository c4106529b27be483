"""Scalar rules at every boundary (FIXTURES §4)."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficgraph.functions import congestion_class, proximity_distance, to_key_value, with_key

DIFF_TO_CLASS = [(-1.0, 0), (0.0, 0), (0.1, 1), (4.9, 1), (5.0, 2), (19.9, 4), (20.0, 5),
                 (45.0, 10), (49.9, 10), (50.0, 11), (200.0, 11), (float("nan"), 11), (None, None)]


def test_congestion_class_boundaries(spark):
    schema = T.StructType([T.StructField("diff", T.DoubleType())])
    df = spark.createDataFrame([(d,) for d, _ in DIFF_TO_CLASS], schema)
    got = (df.select("diff", congestion_class(F.col("diff"), F.lit(0.0)).alias("c"))
           .collect())
    for (diff, expected), row in zip(DIFF_TO_CLASS, got):
        assert row["c"] == expected, (diff, row["c"])


def test_congestion_class_custom_thresholds(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.5, 3.0, 9.0)], "d double")
    got = [r[0] for r in df.select(congestion_class(F.col("d"), F.lit(0.0), (0, 2, 3))).collect()]
    assert got == [0, 1, 2, 3, 3]


def test_congestion_class_rejects_unsorted():
    with pytest.raises(ValueError):
        congestion_class("a", "b", (5, 0))


def test_distance_rule(spark):
    rows = [("a", "b", 40.0), ("a", "b", 20.0), ("a", "b", 0.0), ("a", "b", -10.0),
            ("a", "a", 0.0), ("a", "a", None), ("a", "b", None)]
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    got = [r[0] for r in df.select(proximity_distance()).collect()]
    assert got[0] == pytest.approx(0.025) and got[0] <= 0.035
    assert got[1] == pytest.approx(0.05) and got[1] > 0.035
    assert math.isinf(got[2]) and got[2] > 0
    assert got[3] == pytest.approx(-0.1)
    assert got[4] == 0.0 and got[5] == 0.0
    assert got[6] is None
    # the double subtraction is kept: 1 - (1 - 1/w), not 1/w
    assert got[0] == 1.0 - (1.0 - 1.0 / 40.0)


def test_key_value_layout(spark):
    df = spark.sql("SELECT 3 AS componentId, TIMESTAMP_NTZ'2016-05-09 00:01:00' AS eventTime, "
                   "true AS final, 7 AS vertexId, 'E4A' AS id")
    kv = to_key_value(with_key(df, "id")).first()
    assert kv["key"] == "2016-05-09 00:01:00_E4A_true"
    assert kv["value"] == ('{"componentId":3,"eventTime":"2016-05-09T00:01:00.000","final":true,'
                           '"vertexId":7,"id":"E4A","key":"2016-05-09 00:01:00_E4A_true"}')


def test_key_is_null_when_a_part_is_null(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2016-05-09 00:01:00' AS eventTime, "
                   "CAST(NULL AS STRING) AS id, true AS final")
    assert with_key(df, "id").first()["key"] is None


def test_long_detector_numbers_stay_distinct(spark):
    from trafficgraph.sources.binding import measurements_from_events
    events = spark.sql("SELECT TIMESTAMP_NTZ'2016-05-09 00:00:00' AS ts, id AS user_id, 1.0D AS value "
                       "FROM VALUES (7L), (12345678901L), (12345678902L), (1234567890L) AS t(id)")
    got = [r["detectorId"] for r in measurements_from_events(events).collect()]
    assert sorted(got) == ["D0000000007", "D1234567890", "D12345678901", "D12345678902"]


def test_conform_raises_on_a_missing_column(spark):
    from trafficgraph.schemas import EDGE_SCHEMA
    from trafficgraph.sources import conform
    with pytest.raises(Exception, match="dst"):
        conform(spark.sql("SELECT 'A' AS src"), EDGE_SCHEMA).count()


def test_components_stop_when_nothing_moves(spark, monkeypatch):
    from trafficgraph.operators import ComponentsDidNotConverge, components
    df = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    monkeypatch.setattr(components, "_small_star", lambda o, k, hot=None: df.selectExpr("dst _hi", "src _lo"))
    with pytest.raises(ComponentsDidNotConverge):
        components.connected_components(df, keys=())
