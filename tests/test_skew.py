"""One vertex holds a third of all edges: labels stay right and the hot join is split.

The components rounds join edges with per-vertex summaries on the vertex; a
star centre of a giant component is such a hot key, and so is a DenGraph hub
in the neighbour-row joins. Adaptive skew-join handling does not split these
joins (one side is an aggregate over its own shuffle), so hot keys are salted
(``trafficgraph.operators.skew``). ``hot_rows`` is lowered to split at test
size; broadcasts are off so every join shuffles.
"""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from model import components as model_components
from model import dengraph as model_dengraph
from trafficgraph.operators import connected_components
from trafficgraph.operators.components import _large_star, _vertex_summary
from trafficgraph.operators.density import clusters_from_distances
from trafficgraph.operators.skew import hot_keys, salted_join

T1 = dt.datetime(2016, 5, 9, 0, 0)
HUB_EDGES = 1200


def hub_edges(seed=7):
    """Vertex 0 linked to 1..1200 (a third of all edges) plus 2400 chain edges."""
    rnd = random.Random(seed)
    edges = [(0, i) for i in range(1, HUB_EDGES + 1)]
    base = 10_000
    for c in range(240):               # 240 chains of 11 vertices
        start = base + c * 20
        edges += [(start + j, start + j + 1) for j in range(10)]
    rnd.shuffle(edges)
    return [(b, a) if i % 3 == 0 else (a, b) for i, (a, b) in enumerate(edges)]


@pytest.fixture()
def skew_conf(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_components_with_hub_equal_model(spark, skew_conf):
    edges = hub_edges()
    df = spark.createDataFrame([(T1, a, b) for a, b in edges], "eventTime timestamp, src int, dst int")
    expected = model_components(edges)
    for hot_rows in (100, 10**6):          # salted and plain rounds
        got = {r["vertexId"]: r["componentId"]
               for r in connected_components(df, hot_rows=hot_rows).collect()}
        assert got == expected


def test_hot_centre_join_is_split(spark, skew_conf):
    # Already a star around 0: the large-star join meets 1,200 edges on key 0.
    rows = [(T1, v, 0) for v in range(1, HUB_EDGES + 1)] + \
           [(T1, 10_000 + 2 * i + 1, 10_000 + 2 * i) for i in range(2400)]
    k = ["eventTime"]
    cur = spark.createDataFrame(rows, "eventTime timestamp, _hi int, _lo int")
    summary = _vertex_summary(cur, k)
    hot = hot_keys(summary, [*k, "_u"], "_nlo", 100)
    assert [(r["_u"], r["_splits"]) for r in hot.collect()] == [(0, 12)]
    plain = _large_star(cur, summary, k)
    salted = _large_star(cur, summary, k, hot)
    assert sorted(salted.collect()) == sorted(plain.collect())
    tasks = (salted.where("_lo = 0").select(F.spark_partition_id().alias("p"))
             .distinct().count())
    assert tasks > 1
    assert (plain.where("_lo = 0").select(F.spark_partition_id().alias("p"))
            .distinct().count()) == 1


def test_salted_outer_semi_anti_joins_equal_plain(spark):
    big = spark.createDataFrame([(i % 3, i) for i in range(300)] + [(None, 1000)],
                                "key int, v int")
    small = spark.createDataFrame([(0, "a"), (2, "c"), (5, "e")], "key int, s string")
    hot = spark.createDataFrame([(0, 4), (1, 3)], "key int, _splits int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(big, small, ["key"], hot, ["v"], how).collect()
        assert sorted(map(repr, got)) == \
            sorted(map(repr, big.join(small, ["key"], how).collect())), how


def test_dengraph_with_hub_equal_model(spark, skew_conf):
    pairs = [(f"h", f"v{i:04d}", 0.01) for i in range(HUB_EDGES)]
    pairs += [(f"v{i:04d}", f"v{i + 1:04d}", 0.02 if i % 3 else 0.5) for i in range(2 * HUB_EDGES)]
    df = spark.createDataFrame([(T1, s, d, w) for s, d, w in pairs],
                               "eventTime timestamp, src string, dst string, distance double")
    expected = model_dengraph(pairs, 0.035, 2)
    for hot_rows in (100, 10**6):
        got = {r["vertexId"]: (r["vertexType"], r["clusterId"])
               for r in clusters_from_distances(df, 0.035, 2, hot_rows=hot_rows).collect()}
        assert got == expected


def test_hot_detector_placement_join_is_split(spark, skew_conf, tmp_path):
    """Beyond the broadcast bound, a detector with most measurements is split by AQE.

    Unlike the graph joins, both sides here are plain shuffles of scans, the
    shape adaptive skew-join handling splits.
    """
    from trafficgraph.operators.graph import RoadGraph
    from trafficgraph.plans.congested import congested_edges
    edges = spark.createDataFrame(
        [(f"D{i:03d}", f"D{i + 1:03d}", 0.0, 0.0, 1.0, 0.0, True, False) for i in range(200)],
        "src string, dst string, src_X double, src_Y double, dst_X double, dst_Y double, "
        "same_road boolean, is_dummy boolean")
    g = RoadGraph.build(edges, broadcast_max_bytes=1)
    rnd = random.Random(5)
    rows = [(T1, "D007" if i % 3 else f"D{rnd.randrange(1, 201):03d}", 10, 40.0, 70.0)
            for i in range(30_000)]
    path = str(tmp_path / "m")
    spark.createDataFrame(rows, "eventTime timestamp, detectorId string, averageSpeed int, "
                                "density double, vFreeflowMin double").write.parquet(path)
    m = spark.read.parquet(path)
    out = congested_edges(m, g)
    assert len(out.collect()) == 30_000      # runs this frame's own plan
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
