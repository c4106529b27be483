"""Physical plans: pushdown, no Python in batch plans, no single-partition window."""

import datetime as dt

from pyspark.sql import functions as F

from trafficgraph.operators.graph import RoadGraph
from trafficgraph.operators.vertices import vertex_numeric_ids
from trafficgraph.plans.congested import congested_edges
from trafficgraph.plans.dengraph import dengraph
from trafficgraph.sources.binding import road_tables

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().executedPlan().toString() + "\n" + \
        df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_congestion_filter_below_join_and_columns_pruned(spark):
    edges, m = road_tables(spark, SF)
    ce = congested_edges(m, RoadGraph.build(edges))
    text = ce._jdf.queryExecution().optimizedPlan().toString()
    join_at = text.index("Join Inner")
    filter_at = text.index("Filter", join_at)
    assert "CASE WHEN" in text[filter_at:filter_at + 400]  # the class filter sits under the join
    scan = [ln for ln in plan(ce).splitlines() if "ReadSchema" in ln]
    assert scan and all("event_type" not in ln and "props" not in ln for ln in scan)


def test_batch_plans_have_no_python(spark):
    edges, m = road_tables(spark, SF)
    g = RoadGraph.build(edges)
    for df in (congested_edges(m, g), dengraph(m, g).clusters):
        text = plan(df)
        assert "Python" not in text and "ArrowEvalPython" not in text


def test_vertex_numbering_not_single_partition(spark):
    edges, _ = road_tables(spark, SF)
    df = vertex_numeric_ids(edges)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    # The only single-partition step is the prefix sum over per-partition
    # counts: one row per range partition, never one row per vertex.
    for i, ln in enumerate(lines):
        if "SinglePartition" in ln:
            assert "keys=[_pid" in lines[i + 1], lines[i:i + 2]
    assert df.count() == 15


def test_placement_join_broadcasts_checked_static_side(spark):
    edges, m = road_tables(spark, SF)
    g = RoadGraph.build(edges)
    assert g.edge_count > 0
    text = plan(congested_edges(m, g))
    assert "BroadcastHashJoin" in text


def test_placement_join_shuffles_beyond_bound(spark):
    edges, m = road_tables(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = RoadGraph.build(edges, broadcast_max_bytes=1)
        text = plan(congested_edges(m, g))
        assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_bound_counts_the_columns_shipped(spark):
    from trafficgraph.operators.materialize import ROW_BYTES
    edges, _ = road_tables(spark, SF)
    g = RoadGraph.build(edges)
    size = g.sizes["encoded"]
    few = size.bytes_of(["dst", "srcNumericId", "dstNumericId"])
    assert few == g.edge_count * (ROW_BYTES + 8 + 11 + 8 + 8) < size.bytes_of(g.encoded.columns)
    g.broadcast_max_bytes = few
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(g.side("encoded", "dst", "srcNumericId", "dstNumericId")) and not hinted(g.side("encoded"))
    g.broadcast_max_bytes = few - 1
    assert not hinted(g.side("encoded", "dst", "srcNumericId", "dstNumericId"))


def test_hot_list_is_bounded():
    from trafficgraph.operators.skew import DEFAULT_HOT_ROWS, MAX_HOT_KEYS, hot_threshold
    assert hot_threshold(10**6) == DEFAULT_HOT_ROWS
    assert 10**13 // hot_threshold(10**13) <= MAX_HOT_KEYS


def test_batch_calls_leave_no_tables_or_caches_in_a_scope(spark):
    import os
    from trafficgraph.operators.materialize import table_scope
    from trafficgraph.plans.congested import congested_components
    from trafficgraph.session import checkpoint_dir
    tables = os.path.join(checkpoint_dir(spark).replace("file:", ""), "tables")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    cached = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    with table_scope():
        edges, m = road_tables(spark, SF)
        g = RoadGraph.build(edges)
        assert congested_components(m, g).keyed.count() > 0
        assert dengraph(m, g).keyed.count() > 0
    assert set(os.listdir(tables)) - before == set()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == cached


def test_clusters_never_join_on_a_null_key(spark):
    from trafficgraph.operators.density import clusters_from_distances
    rows = [(dt.datetime(2016, 5, 9), f"a{i:05d}", f"b{i:05d}", 0.9 if i % 20 else 0.01) for i in range(8000)]
    rows += [(r[0], r[2], r[1], r[3]) for r in rows if r[3] < 0.5]        # cores
    pairs = spark.createDataFrame(rows, "eventTime timestamp, src string, dst string, distance double")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = clusters_from_distances(pairs)
        per = (out.where("vertexType = 'NOISE'").groupBy(F.spark_partition_id()).count().collect())
        assert sum(r["count"] for r in per) == 15_200 and len(per) >= 4
        assert max(r["count"] for r in per) < 0.4 * 15_200
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 14
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_checkpoint_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    import pytest
    from trafficgraph import session

    def unset(_):
        raise RuntimeError("spark.checkpoint.dir is not set")
    monkeypatch.setattr(session, "checkpoint_dir", unset)
    monkeypatch.setattr(session, "is_local", lambda _: False)
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(spark)


def test_views_serve_sql(spark):
    import __spark_entry__ as se
    out = se.queries()["components_by_sql"](spark, SF)
    assert out.count() > 0
    assert spark.sql("SELECT count(*) AS n FROM road_edges").first()["n"] > 0


def test_entry_smoke(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert [f.name for f in df.schema.fields] == ["componentId", "eventTime", "final", "vertexId", "id"]
    assert df.count() > 0
    assert set(se.oracle_sql()) <= set(se.queries())
    own = {q for q in se.queries() if q != "pipeline" and not q.startswith("op")}
    assert own <= set(se.oracle_sql())


def test_salting_only_when_a_key_is_hot(spark):
    from trafficgraph.operators.density import dengraph_clusters
    from trafficgraph.plans.dengraph import weighted_edges
    edges, m = road_tables(spark, SF)
    w = weighted_edges(m, RoadGraph.build(edges, with_ids=False))
    plain = dengraph_clusters(w, keys=["eventTime"])
    assert "_salt" not in plan(plain, "simple")
    salted = dengraph_clusters(w, keys=["eventTime"], hot_rows=1)
    assert "_salt" in plan(salted, "simple")
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))
