"""Distributed interim/final streaming (per-edge state + relabel in foreachBatch).
"""

import os

import pytest
from pyspark.sql import functions as F

from test_streaming import graph, row, write_files  # noqa: F401  (fixture)
from trafficgraph.plans.congested import congested_components
from trafficgraph.sources import read_measurements_csv, stream_measurements_csv
from trafficgraph.streaming import (EdgeStoreRelabel, relabel_congested_components,
                                    relabel_dengraph, start)


def batch_files_sink(path):
    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{path}/batchId={int(batch_id)}")
    return write


def replay(spark, scratch, graph, files, job=relabel_congested_components, **kw):
    src = os.path.join(scratch, "in")
    write_files(src, files)
    m = stream_measurements_csv(spark, src, max_files_per_trigger=1)
    out = os.path.join(scratch, "out")
    q = start(job(m, graph, batch_files_sink(out), os.path.join(scratch, "chk"), **kw),
              available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.parquet(out)


def finals(df, col="componentId", vertex="id"):
    out = {}
    for r in df.where("final").collect():
        out.setdefault(r["eventTime"].strftime("%M:%S"), {})[r[vertex]] = r[col]
    return out


def test_interim_and_final(spark, scratch, graph):
    files = [[row("10:00", "B")],
             [row("20:00", "C"), row("12:00", "D")],
             [row("12:00", "E"), row("21:00", "B")],
             [row("30:00", "C")]]
    out = replay(spark, scratch, graph, files)
    assert finals(out) == {"10:00": {"A": 1, "B": 1},
                           "12:00": {"C": 3, "D": 3, "E": 3, "X": 3},
                           "20:00": {"B": 2, "C": 2},
                           "21:00": {"A": 1, "B": 1}}
    # exactly one final per (event time, vertex), written by one batch
    assert out.where("final").groupBy("eventTime", "id").count().where("count > 1").count() == 0
    # the last event time stays open, with its interim labels
    last = out.where("eventTime = TIMESTAMP'2016-05-09 00:30:00'")
    assert last.where("final").count() == 0 and last.count() == 2
    # interim rows carry the whole current graph of the touched event time
    b2 = out.where("batchId = 2 AND NOT final").select("id", "eventTime").collect()
    assert {(r["eventTime"].minute, r["id"]) for r in b2} == {(21, "A"), (21, "B")}
    # keys follow the reference layout
    assert out.where("key IS NULL").count() == 0
    # only folders that still hold open event times are read later on
    progress = spark.read.parquet(os.path.join(scratch, "chk", "relabel-store", "progress"))
    last = progress.orderBy(F.col("batchId").desc()).first()
    assert [o["batchId"] for o in last["open"]] == [3]      # the folder holding 00:30
    # closed folders and old progress rows are deleted
    store = os.path.join(scratch, "chk", "relabel-store")
    left = sorted(os.listdir(os.path.join(store, "edges")))
    # 0 and 1 are closed for good; 2 was open after batch 3, so a replay of 4 reads it
    assert left == ["batchId=2", "batchId=3", "batchId=4"]
    assert len(os.listdir(os.path.join(store, "progress"))) <= 3


def test_finals_equal_batch_result(spark, scratch, graph):
    files = [[row("10:00", "B"), row("10:00", "D")],
             [row("10:00", "C"), row("11:00", "E")],
             [row("12:00", "B")]]
    out = replay(spark, scratch, graph, files)
    batch = congested_components(read_measurements_csv(spark, os.path.join(scratch, "in")),
                                 graph).decoded
    expected = {}
    for r in batch.where("eventTime < TIMESTAMP'2016-05-09 00:11:30'").collect():
        expected.setdefault(r["eventTime"].strftime("%M:%S"), {})[r["id"]] = r["componentId"]
    assert finals(out) == expected


def test_late_rows_final_once(spark, scratch, graph):
    files = [[row("10:00", "B")], [row("05:00", "C")], [row("11:00", "D")]]
    out = replay(spark, scratch, graph, files)
    f = finals(out)
    assert set(f) == {"05:00", "10:00"}
    assert f["05:00"] == {"B": 2, "C": 2}
    per = out.where("final").groupBy("eventTime").agg(F.countDistinct("batchId").alias("b"))
    assert all(r["b"] == 1 for r in per.collect())


def test_rows_after_the_lag_are_dropped(spark, scratch, graph):
    files = [[row("00:00", "B"), row("00:00", "C")],
             [row("00:00", "D"), row("01:00", "B")],
             [row("02:00", "B")],
             [row("00:00", "E"), row("03:00", "B")]]
    out = replay(spark, scratch, graph, files)
    f = finals(out)
    assert f["00:00"] == {"A": 1, "B": 1, "C": 1, "D": 1}   # E's row is too late
    assert "03:00" not in f


def test_dengraph_relabel(spark, scratch, graph):
    files = [[row("10:00", "B", density=40.0), row("10:00", "C", density=40.0)],
             [row("10:00", "D", density=10.0), row("20:00", "B")]]
    out = replay(spark, scratch, graph, files, job=relabel_dengraph)
    f = {r["vertexId"]: (r["vertexType"], r["clusterId"])
         for r in out.where("final").collect()}
    assert f == {"A": ("BORDER", 0), "B": ("CORE", 0), "C": ("BORDER", 0), "D": ("NOISE", -1)}


def test_replayed_batch_overwrites_its_store(spark, scratch):
    seen = []
    df = spark.createDataFrame([("2016-05-09 00:10:00", 1, 2), ("2016-05-09 00:10:00", 2, 3)],
                               "t string, src int, dst int") \
        .select(F.col("t").cast("timestamp").alias("eventTime"), "src", "dst")

    def labeller(edges, final):
        return edges.select("eventTime", "src", "dst", final.alias("final"))

    h = EdgeStoreRelabel(os.path.join(scratch, "store"), ["eventTime", "src", "dst"], labeller,
                         lambda out, b: seen.append(out.count()), lag_micros=30_000_000)
    h(df, 0)
    h(df, 0)           # the same batch again, as after a failure
    assert seen == [2, 2]
    assert spark.read.parquet(os.path.join(scratch, "store", "edges")).count() == 2


def _frame(spark, t, pairs):
    return (spark.createDataFrame([(t, a, b) for a, b in pairs], "t string, src int, dst int")
            .select(F.col("t").cast("timestamp").alias("eventTime"), "src", "dst"))


def test_damaged_progress_fails_the_batch(spark, scratch):
    store = os.path.join(scratch, "store")

    def handler():
        return EdgeStoreRelabel(store, ["eventTime", "src", "dst"],
                                lambda e, final: e.withColumn("final", final),
                                lambda out, b: out.count(), 30_000_000)
    handler()(_frame(spark, "2016-05-09 00:10:00", [(1, 2)]), 0)
    folder = os.path.join(store, "progress", "batchId=0")
    for name in os.listdir(folder):
        if name.endswith(".parquet") or name.endswith(".crc"):
            with open(os.path.join(folder, name), "wb") as fh:
                fh.write(b"damaged")
    with pytest.raises(Exception):
        handler()(_frame(spark, "2016-05-09 00:11:00", [(2, 3)]), 1)


def test_touched_times_never_gather_an_event_time(spark, scratch):
    plans = []
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        h = EdgeStoreRelabel(os.path.join(scratch, "store"), ["eventTime", "src", "dst"],
                             lambda e, final: e.withColumn("final", final),
                             lambda out, b: plans.append(
                                 (out.count(), out._jdf.queryExecution().executedPlan().toString())),
                             30_000_000)
        h(_frame(spark, "2016-05-09 00:10:00", [(1, 2), (2, 3)]), 0)
        h(_frame(spark, "2016-05-09 00:20:00", [(1, 2)]), 1)
        h(_frame(spark, "2016-05-09 00:30:00", [(1, 2)]), 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [n for n, _ in plans] == [2, 1, 3]
    assert all("hashpartitioning(eventTime" not in p.split("BroadcastExchange")[0] and "SortMergeJoin" not in p
               and p.count("/edges") <= 2 for _, p in plans)


def test_restart_continues_from_progress_files(spark, scratch):
    def frame(t, pairs):
        return (spark.createDataFrame([(t, a, b) for a, b in pairs], "t string, src int, dst int")
                .select(F.col("t").cast("timestamp").alias("eventTime"), "src", "dst"))

    def labeller(edges, final):
        return edges.select("eventTime", "src", "dst", final.alias("final"))

    got = {}

    def sink(out, b):
        got[b] = sorted((r["eventTime"].minute, r["src"], r["final"]) for r in out.collect())

    store = os.path.join(scratch, "store")
    EdgeStoreRelabel(store, ["eventTime", "src", "dst"], labeller, sink, 30_000_000)(
        frame("2016-05-09 00:10:00", [(1, 2)]), 0)
    # a new process: nothing in memory, progress comes from the files
    h = EdgeStoreRelabel(store, ["eventTime", "src", "dst"], labeller, sink, 30_000_000)
    h(frame("2016-05-09 00:10:00", [(2, 3)]), 1)
    h(frame("2016-05-09 00:20:00", [(5, 6)]), 2)
    h(frame("2016-05-09 00:20:00", []), 3)               # a batch without data
    assert got[1] == [(10, 1, False), (10, 2, False)]      # batch 0's edge is still there
    assert got[3] == [(10, 1, True), (10, 2, True)]         # 10:00 final once 20:00 is seen


@pytest.mark.parametrize("edges, expected", [
    ([(5, 6), (2, 5)], {2: 2, 5: 2, 6: 2}),                       # attach lower
    ([(1, 2), (8, 9), (2, 8)], {1: 1, 2: 1, 8: 1, 9: 1}),          # merge
    ([(4, 5), (3, 4), (2, 3), (1, 2)], {v: 1 for v in range(1, 6)}),  # chain reversed
])
def test_components_cases_one_edge_per_trigger(spark, scratch, edges, expected):
    from trafficgraph.operators import connected_components

    def frame(t, pairs):
        return (spark.createDataFrame([(t, a, b) for a, b in pairs], "t string, src int, dst int")
                .select(F.col("t").cast("timestamp").alias("eventTime"), "src", "dst"))

    def labeller(e, final):
        return connected_components(e).select("eventTime", "vertexId", "componentId",
                                              final.alias("final"))

    out = {}

    def sink(df, b):
        out[b] = {(r["eventTime"].minute, r["vertexId"]): (r["componentId"], r["final"])
                  for r in df.collect()}

    h = EdgeStoreRelabel(os.path.join(scratch, "store"), ["eventTime", "src", "dst"], labeller,
                         sink, 30_000_000)
    for b, e in enumerate(edges):
        h(frame("2016-05-09 00:10:00", [e]), b)
        seen = {v for pair in edges[:b + 1] for v in pair}
        # interim labels: smallest vertex of each component seen so far
        assert {v for (_, v) in out[b]} == seen
        assert all(c == min(x for x in seen if out[b][(10, x)][0] == c)
                   for (_, v), (c, _) in out[b].items())
    n = len(edges)
    h(frame("2016-05-09 00:20:00", [(7, 7)]), n)
    h(frame("2016-05-09 00:20:00", []), n + 1)
    final = {v: c for (m, v), (c, f) in out[n + 1].items() if m == 10 and f}
    assert final == expected


def test_batches_leave_no_intermediate_tables_or_caches(spark, scratch, graph):
    from trafficgraph.session import checkpoint_dir
    tables = os.path.join(checkpoint_dir(spark).replace("file:", ""), "tables")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    cached_before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    files = [[row("10:00", "B"), row("10:00", "C")], [row("11:00", "D")], [row("12:00", "B")]]
    for job in (relabel_congested_components, relabel_dengraph):
        out = replay(spark, os.path.join(scratch, job.__name__), graph, files, job=job)
        assert out.where("final").count() > 0
    assert set(os.listdir(tables)) - before == set()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == cached_before


def test_relabel_over_the_events_binding_equals_batch(spark, scratch):
    """sf0.001 measurements replayed day by day: finals equal the batch job."""
    from trafficgraph.operators.graph import RoadGraph
    from trafficgraph.schemas import MEASUREMENT_SCHEMA
    from trafficgraph.sources.binding import road_tables
    edges, m = road_tables(spark, "/root/testdata/sf0.001", "day")
    g = RoadGraph.build(edges)
    names = [f.name for f in MEASUREMENT_SCHEMA.fields]

    def text(v):
        if v is None or v != v:
            return ""
        return v.strftime("%Y-%m-%d %H:%M:%S") if hasattr(v, "strftime") else str(v)

    days = {}
    for r in m.collect():                       # 1,000 rows: a test fixture
        days.setdefault(r["eventTime"], []).append(",".join(text(r[c]) for c in names) + "\n")
    src = os.path.join(scratch, "in")
    write_files(src, [days[d] for d in sorted(days)])
    s = stream_measurements_csv(spark, src, max_files_per_trigger=3)
    out_dir = os.path.join(scratch, "out")
    q = start(relabel_congested_components(s, g, batch_files_sink(out_dir),
                                           os.path.join(scratch, "chk")), available_now=True)
    q.awaitTermination(600)
    assert q.exception() is None
    got = {(r["eventTime"], r["id"]): r["componentId"]
           for r in spark.read.parquet(out_dir).where("final").collect()}
    last = max(days)
    expected = {(r["eventTime"], r["id"]): r["componentId"]
                for r in congested_components(m, g).decoded.collect() if r["eventTime"] < last}
    assert got == expected and len(expected) > 300
