"""Replays of measurement files, one file per trigger (FIXTURES §4, streaming)."""

import os
import time

import pytest
from pyspark.sql import functions as F

from trafficgraph.functions.output import to_key_value
from trafficgraph.operators.graph import RoadGraph
from trafficgraph.schemas import MEASUREMENT_SCHEMA
from trafficgraph.plans.congested import congested_components
from trafficgraph.sources import read_edges_csv, read_measurements_csv, stream_measurements_csv
from trafficgraph.streaming import (ProgressCollector, components_handler, clusters_handler,
                                    console_batch_sink, console_writer, file_writer,
                                    final_congested_edges, final_edge_distances,
                                    kafka_batch_sink, kafka_options, kafka_writer,
                                    parquet_batch_sink, query_progress,
                                    relabel_congested_components, relabel_dengraph, start)

EDGES = "src,dst,src_X,src_Y,dst_X,dst_Y,same_road,is_dummy\n" + "".join(
    f"{a},{b},0,0,1,0,true,false\n" for a, b in [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"),
                                                 ("X", "E")])


def row(minute, det, speed=10, density=40.0):
    return f"2016-05-09 00:{minute},{det},E4,1,1,10,{speed},{density},70.0,3\n"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("edges")
    (d / "edges.csv").write_text(EDGES)
    return RoadGraph.build(read_edges_csv(spark, str(d / "edges.csv")))


def write_files(folder, files):
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(files):
        p = os.path.join(folder, f"part-{i:03d}.csv")
        with open(p, "w") as fh:
            fh.write("".join(rows))
        os.utime(p, (1_000_000 + i, 1_000_000 + i))


def run_updates(spark, scratch, graph, files, job=relabel_congested_components, sink=None, **kw):
    src = os.path.join(scratch, "in")
    write_files(src, files)
    m = stream_measurements_csv(spark, src, max_files_per_trigger=1)
    out = os.path.join(scratch, "out")
    q = start(job(m, graph, sink or parquet_batch_sink(out), os.path.join(scratch, "chk"), **kw),
              available_now=True)
    q.awaitTermination(180)
    assert q.exception() is None
    return None if sink else spark.read.parquet(out), q


def finals(df, col="componentId", vertex="id"):
    out = {}
    for r in df.where("final").collect():
        out.setdefault(r["eventTime"].strftime("%M:%S"), {})[r[vertex]] = r[col]
    return out


def test_file_source_interim_and_final(spark, scratch, graph):
    files = [[row("10:00", "B")],
             [row("20:00", "C"), row("12:00", "D")],
             [row("12:00", "E"), row("21:00", "B")],
             [row("30:00", "C")]]
    out, q = run_updates(spark, scratch, graph, files)
    f = finals(out)
    assert f == {"10:00": {"A": 1, "B": 1},
                 "12:00": {"C": 3, "D": 3, "E": 3, "X": 3},
                 "20:00": {"B": 2, "C": 2},
                 "21:00": {"A": 1, "B": 1}}
    # each event time is final exactly once; the last one stays open
    per_final = out.where("final").groupBy("eventTime", "id").count().where("count > 1").count()
    assert per_final == 0
    assert out.where("eventTime = TIMESTAMP'2016-05-09 00:30:00' AND final").count() == 0
    assert out.where("eventTime = TIMESTAMP'2016-05-09 00:30:00' AND NOT final").count() == 2
    # a touched event time that is final by then is reported as final, with its whole graph
    twelve = out.where("eventTime = TIMESTAMP'2016-05-09 00:12:00'")
    assert twelve.where("NOT final").select("id").distinct().count() == 2
    assert twelve.where("final").select("id").distinct().count() == 4


def test_finals_equal_batch_result(spark, scratch, graph):
    files = [[row("10:00", "B"), row("10:00", "D")],
             [row("10:00", "C"), row("11:00", "E")],
             [row("12:00", "B")]]
    out, _ = run_updates(spark, scratch, graph, files)
    src = os.path.join(scratch, "in")
    batch = congested_components(read_measurements_csv(spark, src), graph).decoded
    expected = {}
    for r in batch.where("eventTime < TIMESTAMP'2016-05-09 00:12:00'").collect():
        expected.setdefault(r["eventTime"].strftime("%M:%S"), {})[r["id"]] = r["componentId"]
    assert finals(out) == expected


def test_late_rows_do_not_fail(spark, scratch, graph):
    files = [[row("10:00", "B")], [row("05:00", "C")], [row("11:00", "D")]]
    out, q = run_updates(spark, scratch, graph, files)
    f = finals(out)
    assert set(f) == {"05:00", "10:00"}
    assert f["05:00"] == {"B": 2, "C": 2}


def test_watermark_drops_late_rows(spark, scratch, graph):
    files = [[row("00:00", "B"), row("00:00", "C")],
             [row("00:00", "D"), row("01:00", "B")],
             [row("02:00", "B")],
             [row("00:00", "E"), row("03:00", "B")]]
    out, q = run_updates(spark, scratch, graph, files)
    f = finals(out)
    assert f["00:00"] == {"A": 1, "B": 1, "C": 1, "D": 1}   # E's late row was dropped
    assert "03:00" not in f
    dropped = sum(r["rowsDroppedByWatermark"] for r in query_progress(q))
    assert dropped >= 1


def test_static_join_fans_out_and_drops_unknown(spark, scratch, graph):
    files = [[row("10:00", "E"), row("10:00", "A"), row("10:00", "Q")], [row("20:00", "B")]]
    out, _ = run_updates(spark, scratch, graph, files)
    # E has two in-edges (D->E, X->E); A and Q have none
    assert finals(out) == {"10:00": {"D": 4, "E": 4, "X": 4}}


def test_state_carries_across_triggers(spark, scratch, graph):
    # The second 10:00 row passes the late filter, which lags one batch behind
    # the watermark; the third arrives two batches later and is dropped.
    files = [[row("10:00", "B")], [row("10:00", "D")], [row("10:00", "C")], [row("20:00", "B")]]
    out, q = run_updates(spark, scratch, graph, files)
    interim = out.where("NOT final AND eventTime = TIMESTAMP'2016-05-09 00:10:00'")
    sizes = sorted(r["count"] for r in interim.groupBy("id").count().collect())
    assert sizes == [1, 1, 2, 2]          # A, B in both interim updates; C, D in the second
    assert finals(out)["10:00"] == {"A": 1, "B": 1, "C": 3, "D": 3}
    assert sum(r["rowsDroppedByWatermark"] for r in query_progress(q)) == 1


def test_dengraph_stream(spark, scratch, graph):
    files = [[row("10:00", "B", density=40.0), row("10:00", "C", density=40.0)],
             [row("10:00", "D", density=10.0), row("20:00", "B")]]
    out, _ = run_updates(spark, scratch, graph, files, job=relabel_dengraph)
    f = {}
    for r in out.where("final").collect():
        f[r["vertexId"]] = (r["vertexType"], r["clusterId"])
    assert f == {"A": ("BORDER", 0), "B": ("CORE", 0), "C": ("BORDER", 0), "D": ("NOISE", -1)}
    assert out.where("key IS NULL").count() == 0


def test_finals_at_scale_via_foreach_batch(spark, scratch, graph):
    src = os.path.join(scratch, "in")
    files = [[row("10:00", "B"), row("10:00", "D")],
             [row("10:00", "C"), row("11:00", "E")],
             [row("12:00", "B")], [row("13:00", "B")]]
    write_files(src, files)
    m = stream_measurements_csv(spark, src, max_files_per_trigger=1)
    sink_dir = os.path.join(scratch, "out")
    q = start(final_congested_edges(m, graph).writeStream.outputMode("append")
              .option("checkpointLocation", os.path.join(scratch, "chk"))
              .foreachBatch(components_handler(graph, parquet_batch_sink(sink_dir))),
              available_now=True)
    q.awaitTermination(180)
    assert q.exception() is None
    got = spark.read.parquet(sink_dir)
    # one final per event time, each written in exactly one batch
    per = got.groupBy("eventTime").agg(F.countDistinct("batchId").alias("b")).collect()
    assert all(r["b"] == 1 for r in per)
    f = {}
    for r in got.collect():
        f.setdefault(r["eventTime"].strftime("%M:%S"), {})[r["id"]] = r["componentId"]
    batch = congested_components(read_measurements_csv(spark, src), graph).decoded
    expected = {}
    for r in batch.collect():  # delay 0: even the last event time is final
        expected.setdefault(r["eventTime"].strftime("%M:%S"), {})[r["id"]] = r["componentId"]
    assert f == expected


def test_dengraph_finals_via_foreach_batch(spark, scratch, graph):
    src = os.path.join(scratch, "in")
    write_files(src, [[row("10:00", "B"), row("10:00", "C")], [row("20:00", "B")]])
    m = stream_measurements_csv(spark, src, max_files_per_trigger=1)
    sink_dir = os.path.join(scratch, "out")
    q = start(final_edge_distances(m, graph).writeStream.outputMode("append")
              .option("checkpointLocation", os.path.join(scratch, "chk"))
              .foreachBatch(clusters_handler(parquet_batch_sink(sink_dir))), available_now=True)
    q.awaitTermination(180)
    rows = spark.read.parquet(sink_dir).collect()
    got = {r["vertexId"]: (r["vertexType"], r["clusterId"])
           for r in rows if r["eventTime"].minute == 10}
    assert got == {"A": ("BORDER", 0), "B": ("CORE", 0), "C": ("BORDER", 0)}
    assert {r["vertexId"] for r in rows if r["eventTime"].minute == 20} == {"A", "B"}


def test_file_sink_keeps_the_boolean(spark, scratch, graph):
    out, _ = run_updates(spark, scratch, graph, [[row("10:00", "B")], [row("20:00", "B")]])
    assert dict(out.dtypes)["final"] == "boolean" and {"batchId", "state"} <= set(out.columns)
    assert out.where("final").count() == out.where("state = 'final'").count() == 2
    assert out.where("NOT final").count() == out.where("state = 'interim'").count() == 4


def test_file_writer_of_append_finals(spark, scratch, graph):
    src = os.path.join(scratch, "in")
    write_files(src, [[row("10:00", "B")], [row("20:00", "B")]])
    m = stream_measurements_csv(spark, src, max_files_per_trigger=1)
    df = final_congested_edges(m, graph).withColumn("final", F.lit(True))
    q = start(file_writer(df, os.path.join(scratch, "out"), os.path.join(scratch, "chk"), "append"),
              available_now=True)
    q.awaitTermination(180)
    assert spark.read.parquet(os.path.join(scratch, "out")).where("final").count() == 2


def test_console_sinks_print_key_and_value(spark, scratch, graph, capfd):
    run_updates(spark, scratch, graph, [[row("10:00", "B")]], sink=console_batch_sink())
    text = capfd.readouterr().out
    assert "2016-05-09 00:10:00_A_false" in text
    assert '"componentId":1' in text and '"id":"B"' in text
    m = stream_measurements_csv(spark, os.path.join(scratch, "in"))
    q = start(console_writer(final_edge_distances(m, graph).select(
        F.lit("k").alias("key"), F.lit("v").alias("src")), "append")
        .option("checkpointLocation", os.path.join(scratch, "chk2")), available_now=True)
    q.awaitTermination(180)
    assert q.exception() is None


def test_kafka_options_and_schema(spark, scratch, graph):
    opts = kafka_options("localhost:9092", "dengraph_results", "/chk/x")
    assert opts == {"kafka.bootstrap.servers": "localhost:9092", "topic": "dengraph_results",
                    "checkpointLocation": "/chk/x"}
    sink = kafka_batch_sink("localhost:9092", "t", **{"kafka.acks": "all"})
    assert sink.options == {"kafka.bootstrap.servers": "localhost:9092", "topic": "t",
                            "kafka.acks": "all"}
    seen = []
    run_updates(spark, scratch, graph, [[row("10:00", "B")]],
                sink=lambda df, b: seen.append(to_key_value(df).dtypes))
    assert seen[0] == [("key", "string"), ("value", "string")]
    m = spark.readStream.schema(MEASUREMENT_SCHEMA).csv(os.path.join(scratch, "in"))
    df = final_congested_edges(m, graph).withColumn("key", F.lit("k"))
    assert kafka_writer(df, "localhost:9092", "t", "/chk/y") is not None   # starting needs the connector


def test_progress_listener(spark, scratch, graph):
    listener = ProgressCollector()
    spark.streams.addListener(listener)
    try:
        _, q = run_updates(spark, scratch, graph, [[row("10:00", "B")], [row("20:00", "C")]])
        own = []
        for _ in range(100):           # events arrive on the listener's own thread
            own = [e for e in listener.events if e["id"] == str(q.id)]
            if any(e["event"] == "terminated" for e in own):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    kinds = [e["event"] for e in own]
    assert kinds[0] == "started" and kinds[-1] == "terminated" and "progress" in kinds
    assert own[-1]["exception"] is None
    progress = [e for e in own if e["event"] == "progress"]
    assert sum(e["numInputRows"] for e in progress) == 2
    assert any(e["watermark"] and e["watermark"].startswith("2016-05-09T00:10") for e in progress)
    assert [e["batchId"] for e in progress] == [r["batchId"] for r in query_progress(q)]


CALM = [[row("10:00", "B")], [row("11:00", "B", speed=70)], [row("12:00", "C", speed=70)],
        [row("13:00", "D", speed=70)]]


def test_calm_periods_bring_finals_out(spark, scratch, graph):
    out, _ = run_updates(spark, scratch, graph, CALM)
    assert finals(out) == {"10:00": {"A": 1, "B": 1}}
    dengraph = os.path.join(scratch, "dg")
    os.makedirs(dengraph)
    # sensors that end no edge move the event time as well
    out, _ = run_updates(spark, dengraph, graph, [[row("10:00", "B")], [row("11:00", "Q")], [row("12:00", "Q")]],
                         job=relabel_dengraph)
    assert {r["vertexId"] for r in out.where("final").collect()} == {"A", "B"}


@pytest.mark.parametrize("delay", ["0 seconds", "30 seconds"])
def test_calm_periods_bring_append_finals_out(spark, scratch, graph, delay):
    src = os.path.join(scratch, "in")
    write_files(src, CALM)
    m = stream_measurements_csv(spark, src, max_files_per_trigger=1)
    out = os.path.join(scratch, "out")
    q = start(final_congested_edges(m, graph, watermark_delay=delay).writeStream.outputMode("append")
              .option("checkpointLocation", os.path.join(scratch, "chk"))
              .foreachBatch(components_handler(graph, parquet_batch_sink(out))), available_now=True)
    q.awaitTermination(180)
    assert q.exception() is None
    got = {(r["eventTime"].minute, r["id"]) for r in spark.read.parquet(out).collect()}
    assert got == {(10, "A"), (10, "B")}


def test_no_class_filter_below_the_watermark(spark, scratch, graph):
    src = os.path.join(scratch, "in")
    write_files(src, [[row("10:00", "B")]])
    m = stream_measurements_csv(spark, src)
    q = start(final_congested_edges(m, graph).writeStream.outputMode("append").format("noop")
              .option("checkpointLocation", os.path.join(scratch, "chk")), available_now=True)
    q.awaitTermination(180)
    text = q._jsq.explainInternal(True)      # of the last micro-batch
    below = text[text.index("== Optimized Logical Plan =="):]
    below = below[below.index("EventTimeWatermark"):below.index("== Physical Plan ==")]
    filters = [ln for ln in below.splitlines() if "Filter" in ln]
    assert "averageSpeed" in below and all("averageSpeed" not in ln for ln in filters)


def test_buckets_join_records_of_one_minute(spark, scratch, graph):
    files = [[row("10:05", "B"), row("10:40", "C")], [row("11:30", "D")], [row("12:01", "B")]]
    out, _ = run_updates(spark, scratch, graph, files, bucket="minute")
    assert finals(out) == {"10:00": {"A": 1, "B": 1, "C": 1}, "11:00": {"C": 3, "D": 3}}
    batch = congested_components(read_measurements_csv(spark, os.path.join(scratch, "in")), graph,
                                 bucket="minute").decoded
    assert {r["eventTime"].second for r in batch.collect()} == {0}
