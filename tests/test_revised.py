"""Late rows are kept and correct their finals; idle event times become final by the clock."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from test_relabel import batch_files_sink, finals
from test_streaming import graph, row, write_files  # noqa: F401  (fixture)
from trafficgraph.plans.congested import congested_components
from trafficgraph.plans.dengraph import dengraph
from trafficgraph.schemas import MEASUREMENT_SCHEMA
from trafficgraph.sources import read_measurements_csv, stream_measurements_csv
from trafficgraph.streaming import (latest_finals, read_late, revised_congested_components,
                                    revised_dengraph, start, with_heartbeat)

SECOND = 1_000_000


class Clock:
    def __init__(self):
        self.now = 0

    def __call__(self):
        return self.now


def replay(spark, scratch, graph, files, job=revised_congested_components, **kw):  # noqa: F811
    """Each file is one batch; returns all rows that the sink got."""
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    write_files(src, files)
    m = stream_measurements_csv(spark, src, max_files_per_trigger=1)
    q = start(job(m, graph, batch_files_sink(out), os.path.join(scratch, "chk"), **kw), available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.parquet(out)


def batches(spark, scratch, graph, clock=None, **kw):  # noqa: F811
    """The ``foreachBatch`` function alone, and what it hands on: one call is one batch."""
    got = {}

    def sink(df, batch_id):
        got[batch_id] = sorted((r["eventTime"].strftime("%M:%S"), r["id"], r["componentId"], r["final"],
                                r["revision"]) for r in df.collect())
    from trafficgraph.streaming import revised
    seen = []
    real = revised._writer
    revised._writer = lambda m, chk, handler: seen.append(handler)
    try:
        revised_congested_components(spark.createDataFrame([], MEASUREMENT_SCHEMA), graph, sink, scratch,
                                     **({"clock": clock} if clock else {}), **kw)
    finally:
        revised._writer = real

    def run(batch_id, *rows):
        src = os.path.join(scratch, f"rows-{batch_id}-{len(os.listdir(scratch))}")
        write_files(src, [rows])
        seen[0](read_measurements_csv(spark, src), batch_id)
        return got.pop(batch_id, [])
    return run


def test_late_rows_are_kept_and_correct_the_final(spark, scratch, graph):  # noqa: F811
    files = [[row("00:00", "B"), row("00:00", "C")], [row("00:00", "D"), row("01:00", "B")],
             [row("02:00", "B")],
             [row("00:00", "E"), row("00:00", "B"), row("03:00", "B")],          # 00:00 was final
             [row("05:00", "B")], [row("07:00", "C")]]
    out = replay(spark, scratch, graph, files)
    first = finals(out.where("revision = 0"))
    assert first["00:00"] == {"A": 1, "B": 1, "C": 1, "D": 1}
    assert out.where("final").select("eventTime", "revision", "batchId").distinct().groupBy(
        "eventTime", "revision").count().where("count > 1").count() == 0
    assert {r["revision"] for r in out.where("revision > 0").collect()} == {3}
    whole = congested_components(read_measurements_csv(spark, os.path.join(scratch, "in")), graph).decoded
    expected = {}
    for r in whole.where("eventTime < TIMESTAMP'2016-05-09 00:05:00'").collect():
        expected.setdefault(r["eventTime"].strftime("%M:%S"), {})[r["id"]] = r["componentId"]
    assert finals(latest_finals(out)) == expected
    assert expected["00:00"]["X"] == 1                # E's row joined X to the component
    late = read_late(spark, os.path.join(scratch, "chk"), MEASUREMENT_SCHEMA).collect()
    assert sorted((r["detectorId"], r["reason"], r["batchId"]) for r in late) == [
        ("B", "after_final", 3), ("E", "after_final", 3)]
    # the key says final as for any other final
    assert out.where("revision > 0 AND key IS NULL").count() == 0


@pytest.mark.parametrize("job,vertex,label", [(revised_congested_components, "id", "componentId"),
                                              (revised_dengraph, "vertexId", "clusterId")])
def test_any_order_ends_in_the_batch_result(spark, scratch, graph, job, vertex, label):  # noqa: F811
    rnd = random.Random(label)
    files = [[row(f"{rnd.randrange(4):02d}:00", rnd.choice("BCDEZ"), speed=rnd.choice([10, 69]),
                  density=rnd.choice([10.0, 40.0, 50.0])) for _ in range(rnd.randrange(2, 6))] for _ in range(5)]
    out = replay(spark, scratch, graph, files + [[row("59:00", "B")], [row("59:30", "B")]], job=job)
    m = read_measurements_csv(spark, os.path.join(scratch, "in")).where("minute(eventTime) < 59")
    whole = congested_components(m, graph).decoded if label == "componentId" else dengraph(m, graph).clusters
    expected = {}
    for r in whole.collect():
        expected.setdefault(r["eventTime"].strftime("%M:%S"), {})[r[vertex]] = r[label]
    assert finals(latest_finals(out).where("minute(eventTime) < 59"), label, vertex) == expected
    assert out.where("revision > 0").count() > 0


def test_idle_event_time_becomes_final_once_without_data(spark, scratch, graph):  # noqa: F811
    clock = Clock()
    run = batches(spark, scratch, graph, clock, idle="20 seconds")
    assert run(0, row("10:00", "B")) == [("10:00", "A", 1, False, 0), ("10:00", "B", 1, False, 0)]
    clock.now = 15 * SECOND
    assert run(1, row("10:00", "C"))[0] == ("10:00", "A", 1, False, 0)
    clock.now = 30 * SECOND
    assert run(2) == []                              # last news is 15 s old
    clock.now = 35 * SECOND
    last = [("10:00", v, 1, True, 0) for v in "ABC"]
    assert run(3) == last                            # no data came, final by the clock
    clock.now = 500 * SECOND
    assert run(3) == last                            # replayed after a failure: the recorded clock counts
    assert run(4) == [] and run(5) == []             # exactly once
    # a row that comes after all is late: kept, and the final is corrected
    assert run(6, row("10:00", "D")) == [("10:00", v, 1, True, 6) for v in "ABCD"]
    late = spark.read.parquet(os.path.join(scratch, "revised-store", "late"))
    assert [(r["detectorId"], r["reason"]) for r in late.collect()] == [("D", "after_final")]
    clock.now = 600 * SECOND
    assert run(7) == []                              # nor does the clock close it again
    assert [r[0] for r in run(8, row("20:00", "B"))] == ["20:00", "20:00"]
    assert run(9) == []                              # nor the watermark, that passes it now


def test_a_clock_that_runs_back_closes_nothing(spark, scratch, graph):  # noqa: F811
    clock = Clock()
    run = batches(spark, scratch, graph, clock, idle="20 seconds")
    clock.now = 100 * SECOND
    run(0, row("10:00", "B"))
    clock.now = 10 * SECOND
    assert run(1) == []
    clock.now = 119 * SECOND
    assert run(2) == []
    clock.now = 121 * SECOND
    assert [r[3] for r in run(3)] == [True, True]


def test_rows_beyond_keep_stay_in_the_side_channel(spark, scratch, graph):  # noqa: F811
    run = batches(spark, scratch, graph, keep="1 minute")
    run(0, row("00:00", "B"))
    run(1, row("10:00", "B"))
    assert run(2, row("20:00", "B"))[0][0] == "00:00"
    run(3, row("21:00", "B"))
    # neither can be corrected; 20:00 is closed by 21:00 of the batch before
    assert {r[0] for r in run(4, row("00:00", "C"), row("10:00", "C"))} == {"20:00"}
    late = spark.read.parquet(os.path.join(scratch, "revised-store", "late"))
    assert {(r["eventTime"].minute, r["detectorId"], r["reason"]) for r in late.collect()} == {
        (0, "C", "beyond_keep"), (10, "C", "beyond_keep")}
    for n in range(5, 8):
        run(n, row(f"{n + 25}:00", "B"))
    left = os.listdir(os.path.join(scratch, "revised-store", "edges"))
    assert "batchId=0" not in left and "batchId=4" not in left and len(left) <= 6
    assert len(os.listdir(os.path.join(scratch, "revised-store", "progress"))) <= 3
    assert spark.read.parquet(os.path.join(scratch, "revised-store", "late")).count() == 2


def test_missing_progress_fails_the_batch(spark, scratch, graph):  # noqa: F811
    run = batches(spark, scratch, graph)
    with pytest.raises(RuntimeError, match="no progress record"):
        run(5, row("10:00", "B"))


def test_heartbeat_closes_the_last_event_time_of_a_stream(spark, scratch, graph):  # noqa: F811
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    write_files(src, [[row("10:00", "B")], [row("10:00", "C")]])
    m = with_heartbeat(stream_measurements_csv(spark, src, max_files_per_trigger=1))
    q = start(revised_congested_components(m, graph, batch_files_sink(out), os.path.join(scratch, "chk"),
                                           idle="5 seconds"), processing_time="1 second")
    try:
        done, end = False, time.time() + 120
        while not done and time.time() < end and q.exception() is None:
            time.sleep(2)
            done = os.path.isdir(out) and any(
                spark.read.parquet(os.path.join(out, b)).where("final").limit(1).count()
                for b in os.listdir(out) if os.path.exists(os.path.join(out, b, "_SUCCESS")))
        time.sleep(4)                                 # more heartbeats: nothing closes twice
    finally:
        q.stop()
    assert q.exception() is None
    ready = [os.path.join(out, b) for b in os.listdir(out) if os.path.exists(os.path.join(out, b, "_SUCCESS"))]
    got = spark.read.parquet(*ready).where(F.col("final")).collect()
    assert sorted((r["id"], r["revision"]) for r in got) == [("A", 0), ("B", 0), ("C", 0)]
