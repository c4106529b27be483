"""Rejected lines are kept and counted; committed batches appear whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from test_streaming import row, write_files
from trafficgraph.schemas import COMPONENT_SCHEMA
from trafficgraph.sources import (accepted, rejects_writer, split_measurements,
                                  stream_tagged_measurements_csv, tagged_measurements_csv)
from trafficgraph.sources.rejects import MALFORMED, NO_DETECTOR, NO_TIME, OBSERVED, observed
from trafficgraph.streaming import committed_attempts, committed_batch_sink, read_committed, start

LINES = [row("10:00", "B"),
         "2016-05-09 00:10:00,C,E4,1,1,10,fast,40.0,70.0,3\n",       # a speed that is no number
         "yesterday,C,E4,1,1,10,50,40.0,70.0,3\n",                   # a time that is none
         "2016-05-09 00:10:00,C,E4,1\n",                             # too few fields
         "2016-05-09 00:10:00,C,E4,1,1,10,50,40.0,70.0,3,9,9\n",     # too many
         "2016-05-09 00:10:00,C,E4,x,1,10,50,40.0,70.0,3\n",         # malformed where no analysis looks
         ",C,E4,1,1,10,50,40.0,70.0,3\n",                            # no time
         "2016-05-09 00:10:00,,E4,1,1,10,50,40.0,70.0,3\n",          # no detector
         "2016-05-09 00:10:00,D,,,,,,,,\n",                          # nulls that are allowed
         row("11:00", "E")]


def test_batch_parts_into_measurements_and_rejects(spark, scratch):
    write_files(os.path.join(scratch, "in"), [LINES[:5], LINES[5:]])
    valid, rejects, counts = split_measurements(tagged_measurements_csv(spark, os.path.join(scratch, "in")))
    assert counts == {"lines": 10, "valid": 3, "malformed_line": 5, "no_event_time": 1, "no_detector": 1}
    assert sorted(r["detectorId"] for r in valid.collect()) == ["B", "D", "E"]
    got = rejects.collect()
    assert sorted(r["reason"] for r in got) == sorted([MALFORMED] * 5 + [NO_TIME, NO_DETECTOR])
    raw = {r["line"] for r in got if r["reason"] == MALFORMED}
    assert raw == {LINES[i].rstrip("\n") for i in (1, 2, 3, 4, 5)}
    assert valid.count() + rejects.count() == counts["lines"]


def test_stream_rejects_and_counts(spark, scratch):
    folder = os.path.join(scratch, "in")
    write_files(folder, [LINES[:5], LINES[5:]])
    out = os.path.join(scratch, "rejects")
    q = start(rejects_writer(stream_tagged_measurements_csv(spark, folder, 1), out, os.path.join(scratch, "c1")),
              available_now=True)
    q.awaitTermination(120)
    rejects = spark.read.parquet(out)
    assert {r["reason"]: r["count"] for r in rejects.groupBy("reason").count().collect()} == {
        MALFORMED: 5, NO_TIME: 1, NO_DETECTOR: 1}
    rows = accepted(observed(stream_tagged_measurements_csv(spark, folder, 1)))
    q = start(rows.writeStream.format("noop").option("checkpointLocation", os.path.join(scratch, "c2")),
              available_now=True)
    q.awaitTermination(120)
    seen = [p["observedMetrics"][OBSERVED] for p in q.recentProgress if OBSERVED in p["observedMetrics"]]
    assert sum(m["lines"] for m in seen) == 10 and sum(m["valid"] for m in seen) == 3


def labels(spark, *ids):
    return (spark.createDataFrame([(i, i) for i in ids], "componentId int, vertexId int")
            .withColumn("eventTime", F.lit("2016-05-09 00:10:00").cast("timestamp"))
            .withColumn("final", F.lit(True)).select(*COMPONENT_SCHEMA.names))


def test_committed_batches_appear_once_and_whole(spark, scratch):
    path = os.path.join(scratch, "out")

    def seen():
        return sorted((r["batchId"], r["vertexId"]) for r in read_committed(spark, path, COMPONENT_SCHEMA).collect())

    assert seen() == []
    sink = committed_batch_sink(path)
    sink(labels(spark, 1, 2), 0)
    assert seen() == [(0, 1), (0, 2)]
    # a batch that dies between its rows and its commit record is not there
    torn = labels(spark, 9)
    torn.withColumn("state", F.lit("final")).write.partitionBy("state").parquet(f"{path}/batchId=1/attempt=dead")
    assert seen() == [(0, 1), (0, 2)]
    # its replay appears once, and the dead attempt goes
    sink(labels(spark, 3), 1)
    sink(labels(spark, 3), 1)
    assert seen() == [(0, 1), (0, 2), (1, 3)]
    assert len(os.listdir(f"{path}/batchId=1")) == 1
    assert set(committed_attempts(spark, path)) == {0, 1}


def test_a_failing_write_leaves_the_earlier_commit(spark, scratch):
    path = os.path.join(scratch, "out")
    sink = committed_batch_sink(path, partition_by=None)
    sink(labels(spark, 1), 0)
    broken = labels(spark, 5).withColumn("vertexId", F.expr("IF(vertexId = 5, raise_error('lost'), 1)").cast("int"))
    with pytest.raises(Exception, match="lost"):
        sink(broken, 0)
    assert [r["vertexId"] for r in read_committed(spark, path, COMPONENT_SCHEMA).collect()] == [1]
