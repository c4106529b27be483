"""Labels carried over triggers: equal to labelling everything, and only news is worked on."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from model import components as model_components
from model import dengraph as model_dengraph
from test_relabel import finals, replay
from test_streaming import graph, row  # noqa: F401  (fixture)
from trafficgraph.streaming import (CarriedClusters, CarriedComponents, carry_congested_components,
                                    carry_dengraph, relabel_dengraph)
from trafficgraph.streaming import carried as module

T0 = dt.datetime(2016, 5, 9, 10, 0)
OPEN = 10 ** 15              # no event time becomes final


class PlainIds:
    """Stands for a road graph: numbers are their own names."""

    @staticmethod
    def decode(df):
        return df.withColumn("id", F.col("vertexId").cast("string"))


class Held:
    def __init__(self):
        self.rows = []

    def __call__(self, df, batch_id):
        self.rows = df.collect()


def by_time(rows, value):
    out = {}
    for r in rows:
        out.setdefault(r["eventTime"], {})[r["vertexId"]] = value(r)
    return out


def test_components_equal_batch_after_every_trigger(spark, scratch, monkeypatch):
    rnd = random.Random(3)
    sink, links = Held(), []
    handler = CarriedComponents(scratch, PlainIds, sink, OPEN)
    plain = module.merged_labels

    def watched(df, a, b):
        links.append(df.count())
        return plain(df, a, b)
    monkeypatch.setattr(module, "merged_labels", watched)
    seen = {}
    for n in range(12):
        new = [(T0 + dt.timedelta(minutes=rnd.randrange(2)), rnd.randrange(60), rnd.randrange(60))
               for _ in range(rnd.randrange(1, 7))]
        if n == 7:
            new.append((T0, None, None))             # a marker row
        handler(spark.createDataFrame(new, "eventTime timestamp, src int, dst int"), n)
        for t, a, b in new:
            if a is not None:
                seen.setdefault(t, []).append((a, b))
        touched = {t for t, _, _ in new}
        assert by_time(sink.rows, lambda r: r["componentId"]) == {
            t: model_components(seen[t]) for t in touched if t in seen}
        assert links[-1] <= len(new)                 # rounds see the trigger's news only
        # the edges of earlier triggers are not needed any more
        for b in range(n):
            shutil.rmtree(os.path.join(scratch, "edges", f"batchId={b}"), ignore_errors=True)


def test_replayed_trigger_gives_the_same(spark, scratch):
    sink = Held()
    handler = CarriedComponents(scratch, PlainIds, sink, OPEN)
    schema = "eventTime timestamp, src int, dst int"
    handler(spark.createDataFrame([(T0, 5, 6), (T0, 8, 9)], schema), 0)
    second = spark.createDataFrame([(T0, 2, 6), (T0, 9, 6)], schema)
    handler(second, 1)
    first_time = sorted(map(tuple, sink.rows))
    again = CarriedComponents(scratch, PlainIds, sink, OPEN)       # after a restart
    again(second, 1)
    assert sorted(map(tuple, sink.rows)) == first_time
    assert {r["vertexId"]: r["componentId"] for r in sink.rows} == dict.fromkeys([2, 5, 6, 8, 9], 2)
    again(spark.createDataFrame([], schema), 2)
    assert sink.rows == []


@pytest.mark.parametrize("seed,eta", [(1, 2), (2, 3)])
def test_clusters_equal_batch_after_every_trigger(spark, scratch, seed, eta):
    rnd = random.Random(seed)
    sink = Held()
    handler = CarriedClusters(scratch, sink, OPEN, eta=eta)
    best = {}
    for n in range(5):
        new = {}
        for _ in range(rnd.randrange(2, 7)):
            t = T0 + dt.timedelta(minutes=rnd.randrange(2))
            pair = (t, f"v{rnd.randrange(12):02d}", f"v{rnd.randrange(12):02d}")
            d = rnd.choice([0.01, 0.03, 0.035, 0.036, 0.5, None])
            low = [x for x in (best.get(pair), new.get(pair), d) if x is not None]
            new[pair] = min(low) if low else None    # the stream hands on running minima
        best.update(new)
        handler(spark.createDataFrame([(*p, d) for p, d in new.items()],
                                      "eventTime timestamp, src string, dst string, distance double"), n)
        got = by_time(sink.rows, lambda r: (r["vertexType"], r["clusterId"]))
        assert got == {t: model_dengraph([(a, b, d) for (u, a, b), d in best.items() if u == t], 0.035, eta)
                       for t in {p[0] for p in new}}


def test_untouched_clusters_are_not_recomputed(spark, scratch):
    sink = Held()
    handler = CarriedClusters(scratch, sink, OPEN)
    schema = "eventTime timestamp, src string, dst string, distance double"

    def trigger(n, pairs):
        handler(spark.createDataFrame([(T0, a, b, d) for a, b, d in pairs], schema), n)
        state = spark.read.parquet(os.path.join(scratch, "state", f"batchId={n}"))
        return {r["vertexId"] for r in state.collect()}

    assert trigger(0, [("a", "u", .01), ("b", "u", .01), ("m", "w", .01), ("n", "w", .01)]) == set("abumnw")
    assert trigger(1, [("p", "q", .9)]) == {"p", "q"}
    assert trigger(2, [("a", "u", .001)]) == set()           # was a neighbour before
    assert trigger(3, [("n", "x", .01), ("p", "q", .5)]) == {"n", "x", "w", "m"}   # n joins w's cluster, renames it
    assert {r["vertexId"]: (r["vertexType"], r["clusterId"]) for r in sink.rows} == {
        "a": ("BORDER", 1), "b": ("BORDER", 1), "u": ("CORE", 1), "m": ("BORDER", 0), "n": ("CORE", 0),
        "w": ("CORE", 0), "x": ("BORDER", 0), "p": ("NOISE", -1), "q": ("NOISE", -1)}


FILES = [[row("10:00", "B")],
         [row("20:00", "C"), row("12:00", "D")],
         [row("12:00", "E"), row("21:00", "B")],
         [row("30:00", "C")]]


def test_stream_of_components_interim_and_final(spark, scratch, graph):  # noqa: F811
    out = replay(spark, scratch, graph, FILES, job=carry_congested_components)
    assert finals(out) == {"10:00": {"A": 1, "B": 1}, "12:00": {"C": 3, "D": 3, "E": 3, "X": 3},
                           "20:00": {"B": 2, "C": 2}, "21:00": {"A": 1, "B": 1}}
    assert out.where("final").groupBy("eventTime", "id").count().where("count > 1").count() == 0
    store = os.path.join(scratch, "chk", "relabel-store")
    assert sorted(os.listdir(os.path.join(store, "state"))) == ["batchId=2", "batchId=3", "batchId=4"]


def test_stream_of_clusters_equals_relabel(spark, scratch, graph):  # noqa: F811
    rows = {}
    for name, job in (("carried", carry_dengraph), ("relabel", relabel_dengraph)):
        folder = os.path.join(scratch, name)
        os.makedirs(folder)
        out = replay(spark, folder, graph, FILES, job=job)
        rows[name] = sorted(tuple(r) for r in out.select("batchId", "eventTime", "final", "vertexId",
                                                         "clusterId", "vertexType", "key").collect())
    assert rows["carried"] == rows["relabel"] and len(rows["carried"]) > 8
