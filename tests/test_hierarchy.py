"""Components of every class, the vertex dictionary, and cluster tracks."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from model import components as model_components
from trafficgraph.operators.dictionary import VertexDictionary
from trafficgraph.operators.materialize import table_scope
from trafficgraph.operators.tracking import track_clusters
from trafficgraph.plans.hierarchy import (CLASS, components_by_class, maximum_spanning_forest, nesting)

T0 = dt.datetime(2016, 5, 9, 10, 0)


def random_edges(seed, n=40):
    rnd = random.Random(seed)
    best = {}
    for _ in range(n):
        t = T0 + dt.timedelta(minutes=rnd.randrange(2))
        best[t, rnd.randrange(25), rnd.randrange(25)] = rnd.randrange(0, 5)
    return [(*k, c) for k, c in best.items()]


def test_every_class_and_nesting(spark):
    rows = random_edges(5)
    df = spark.createDataFrame(rows, f"eventTime timestamp, src int, dst int, {CLASS} int")
    with table_scope():
        forest = maximum_spanning_forest(df, CLASS).collect()
        labels = components_by_class(df, [1, 2, 3, 4])
        got = {}
        for r in labels.collect():
            got.setdefault((r[CLASS], r["eventTime"]), {})[r["vertexId"]] = r["componentId"]
        tree = nesting(labels).collect()
    want = {}
    for c in (1, 2, 3, 4):
        for t in {r[0] for r in rows}:
            edges = [(a, b) for u, a, b, w in rows if u == t and w >= c]
            if edges:
                want[c, t] = model_components(edges)
    assert got == want
    # a forest: as many edges as vertices less components, and of the largest total weight
    for t in {r[0] for r in rows}:
        mine = [(r["src"], r["dst"], r[CLASS]) for r in forest if r["eventTime"] == t]
        edges = sorted(((w, a, b) for u, a, b, w in rows if u == t and a != b), reverse=True)
        root, total, count = {}, 0, 0

        def find(v):
            while root.get(v, v) != v:
                v = root[v]
            return v
        for w, a, b in edges:
            if find(a) != find(b):
                root[find(a)] = find(b)
                total, count = total + w, count + 1
        assert (sum(w for _, _, w in mine), len(mine)) == (total, count)
    for r in tree:
        c, t = r[CLASS], r["eventTime"]
        members = [v for v, l in want[c, t].items() if l == r["componentId"]]
        assert r["vertices"] == len(members)
        assert r["parentId"] == (-1 if c == 1 else want[c - 1, t][members[0]])


def test_dictionary_keeps_numbers(spark, scratch):
    book = VertexDictionary(spark, os.path.join(scratch, "book"))

    def edges(*pairs):
        return spark.createDataFrame(pairs, "src string, dst string")

    def numbers(version=None):
        return {r["id"]: r["numericId"] for r in book.vertices(version).collect()}

    assert numbers() == {} and book.version() == 0
    assert book.extend(edges(("m", "z"), ("z", "c"))) == 1
    first = numbers()
    assert first == {"c": 1, "m": 2, "z": 3}
    assert book.extend(edges(("a", "m"), ("n", "n"))) == 2
    assert numbers() == {**first, "a": 4, "n": 5} and numbers(1) == first
    assert book.extend(edges(("a", "z"))) == 2                      # nothing new, no version
    # an extension that died before its commit does not count and is overwritten
    torn = os.path.join(scratch, "book", "version=3")
    spark.createDataFrame([(9, "x")], "numericId long, id string").write.parquet(torn)
    os.remove(os.path.join(torn, "_SUCCESS"))
    assert numbers() == {**first, "a": 4, "n": 5}
    assert book.extend(edges(("x", "b"))) == 3
    assert numbers()["b"] == 6 and numbers()["x"] == 7
    labels = spark.createDataFrame([(1,), (5,)], "vertexId long")
    assert {r["vertexId"]: r["id"] for r in book.decode(labels).collect()} == {1: "c", 5: "n"}
    encoded = book.encode(edges(("a", "z")), version=2).first()
    assert (encoded["srcNumericId"], encoded["dstNumericId"]) == (4, 3)


def test_tracks_follow_merges_and_splits_in_any_row_order(spark):
    steps = [{0: "abcd", 1: "efg", 2: "xy"},       # three clusters
             {0: "abefg", 1: "cd"},                # efg took ab; cd split off; xy is gone
             {0: "abefg", 1: "cd", 2: "uv"},
             {0: "abcdefg", 1: "u"}]               # cd merged in
    rows = [(T0 + dt.timedelta(minutes=10 * i), c, v) for i, s in enumerate(steps) for c, m in s.items() for v in m]
    rows += [(T0, -1, "noise"), (T0 + dt.timedelta(minutes=10), None, "q")]
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "eventTime timestamp, clusterId int, vertexId string").repartition(seed)
        results.append({(r["eventTime"].minute // 10, r["clusterId"]): (r["trackId"], r["origin"], r["merged"])
                        for r in track_clusters(df).collect()})
    name = lambda step, c: f"{step:010d}.{c:010d}"
    # of abcd's two successors 0 and 1 (two vertices each) it names the smaller, which came from efg
    assert results[0] == results[1] == {
        (0, 0): (name(1, 0), "START", 0), (0, 1): (name(1, 1), "START", 0), (0, 2): (name(1, 2), "START", 0),
        (1, 0): (name(1, 1), "CONTINUE", 1), (1, 1): (name(2, 1), "SPLIT", 0),
        (2, 0): (name(1, 1), "CONTINUE", 0), (2, 1): (name(2, 1), "CONTINUE", 0), (2, 2): (name(3, 2), "START", 0),
        (3, 0): (name(1, 1), "CONTINUE", 1), (3, 1): (name(3, 2), "CONTINUE", 0)}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], f"eventTime timestamp, src int, dst int, {CLASS} int")
    assert components_by_class(empty, [1, 2]).count() == 0
    none = spark.createDataFrame([], "eventTime timestamp, clusterId int, vertexId string")
    assert track_clusters(none).count() == 0
