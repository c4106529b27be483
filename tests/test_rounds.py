"""Components rounds that shrink: settled vertices leave, their labels come back."""

import random

import pytest
from pyspark.sql import functions as F

from model import components as model_components
from trafficgraph.operators import connected_components
from trafficgraph.operators import components as module
from trafficgraph.operators.materialize import materialize_sized, table_scope

SCHEMA = "eventTime int, src int, dst int"


def many_pieces(seed, graphs=2):
    """Stars, paths, pairs and tangles of random vertex numbers, in several graphs."""
    rnd = random.Random(seed)
    out = []
    for t in range(graphs):
        ids = list(range(1200))
        rnd.shuffle(ids)
        edges = []
        while len(ids) > 200:
            kind = rnd.choice(["star", "path", "pair", "tangle", "loop"])
            part = [ids.pop() for _ in range({"star": 12, "path": 40, "pair": 2, "tangle": 25, "loop": 1}[kind])]
            if kind == "star":
                edges += [(part[0], v) for v in part[1:]]
            elif kind == "tangle":
                edges += [(rnd.choice(part), rnd.choice(part)) for _ in range(40)]
            else:
                edges += list(zip(part, part[1:])) or [(part[0], part[0])]
        out.append((t, edges))
    return out


def labels_of(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["eventTime"], {})[r["vertexId"]] = r["componentId"]
    return got


@pytest.mark.parametrize("share,least,hot_rows", [(0.0, 0.0, 1_000_000), (0.4, 0.05, 1_000_000), (0.0, 0.0, 8)])
def test_rounds_shrink_and_labels_stay_right(spark, monkeypatch, share, least, hot_rows):
    monkeypatch.setattr(module, "SETTLE_SHARE", share)
    monkeypatch.setattr(module, "SETTLE_FROM", least)
    graphs = many_pieces(11)
    df = spark.createDataFrame([(t, a, b) for t, edges in graphs for a, b in edges], SCHEMA)
    rounds = []
    with table_scope():
        got = labels_of(connected_components(df, hot_rows=hot_rows, on_round=rounds.append))
    assert got == {t: model_components(edges) for t, edges in graphs}
    if share == 0.0:         # every settled vertex leaves: each round is smaller than the last
        assert all(b.vertices < a.vertices for a, b in zip(rounds, rounds[1:]))
    assert rounds[-1].rows < rounds[0].rows / 5


def test_rounds_shrink_on_the_events_table(spark):
    import __spark_entry__ as se
    graph, m = se._graph(spark, "/root/testdata/sf0.01")
    rounds = []
    labels = connected_components(se.congested_edges(m, graph), on_round=rounds.append)
    assert labels.count() == rounds[0].vertices
    assert rounds[-1].rows < rounds[0].rows / 4


def test_one_star_is_done_at_once(spark):
    df = spark.createDataFrame([(0, 1, v) for v in range(2, 50)], SCHEMA)
    rounds = []
    assert set(labels_of(connected_components(df, on_round=rounds.append))[0].values()) == {1}
    assert len(rounds) == 1 and rounds[0].settled == 48


def test_sizes_measured_while_writing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bücher"), (3, None)], "n int, s string")
    table, size = materialize_sized(df)
    assert size.rows == 3 and size.widths == {"n": 8, "s": 8 + 7}
    assert table.count() == 3
    empty = materialize_sized(df.where(F.lit(False)))[1]
    assert empty.rows == 0 and empty.bytes_of(["n", "s"]) == 0
