"""Random graphs: distributed results equal the plain models, for any row order."""

import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from model import components as model_components
from model import dengraph as model_dengraph
from trafficgraph.operators import connected_components, dengraph_clusters
from trafficgraph.functions.distance import proximity_distance

T1 = dt.datetime(2016, 5, 9, 0, 0)
T2 = dt.datetime(2016, 5, 9, 0, 1)

edge_lists = st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(edges=edge_lists, seed=st.integers(0, 1000))
def test_components_equal_model_and_order_free(spark, edges, seed):
    shuffled = list(edges)
    random.Random(seed).shuffle(shuffled)
    flipped = [(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(shuffled)]
    rows = [(T1, a, b) for a, b in edges] + [(T2, a, b) for a, b in flipped]
    df = spark.createDataFrame(rows, "eventTime timestamp, src int, dst int")
    got = {}
    for r in connected_components(df).collect():
        got.setdefault(r["eventTime"], {})[r["vertexId"]] = r["componentId"]
    expected = model_components(edges)
    assert got[T1] == expected
    assert got[T2] == expected


pair_lists = st.lists(
    st.tuples(st.sampled_from("abcdefghij"), st.sampled_from("abcdefghij"),
              st.one_of(st.none(), st.sampled_from([0.0, -5.0, 10.0, 25.0, 28.0, 29.0, 40.0, 80.0]))),
    min_size=1, max_size=30)


@SETTINGS
@given(pairs=pair_lists, eta=st.integers(1, 4))
def test_dengraph_equals_model(spark, pairs, eta):
    df = spark.createDataFrame([(T1, s, d, w) for s, d, w in pairs],
                               "eventTime timestamp, src string, dst string, weight double")
    dist = df.select("src", "dst", proximity_distance().alias("distance")).collect()
    expected = model_dengraph([(r[0], r[1], r[2]) for r in dist], 0.035, eta)
    got = {r["vertexId"]: (r["vertexType"], r["clusterId"])
           for r in dengraph_clusters(df, eta=eta).collect()}
    assert got == expected
