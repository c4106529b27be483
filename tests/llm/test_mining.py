"""Hard negatives: pruned search against all pairs, in process and as whole queries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficgraph.llm import mining as mi
from trafficgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(rows, is_anchor, scale=256, positives=5, negatives=10):
    """Sorted result rows by comparing every pair in Python integers; rows: (id, label, vector)."""
    kept = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        kept.append((i, label, [max(-mi.LIMIT, min(mi.LIMIT, math.floor(scale * v))) for v in x]))
    out = []
    for i, label, a in kept:
        if not is_anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(a, b)), j, other) for j, other, b in kept if len(a) == len(b)]
        for s, j, _ in sorted(r for r in scored if r[2] == label and r[1] != i)[:positives]:
            hits = sorted(r[:2] for r in scored if r[2] != label
                          and 30 * -s <= 100 * -r[0] <= 90 * -s)[:negatives]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(hits)]
    return sorted(out)


def got(df, anchor, **kw):
    return sorted(tuple(r) for r in mi.hard_negatives(df, anchor, **kw).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def pack_of(a, ids, labels, positives, k, scores=None):
    n = len(a)
    scores = np.full((n, 1), mi.NONE) if scores is None else scores
    return mi.Pack({"akeys": np.arange(n).tobytes(), "ids": ids.tobytes(), "labels": labels.tobytes(),
                    "values": a.astype("<i4").tobytes(), "dim": a.shape[1], "width": scores.shape[1],
                    "scores": scores.astype("<i8").tobytes()}, k, positives)


def bucket_of(b, ids, labels):
    return mi.Bucket({"ids": ids.tobytes(), "labels": labels.tobytes(), "values": b.astype("<i4").tobytes(),
                      "n": len(b), "dim": b.shape[1], "lmin": int(labels.min()), "lmax": int(labels.max()),
                      "longest": float(np.linalg.norm(b, axis=1).max())})


@pytest.mark.parametrize("spread", [0.05, 0.5, 5.0])
def test_coordinate_lists_lose_nothing(spread, monkeypatch):
    """Clear directions, so that ranges are short; every bucket's rows found by plain search."""
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(8, 6))
    def draw(n):
        x = centres[rnd.integers(0, 8, n)] + spread * rnd.normal(size=(n, 6))
        return np.round(200 * x * rnd.uniform(0.2, 2, n)[:, None]).astype(np.int64)
    a, blocks = draw(40), [draw(100) for _ in range(6)]
    labels = rnd.integers(0, 2, 40)
    pack = pack_of(a, np.arange(40), labels, True, 3)
    narrow_rows, taken = [], mi.Pack._take

    def watched(self, b, anchors, scores, rows):
        if rows is not None:
            narrow_rows.append(len(rows))
        return taken(self, b, anchors, scores, rows)
    monkeypatch.setattr(mi.Pack, "_take", watched)
    all_rows = []
    for i, b in enumerate(blocks):
        ids, lab = 1000 * (i + 1) + np.arange(len(b)), rnd.integers(0, 2, len(b))
        all_rows += list(zip(ids, lab, b))
        pack.search(bucket_of(b, ids, lab))
    t = pack.table().to_pylist()
    for i in range(40):
        want = sorted((-int(x @ a[i]), int(j)) for j, lab, x in all_rows if lab == labels[i])[:3]
        assert [(-r["score"], r["id"]) for r in t if r["akey"] == i] == want
    assert narrow_rows or spread > 0.1       # the lists were followed


def test_query_equals_plain_version(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in table]
    want = plain(rows, lambda i: i % 100 == 0)
    assert len(want) > 100
    assert sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, SF).collect()) == want


def test_ties_zero_vectors_repeats_and_lengths(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, int(rnd.integers(0, 3)), [float(v) for v in rnd.integers(-2, 3, 3)]) for i in range(120)]
    rows += [(200 + i, i % 3, [0.0] * 3) for i in range(9)]                   # zero vectors
    rows += [(300 + i, i % 3, [1.0, 1.0]) for i in range(6)] + [(310, 0, []), (311, 0, []), (312, 1, [])]
    rows += [(400 + i, i % 2, [1e-3 * i, 1e3, -1e3]) for i in range(6)]
    rows += rows[:4]                                                         # repeated rows
    rows += [(None, 1, [1.0] * 3), (500, None, [1.0] * 3), (501, 1, None), (502, 1, [None, 1.0, 1.0]),
             (505, 1, [float("nan"), 1.0, 1.0]), (510, 1, [float("inf"), 1.0, 1.0])]
    want = plain(rows, lambda i: i % 5 == 0)
    assert got(frame(spark, rows), F.col("vec_id") % 5 == 0) == want and len(want) > 500


def test_near_copies_in_one_hot_label(spark):
    rnd = np.random.default_rng(6)
    centre = rnd.normal(size=(6, 16))
    rows = [(i, 0 if i % 3 else int(rnd.integers(1, 40)), [float(v) for v in
             centre[i % 6] + 0.02 * rnd.normal(size=16)]) for i in range(3000)]
    want = plain(rows, lambda i: i % 150 == 0)
    assert got(frame(spark, rows), F.col("vec_id") % 150 == 0) == want


def test_scores_beyond_exact_doubles(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, i % 2, [float(v) for v in rnd.uniform(0, 60000, 8)]) for i in range(60)]
    rows += [(100 + i, i % 2, [1e30] * 8) for i in range(4)]                 # saturated
    want = plain(rows, lambda i: i % 10 == 0)
    assert max(r[4] for r in want) > 1 << 50
    assert got(frame(spark, rows), F.col("vec_id") % 10 == 0) == want


def test_clashing_columns_no_anchor_no_positive_empty(spark):
    rows = [(10, 1, [1.0, 0.0]), (11, 2, [0.5, 0.0]), (20, 3, [1.0, 0.0]), (12, 1, [1.0, 0.0])]
    df = frame(spark, rows)
    for name in ("id", "v", "anchor", "akey", "rank", "_x", "dim"):
        df = df.withColumn(name, F.lit("x"))
    anchor = F.col("vec_id") % 10 == 0
    assert got(df, anchor) == plain(rows, lambda i: i % 10 == 0) == [(10, 12, 1, 11, 65536, 32768)]
    assert got(df, F.col("vec_id") < 0) == [] and got(df.limit(0), anchor) == []
    assert got(df, F.lit(None).cast("boolean")) == []


def test_no_cross_join_and_tiles_are_bounded(spark):
    plan = QUERIES["op12_hard_negatives"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
