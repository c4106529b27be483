"""Hard negatives by exact inner products, pruned by length and coordinates.

After LEMP (Teflioudi, Gemulla, Mykytiuk, "LEMP: Fast Retrieval of Large Entries in a
Matrix Product", SIGMOD 2015): rows are sorted by label and length and cut
into *length buckets*. For an anchor and a bucket the score it still needs
(its window's lower end, or its k-th best so far) over the anchor's and the
bucket's largest length is a least cosine; above 1 the bucket is skipped.
Otherwise each of the anchor's *focus coordinates* (its largest ones) has a
feasible range of values at that cosine; the bucket's sorted coordinate lists
give the rows in the shortest range, which are intersected with the others',
and what is left is scored exactly, in integers. Where no range is short,
the whole bucket is scored at once.

Anchors are a stated query set against all rows, in tiles: a bounded group of
anchor packs meets a bounded group of buckets in one task, which hands on each
anchor's first rows only; no pair of rows is ever a row of a table, and
neither anchors nor rows pass the driver. A first search finds the positives, a
second one, with the windows they set, the negatives.

Defined cases: rows with a null id, label or vector, or null or non-finite
components take no part; vectors of different lengths never meet; components
saturate at ``LIMIT`` (scores fit a long for up to 16,384 components); repeated
rows are rows of their own, as anchors too, but a row of the anchor's id is never
its positive; an anchor without a positive, or a window without rows, gives no
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trafficgraph.llm import textscan as ts
from trafficgraph.llm.clustering import scaled, usable
from trafficgraph.operators.materialize import write_table

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 3, 9             # tenths of the positive's score a negative may have
LIMIT = 1 << 24
BLOCK_ROWS = 1024            # rows of a bucket, anchors of a pack
BLOCK_BYTES = 1 << 20
GROUP_BYTES = 32 << 20       # buckets of a tile
GROUP_ANCHORS = 16 << 10     # anchors of a tile
SHORTER = 0.8                # a bucket ends where lengths fall below this share of its longest
LEAST_ROWS = 64              # ... but not before it has so many rows
FOCUS = 4                    # focus coordinates
WIDE = 0.5                   # share of a bucket from which it is scored whole
SLACK = 1e-9
NONE = -(1 << 62)            # below any score


def _rows(col: pa.Array, dims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow list column and the first value of each row."""
    return col.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims


def _cuts(label: np.ndarray, length: np.ndarray, lo: int, held: int, most: int,
          first: tuple) -> int:
    """Where the bucket that begins with ``first = (label, length)`` and holds
    ``held`` rows ends, in the rows from ``lo`` on."""
    hi = min(len(label), lo + most - held)
    ends = (length[lo:hi] == 0) != (first[1] == 0)
    short = (label[lo:hi] == first[0]) & (length[lo:hi] < SHORTER * first[1])
    short[:max(0, LEAST_ROWS - held)] = False
    stop = np.flatnonzero(ends | short)
    return lo + int(stop[0]) if len(stop) else hi


def length_buckets(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows ``(id, label, v, anchor)`` as a written table of buckets, in groups of
    bounded bytes: ``bucket, grp, dim, n, lmin, lmax, longest, ids, labels, flags, values``."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    order = ["dim", "label", F.desc("length"), "id"]
    sequence = (rows.select("id", "label", F.size("v").alias("dim"), length.alias("length"), "anchor", "v")
                .repartitionByRange(partitions, *order).sortWithinPartitions(*order))

    def pack(batches):
        from pyspark import TaskContext
        base, made, group, held_bytes = TaskContext.get().partitionId(), 0, 0, 0
        held: list = []              # slices: ids, labels, lengths, flags, values
        start: tuple = ()            # dim, label, longest

        def bucket():
            nonlocal made, group, held_bytes
            ids, labels, lengths, flags, values = (np.concatenate(c) for c in zip(*held))
            held.clear()
            size = len(ids) * (17 + 4 * start[0])
            if held_bytes and held_bytes + size > GROUP_BYTES:
                group, held_bytes = group + 1, 0
            held_bytes += size
            made += 1
            return pa.RecordBatch.from_pydict({
                "bucket": [base << 28 | made], "grp": [base << 28 | group],
                "dim": pa.array([start[0]], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
                "lmin": [int(labels.min())], "lmax": [int(labels.max())],
                "longest": [float(lengths.max())], "ids": [ids.astype("<i8").tobytes()],
                "labels": [labels.astype("<i8").tobytes()], "flags": [flags.astype(np.uint8).tobytes()],
                "values": [values.astype("<i4").tobytes()]})

        for b in batches:
            ids, labels, dims, lengths, flags = (
                b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            values, first = _rows(b.column(5), dims.astype(np.int64))
            turns = np.append(np.flatnonzero(np.diff(dims)) + 1, len(dims))
            lo = 0
            while lo < len(ids):
                dim = int(dims[lo])
                if held and start[0] != dim:
                    yield bucket()
                if not held:
                    start = dim, int(labels[lo]), float(lengths[lo])
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(dim, 1))))
                n = sum(len(h[0]) for h in held)
                same = int(turns[np.searchsorted(turns, lo, side="right")])
                hi = _cuts(labels[:same], lengths[:same], lo, n, most, start[1:])
                if hi > lo:
                    held.append((ids[lo:hi], labels[lo:hi], lengths[lo:hi], flags[lo:hi],
                                 values[first[lo]:first[lo] + (hi - lo) * dim]))
                if hi < same or n + hi - lo == most:
                    yield bucket()
                lo = hi
        if held:
            yield bucket()

    return write_table(sequence.mapInArrow(ts.returning(pack), (
        "bucket long, grp long, dim int, n int, lmin long, lmax long, longest double, "
        "ids binary, labels binary, flags binary, values binary")))[0]


def anchors_of(buckets: DataFrame) -> DataFrame:
    """The flagged rows ``(akey, id, label, dim, v)``; ``akey`` is unique per row."""
    def pick(batches):
        for b in batches:
            for r in b.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["flags"], np.uint8))
                values = np.frombuffer(r["values"], "<i4").reshape(r["n"], r["dim"])[at]
                yield pa.RecordBatch.from_pydict({
                    "akey": pa.array((r["bucket"] << 10) | at),
                    "id": pa.array(np.frombuffer(r["ids"], "<i8")[at]),
                    "label": pa.array(np.frombuffer(r["labels"], "<i8")[at]),
                    "dim": pa.array(np.full(len(at), r["dim"], np.int32)),
                    "v": pa.array([v.tobytes() for v in values], pa.binary())})

    with_anchor = buckets.select("bucket", "n", "dim", "ids", "labels", "flags", "values")
    return with_anchor.mapInArrow(ts.returning(pick), "akey long, id long, label long, dim int, v binary")


def anchor_packs(anchors: DataFrame, partitions: int) -> DataFrame:
    """Anchors with their windows (``scores``, one per positive) in packs of bounded
    size, sorted by label: ``pgrp, dim, lmin, lmax, akeys, ids, labels, values, scores, width``."""
    order = ["dim", "label", "akey"]
    sequence = (anchors.select("akey", "id", "label", "dim", "v", "scores")
                .repartitionByRange(partitions, *order).sortWithinPartitions(*order))

    def pack(batches):
        from pyspark import TaskContext
        base, made, held = TaskContext.get().partitionId(), 0, []

        def done():
            nonlocal made
            width = max(1, max(len(r["scores"]) for r in held))
            scores = np.full((len(held), width), NONE, np.int64)
            for i, r in enumerate(held):
                scores[i, :len(r["scores"])] = r["scores"]
            labels = [r["label"] for r in held]
            out = pa.RecordBatch.from_pydict({
                "pgrp": [base << 28 | made * BLOCK_ROWS // GROUP_ANCHORS],
                "dim": pa.array([held[0]["dim"]], pa.int32()), "lmin": [min(labels)], "lmax": [max(labels)],
                "akeys": [np.array([r["akey"] for r in held], "<i8").tobytes()],
                "ids": [np.array([r["id"] for r in held], "<i8").tobytes()],
                "labels": [np.array(labels, "<i8").tobytes()],
                "values": [b"".join(r["v"] for r in held)],
                "scores": [scores.astype("<i8").tobytes()], "width": pa.array([width], pa.int32())})
            held.clear()
            made += 1
            return out

        for b in batches:
            for r in b.to_pylist():
                if held and (held[0]["dim"] != r["dim"] or len(held) == BLOCK_ROWS):
                    yield done()
                held.append(r)
        if held:
            yield done()

    return write_table(sequence.mapInArrow(ts.returning(pack), (
        "pgrp long, dim int, lmin long, lmax long, akeys binary, ids binary, labels binary, "
        "values binary, scores binary, width int")))[0]


class Bucket:
    """A length bucket with its sorted coordinate lists (made when first asked for)."""

    def __init__(self, r: dict) -> None:
        self.ids, self.labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
        self.values = np.frombuffer(r["values"], "<i4").reshape(r["n"], r["dim"]).astype(np.float64)
        self.longest, self.lmin, self.lmax = r["longest"], r["lmin"], r["lmax"]
        self.largest = np.abs(self.values).max(initial=0)
        self._unit = None
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @property
    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.values / np.linalg.norm(self.values, axis=1, keepdims=True)
        return self._unit

    def list_of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows sorted by coordinate ``f`` of their direction, and its values in that order."""
        if f not in self._lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._lists[f] = order, self.unit[order, f]
        return self._lists[f]


def feasible(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of a coordinate of the unit vectors within ``cosine`` of one with coordinate ``q``."""
    a = np.arccos(np.clip(cosine - SLACK, -1, 1))
    b = np.arccos(np.clip(q, -1, 1))
    return np.cos(np.minimum(np.pi, b + a)) - SLACK, np.cos(np.maximum(0, b - a)) + SLACK


class Pack:
    """A pack of anchors and the first ``k`` rows found for each of their windows so far."""

    def __init__(self, r: dict, k: int, positives: bool) -> None:
        self.akeys, self.ids = np.frombuffer(r["akeys"], "<i8"), np.frombuffer(r["ids"], "<i8")
        self.labels, self.k, self.positives = np.frombuffer(r["labels"], "<i8"), k, positives
        n = len(self.ids)
        self.values = np.frombuffer(r["values"], "<i4").reshape(n, r["dim"]).astype(np.float64)
        self.length = np.linalg.norm(self.values, axis=1)
        self.largest = np.abs(self.values).max(initial=0)
        if positives:
            self.low, self.high = np.full((n, 1), NONE), np.full((n, 1), -NONE)
        else:
            s = np.frombuffer(r["scores"], "<i8").reshape(n, r["width"])
            # LOW / 10 of the score rounded up, HIGH / 10 rounded down, without overflow
            self.low = LOW * (s // 10) + -((-LOW * (s % 10)) // 10)
            self.high = np.where(s == NONE, NONE, HIGH * (s // 10) + (HIGH * (s % 10)) // 10)
        self.kth = np.full(self.low.shape, NONE)     # the k-th best score of a window so far
        self.found = tuple(np.empty(0, np.int64) for _ in range(3))     # window, score, id
        size = min(FOCUS, r["dim"])
        self.focus = np.argsort(-np.abs(self.values), axis=1, kind="stable")[:, :size]
        safe = np.where(self.length > 0, self.length, 1)[:, None]
        self.q = np.take_along_axis(self.values, self.focus, axis=1) / safe

    def search(self, b: Bucket) -> None:
        """Add the bucket's rows that are among the first of a window."""
        need = np.maximum(self.low, self.kth)
        open_ = self.low <= self.high
        least = np.where(open_, need, -NONE).min(axis=1)
        most = self.length * b.longest
        if self.positives:
            meets = (b.lmin <= self.labels) & (self.labels <= b.lmax)
        else:
            meets = ~((b.lmin == self.labels) & (self.labels == b.lmax))
        cosine = np.where(most > 0, least / np.where(most > 0, most, 1), np.where(least <= 0, -2.0, 2.0))
        live = np.flatnonzero(meets & open_.any(axis=1) & (cosine <= 1 + SLACK))
        if not len(live):
            return
        narrow, first, last, column = self._ranges(b, live, cosine)
        new = []
        whole = live[~narrow[live]]
        if len(whole):
            new += self._take(b, whole, self._scores(b, whole), None)
        for a in live[narrow[live]]:
            rows = b.list_of(self.focus[a, column[a]])[0][first[a]:last[a]]
            low, high = feasible(self.q[a], cosine[a])
            inside = b.unit[rows][:, self.focus[a]]
            rows = rows[((inside >= low) & (inside <= high)).all(axis=1)]
            if len(rows):
                new += self._take(b, np.array([a]), self._scores(b, np.array([a]), rows), rows)
        if new:
            self._merge(new)

    def _ranges(self, b: Bucket, live: np.ndarray, cosine: np.ndarray):
        """The shortest range of each anchor in the bucket's coordinate lists; ``narrow`` where
        it is worth following."""
        n = len(self.ids)
        narrow, best = np.zeros(n, bool), np.full(n, len(b.ids))
        first, last, column = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        tight = live[(cosine[live] > -1) & (self.length[live] > 0)] if b.longest > 0 else live[:0]
        if len(tight) and self.focus.shape[1]:
            low, high = feasible(self.q[tight], cosine[tight][:, None])
            for f in np.unique(self.focus[tight]):
                order_values = b.list_of(f)[1]
                at, c = np.nonzero(self.focus[tight] == f)
                lo = np.searchsorted(order_values, low[at, c], side="left")
                hi = np.searchsorted(order_values, high[at, c], side="right")
                less = hi - lo < best[tight[at]]
                a = tight[at[less]]
                best[a], first[a], last[a], column[a] = (hi - lo)[less], lo[less], hi[less], c[less]
            narrow[tight] = best[tight] < WIDE * len(b.ids)
        return narrow, first, last, column

    def _scores(self, b: Bucket, anchors: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        x, y = self.values[anchors], b.values if rows is None else b.values[rows]
        if self.largest * b.largest * max(x.shape[1], 1) >= 2.0 ** 53:
            return x.astype(np.int64) @ y.astype(np.int64).T        # beyond exact doubles
        return (x @ y.T).astype(np.int64)

    def _take(self, b: Bucket, anchors: np.ndarray, scores: np.ndarray, rows: np.ndarray | None) -> list:
        ids, labels = (b.ids, b.labels) if rows is None else (b.ids[rows], b.labels[rows])
        same = self.labels[anchors][:, None] == labels[None, :]
        fits = same & (self.ids[anchors][:, None] != ids[None, :]) if self.positives else ~same
        out = []
        for j in range(self.low.shape[1]):
            low = np.maximum(self.low[anchors, j], self.kth[anchors, j])
            s = np.where(fits & (scores >= low[:, None]) & (scores <= self.high[anchors, j][:, None]),
                         scores, NONE)
            if s.shape[1] > self.k:
                here = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                s = np.where(s >= here[:, None], s, NONE)
            at, col = np.nonzero(s > NONE)
            if len(at):
                out.append((anchors[at] * self.low.shape[1] + j, s[at, col], ids[col]))
        return out

    def _merge(self, new: list) -> None:
        window, score, ids = (np.concatenate(c) for c in zip(self.found, *new))
        order = np.lexsort((ids, ~score, window))
        window, score, ids = window[order], score[order], ids[order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(window)) + 1))
        counts = np.diff(np.append(starts, len(window)))
        place = np.arange(len(window)) - np.repeat(starts, counts)
        keep = place < self.k
        self.found = window[keep], score[keep], ids[keep]
        full = keep & (place == self.k - 1)
        self.kth.ravel()[window[full]] = score[full]

    def table(self) -> pa.Table:
        window, score, ids = self.found
        a, j = np.divmod(window, self.low.shape[1])
        return pa.table({"akey": self.akeys[a], "anchor_id": self.ids[a],
                         "slot": (j + 1).astype(np.int32), "id": ids, "score": score})


FOUND = "akey long, anchor_id long, slot int, id long, score long"


def search_tiles(packs: DataFrame, buckets: DataFrame, k: int, positives: bool) -> DataFrame:
    """The first ``k`` rows of each window: every anchor group against every bucket group."""
    sides = []
    for df, key in ((packs, "pgrp"), (buckets, "grp")):
        sides.append(df.groupBy(key, "dim").agg(F.min("lmin").alias(f"{key}_lo"), F.max("lmax").alias(f"{key}_hi")))
    # Lists of groups, not rows: their tiles are what tasks work on. A group whose
    # labels the other side does not have (or has alone) is left out.
    tiles = sides[0].join(sides[1], "dim")
    lo, hi, glo, ghi = (F.col(c) for c in ("pgrp_lo", "pgrp_hi", "grp_lo", "grp_hi"))
    tiles = tiles.where((lo <= ghi) & (glo <= hi) if positives
                        else ~((lo == hi) & (glo == ghi) & (lo == glo)))
    tiles, _ = write_table(tiles.select("dim", "pgrp", "grp"))
    left = packs.join(tiles, ["dim", "pgrp"]).groupBy("pgrp", "grp", "dim")
    right = (buckets.select("dim", "grp", "n", "lmin", "lmax", "longest", "ids", "labels", "values")
             .join(tiles, ["dim", "grp"]).groupBy("pgrp", "grp", "dim"))

    def tile(p: pa.Table, b: pa.Table) -> pa.Table:
        longest_first = sorted(b.to_pylist(), key=lambda r: -r["longest"])
        held = [Pack(r, k, positives) for r in p.to_pylist()]
        for r in longest_first:
            bucket = Bucket(r)
            for pack in held:
                pack.search(bucket)
        return pa.concat_tables([pack.table() for pack in held])

    found = left.cogroup(right).applyInArrow(tile, FOUND)
    first = Window.partitionBy("akey", "slot").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k))


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id",
                   label: Column | str = "label", vector_col: str = "embedding",
                   scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``
    for the rows where ``anchor`` holds (a condition on the columns of ``vectors``)."""
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                           F.col(vector_col).alias("_x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("_x"))
            .select("id", "label", scaled("_x", scale, LIMIT).alias("v"), "anchor"))
    n = rows.agg(F.sum(F.size("v").cast("long") * 4 + 17).alias("bytes"),
                 F.count(F.when(F.col("anchor"), 1)).alias("anchors")).first()
    parallel = 2 * spark.sparkContext.defaultParallelism
    pack_groups = max(1, -(-n.anchors // GROUP_ANCHORS))
    bucket_groups = max(-(-(n.bytes or 0) // GROUP_BYTES), -(-parallel // pack_groups))
    buckets = length_buckets(rows, bucket_groups)
    anchors, _ = write_table(anchors_of(buckets))
    plain = anchors.withColumn("scores", F.array().cast("array<long>"))
    best, _ = write_table(search_tiles(anchor_packs(plain, pack_groups), buckets, positives, True)
                          .select("akey", "anchor_id", F.col("rank").alias("slot"),
                                  F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # positives of one anchor: at most ``positives`` rows
    scores = best.groupBy("akey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("slot", "positive_score"))),
        lambda s: s["positive_score"]).alias("scores"))
    windows = anchors.join(scores, "akey")
    found = search_tiles(anchor_packs(windows, pack_groups), buckets, negatives, False)
    return (found.select("akey", "slot", "rank", F.col("id").alias("negative_id"),
                         F.col("score").alias("negative_score"))
            .join(best, ["akey", "slot"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
