"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label are linked when their cosine reaches the threshold, that is
when their unit vectors are at most epsilon apart. Unit vectors are rotated to
principal axes and sorted by the cells of a grid of epsilon's size on the
leading axes; the sequence is cut into blocks. Pairs of sequence intervals are
joined recursively from whole labels down to blocks, eight parts of an
interval at a time, and pairs whose bounding boxes are further than epsilon
apart are skipped, as no vectors in them can be linked. Pairs of blocks that
remain are compared exactly, in double precision.

Equal vectors of a label become one class with a number of copies, so copies
never meet. Of a pair of blocks only the links of each vector are counted and
a spanning set of edges is kept, never all pairs. Rotation only orders the
sequence: it is fitted on a hash share of the classes, about ``PCA_SAMPLE``
vectors and ``PCA_BYTES`` of values whatever the table and its partitions, and
results do not depend on it. Pairs of blocks are dealt by tiles of ``TILE`` x
``TILE`` blocks of the sequence, so that a block is sent once for a tile rather than
for each of its pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label or id, link with nothing and are kept;
vectors of different lengths are never linked; repeated rows are vectors of
their own (rows of one id share a component); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.llm import textscan as ts
from trafficgraph.operators.components import connected_components
from trafficgraph.operators.materialize import write_table
from trafficgraph.operators.numbering import dense_number
from trafficgraph.operators.skew import DEFAULT_HOT_ROWS, hot_keys, salted_join

MIN_COSINE = 0.93
PCA_SAMPLE = 10_000
PCA_BYTES = 8 << 20          # values of the sample
AXES = 8                     # leading principal axes of the grid
BOX_AXES = 16                # axes of bounding boxes
BLOCK_BYTES = 512 << 10      # vectors of a block
BLOCK_ROWS = 1024
FAN = 3                      # bits: an interval has 8 parts
TILE = 4                     # bits: a tile has 16 x 16 pairs of blocks, 32 blocks of memory
_SHARES = 1 << 30            # steps of the sample's share


def _usable(label: str, vector: str) -> F.Column:
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad
            & F.exists(x, lambda v: v != 0))


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)      # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(classes: DataFrame, sample: int = PCA_SAMPLE) -> dict[int, np.ndarray]:
    """Rotation for each length of vectors in a bounded sample of the classes."""
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if not size["n"]:
        return {}
    wanted = max(1, min(sample, PCA_BYTES // (8 * size["dim"])))
    share = min(_SHARES, _SHARES * wanted // size["n"] + 1)
    part = F.pmod(F.xxhash64("id", "label", F.size("vector")), F.lit(_SHARES))
    rows = classes.where(part < share).select("vector").toArrow()
    out = {}
    for dim, _, vectors in _lists(rows.column(0).combine_chunks()):
        x = _unit(vectors, dim)
        _, axes = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim))
        out[dim] = axes[:, ::-1].copy()
    return out


def _rotate(x: np.ndarray, axes: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The leading ``n`` principal coordinates of unit vectors, zero-padded."""
    dim = x.shape[1]
    y = (x @ axes[dim] if dim in axes else x)[:, :n]
    return np.pad(y, ((0, 0), (0, n - y.shape[1])))


def _lists(col: pa.Array):
    """Vectors of one length each: ``(rows, flat values)`` of an Arrow list column."""
    flat = np.asarray(col.flatten(), np.float64)
    n = np.diff(np.concatenate(([0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False)))))
    first = np.cumsum(n) - n
    for dim in np.unique(n):
        rows = np.flatnonzero(n == dim)
        yield int(dim), rows, flat[(first[rows][:, None] + np.arange(dim)).ravel()]


def grid_blocks(classes: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """Blocks of the sequence in epsilon grid order: ``block, label, dim, ids, copies, vectors``
    (packed) with their boxes ``lo`` and ``hi`` on the principal axes."""
    def cells(batches):
        for b in batches:
            cell = np.zeros((b.num_rows, AXES), np.int32)
            for dim, rows, flat in _lists(b.column(3)):
                cell[rows] = np.floor(_rotate(_unit(flat, dim), axes, AXES) / epsilon)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(np.ascontiguousarray(cell[:, i])) for i in range(AXES))],
                [*b.schema.names, *names])

    names = [f"c{i}" for i in range(AXES)]
    typed = classes.select("id", "copies", F.col("label"), F.col("vector"), F.size("vector").alias("dim"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema)
    order = ["label", "dim", *names, "id"]
    sequence = (typed.mapInArrow(ts.returning(cells), f"{fields}, " + ", ".join(f"{c} int" for c in names))
                .repartitionByRange(*order).sortWithinPartitions(*order))
    label_type = typed.schema["label"].dataType.simpleString()

    def pack(batches):
        from pyspark import TaskContext
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list = []          # (label, dim, ids, copies, flat)

        def block():
            nonlocal made
            label, dim = held[0][:2]
            ids, copies, flat = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
            y = _rotate(_unit(flat, dim), axes, BOX_AXES)
            made += 1
            held.clear()
            return {"block": base + made, "label": label, "dim": dim, "ids": ids.astype("<i8").tobytes(),
                    "copies": copies.astype("<i8").tobytes(), "vectors": flat.tobytes(),
                    "lo": y.min(axis=0).tolist(), "hi": y.max(axis=0).tolist()}

        for b in batches:
            ids, copies = b.column(0).to_numpy(), b.column(1).to_numpy()
            label, dims = b.column(2).to_pylist(), b.column(4).to_numpy()
            flat = np.asarray(b.column(3).flatten(), np.float64)
            first = np.cumsum(dims.astype(np.int64)) - dims
            lo = 0
            while lo < b.num_rows:
                key = label[lo], int(dims[lo])
                if held and held[0][:2] != key:
                    yield block()
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * key[1])))
                room = most - sum(len(h[2]) for h in held)
                hi = lo
                while hi < b.num_rows and hi - lo < room and (label[hi], int(dims[hi])) == key:
                    hi += 1
                held.append((*key, ids[lo:hi], copies[lo:hi], flat[first[lo]:first[lo] + (hi - lo) * key[1]]))
                if hi - lo == room:
                    yield block()
                lo = hi
        if held:
            yield block()

    def batched(batches):
        for row in pack(batches):
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    schema = (f"block long, label {label_type}, dim int, ids binary, copies binary, vectors binary, "
              "lo array<double>, hi array<double>")
    arrow = to_arrow_schema(classes.sparkSession.createDataFrame([], schema).schema)
    return write_table(sequence.mapInArrow(ts.returning(batched), schema))[0]


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs ``a <= b`` of blocks that may hold links, by recursive interval joins, with
    their tile (``label, dim, tile_a, tile_b``)."""
    key = ["label", "dim"]
    boxes = blocks.select("block", *key, "lo", "hi")
    level, _ = write_table(dense_number(boxes, "block", key, "part")
                           .select(*key, (F.col("part") - 1).alias("part"), "block", "lo", "hi"))
    top = level.agg(F.max("part")).first()[0]
    depth = max(1, math.ceil(int(top or 0).bit_length() / FAN))
    levels = [level]
    for _ in range(depth):
        up = levels[-1].withColumn("part", F.shiftright("part", FAN))
        levels.append(up.groupBy(*key, "part").agg(
            F.array(*[F.min(F.col("lo")[i]) for i in range(BOX_AXES)]).alias("lo"),
            F.array(*[F.max(F.col("hi")[i]) for i in range(BOX_AXES)]).alias("hi")))
    gap = F.zip_with(F.zip_with("hi_a", "lo_b", lambda x, y: y - x),
                     F.zip_with("hi_b", "lo_a", lambda x, y: y - x), lambda x, y: F.greatest(x, y))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + F.greatest(g, F.lit(0.0)) * F.greatest(g, F.lit(0.0)))
    pairs = levels[-1].select(*key, F.col("part").alias("a"), F.col("part").alias("b"))
    for lower in reversed(levels[:-1]):
        def side(s, lower=lower):
            more = [F.col("block").alias(f"block_{s}")] if "block" in lower.columns else []
            return lower.select(*key, F.shiftright("part", FAN).alias(s), F.col("part").alias(f"part_{s}"),
                                F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"), *more)
        joined = (pairs.join(side("a"), [*key, "a"]).join(side("b"), [*key, "b"])
                  .where((F.col("part_a") <= F.col("part_b")) & (apart <= epsilon * epsilon + 1e-9)))
        more = [c for c in ("block_a", "block_b") if c in joined.columns]
        pairs = joined.select(*key, F.col("part_a").alias("a"), F.col("part_b").alias("b"), *more)
    return pairs.select(F.struct(*key, F.shiftright("a", TILE).alias("a"), F.shiftright("b", TILE).alias("b")).alias("tile"),
                        F.col("block_a").alias("a"), F.col("block_b").alias("b"))


def _component_edges(near: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Edges that connect what the link matrix connects: each linked vector with
    the smallest id of its component here."""
    ra, rb = a.copy(), b.copy()
    far = np.iinfo(np.int64).max
    while True:
        na = np.minimum(ra, np.where(near, rb[None, :], far).min(axis=1, initial=far))
        nb = np.minimum(rb, np.where(near, na[:, None], far).min(axis=0, initial=far))
        if np.array_equal(na, ra) and np.array_equal(nb, rb):
            return ra, rb
        ra, rb = na, nb


def link_blocks(blocks: DataFrame, pairs: DataFrame, min_cosine: float) -> DataFrame:
    """``id, links, root`` for the vectors with links in a pair of blocks: the
    number of vectors linked (copies counted), and a vector of their component."""
    pairs, _ = write_table(pairs)
    sides = pairs.select(F.col("tile").alias("of"), F.explode(F.array("a", "b")).alias("block")).distinct()
    data = sides.join(blocks.select("block", "dim", "ids", "copies", "vectors"), "block")
    names = ["id", "links", "root"]

    def compare(tile: pa.Table, held: pa.Table) -> pa.Table:
        block, dim = held["block"].to_pylist(), held["dim"].to_pylist()
        row = {b: i for i, b in enumerate(block)}

        def side(of):
            i = row[of]
            raw = [np.frombuffer(held[c][i].as_buffer(), t) for c, t in
                   (("ids", "<i8"), ("copies", "<i8"), ("vectors", np.float64))]
            return raw[0], raw[1], _unit(raw[2], dim[i])

        out, last = [], None
        for x, y in sorted(zip(tile["a"].to_pylist(), tile["b"].to_pylist())):
            if x != last:
                a, ca, xa = side(x)
                last = x
            b, cb, xb = (a, ca, xa) if x == y else side(y)
            near = xa @ xb.T >= min_cosine
            if x == y:
                np.fill_diagonal(near, False)
            ra, rb = _component_edges(near, a, b)
            for i, n, r in [(a, near @ cb, ra)] + [(b, ca @ near, rb)] * (x != y):
                out.append((i[n > 0], n[n > 0], r[n > 0]))
        found = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(names, found)))

    return (pairs.groupBy("tile").cogroup(data.groupBy("of"))
            .applyInArrow(compare, "id long, links long, root long"))


def similar_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label",
                    hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``."""
    epsilon = math.sqrt(max(2 - 2 * min_cosine, 0)) or 1e-6
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("vector"))
    # Values are kept in double precision; -0.0 and 0.0 are one value.
    typed = rows.withColumn("vector", F.transform(F.col("vector").cast("array<double>"), lambda v: v + F.lit(0.0)))
    usable = typed.where(_usable("label", "vector") & F.col("vec_id").isNotNull())
    classes, _ = write_table(usable.groupBy("label", "vector")
                             .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
                             .select("id", "copies", "label", "vector"))
    blocks = grid_blocks(classes, principal_axes(classes), epsilon)
    found, _ = write_table(link_blocks(blocks, block_pairs(blocks, epsilon), min_cosine))
    edges = found.where(F.col("id") != F.col("root")).select(F.col("id").alias("a"), F.col("root").alias("b"))
    parts = connected_components(edges, "a", "b", keys=(), vertex="id", component="component")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named, _ = write_table(classes.join(links, "id", "left").join(parts, "id", "left")
                           .select("label", "vector", "copies",
                                   (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                   F.coalesce("component", "id").alias("component")))
    n_hot = named.where(F.col("copies") > hot_rows).limit(1).count()
    hot = hot_keys(named, ["label", "vector"], "copies", hot_rows) if n_hot else None
    joined = salted_join(typed.withColumn("_ok", _usable("label", "vector") & F.col("vec_id").isNotNull()),
                         named.drop("copies"), ["label", "vector"], hot, ["vec_id"], "left")
    linked = F.col("_ok") & F.col("component").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
