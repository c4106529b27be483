"""Connected components inside runs of neighbouring edges, before any round.

Edges are range-partitioned by ``(*keys, lo, hi)`` and sorted, and every task labels
its edges in runs: consecutive rows of one graph, at most ``RUN_ROWS`` at a time. Where
linked vertices have close ids (a road graph numbered along its roads), most
components, or long pieces of them, lie inside one run, and only vertices met in
several runs are left for the rounds. That holds for any graph: ids that say nothing
about closeness leave more vertices to the rounds and cost one exchange more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import (ByteType, DataType, DateType, IntegerType, LongType, ShortType, StringType,
                               StructField, StructType, TimestampNTZType, TimestampType)

# Edges that a task holds and labels at once.
RUN_ROWS = 1_000_000


def sorts_alike(kind: DataType) -> bool:
    """Types that Arrow orders as Spark does; a NaN or a collation may be ordered otherwise."""
    return (isinstance(kind, (ByteType, ShortType, IntegerType, LongType, DateType, TimestampType,
                              TimestampNTZType))
            or (isinstance(kind, StringType) and kind == StringType()))


def _labeller(keys: Sequence[str], run_rows: int):
    # Defined here, with its imports inside, so that it travels to the workers by value.
    def label(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        def labelled(held: list, first_run: int):
            table = pa.Table.from_batches(held)
            column = {c: pa.concat_arrays(table.column(c).chunks) for c in (*keys, "_lo", "_hi")}
            n = table.num_rows
            starts = np.zeros(n, dtype=bool)        # rows whose graph is not that of the row before
            for c in keys:
                here, before = column[c].slice(1), column[c].slice(0, n - 1)
                differ = pc.or_(pc.fill_null(pc.not_equal(here, before), False),
                                pc.not_equal(pc.is_null(here), pc.is_null(before)))
                starts[1:] |= differ.to_numpy(zero_copy_only=False)
            run = np.cumsum(starts)
            ends = pa.concat_arrays([column["_lo"], column["_hi"]]).dictionary_encode()
            order = pc.sort_indices(ends.dictionary).to_numpy().astype(np.int64)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            codes = np.tile(run, 2) * len(order) + rank[ends.indices.to_numpy()]
            nodes, at = np.unique(codes, return_inverse=True)
            lo, hi = at[:n], at[n:]
            # Every root with a smaller neighbour hangs itself on one; paths are cut to roots.
            root, a, b = np.arange(len(nodes)), lo, hi
            while True:
                a, b = root[a], root[b]
                apart = a != b
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                root[np.maximum(a, b)] = np.minimum(a, b)
                while True:
                    up = root[root]
                    if np.array_equal(up, root):
                        break
                    root = up
            near = ends.dictionary.take(pa.array(order[nodes[root[lo]] % len(order)]))
            out = table.append_column("_near", near).append_column("_run", pa.array(first_run + run, pa.int64()))
            return out, int(run[-1]) + 1

        held, rows, runs = [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= run_rows:
                out, n = labelled(held, runs)
                yield from out.combine_chunks().to_batches(max_chunksize=100_000)
                held, rows, runs = [], 0, runs + n
        if held:
            out, _ = labelled(held, runs)
            yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    return label


def labelled_in_runs(oriented: DataFrame, keys: Sequence[str], run_rows: int | None = None) -> DataFrame:
    """``(*keys, _hi, _lo, _near, _run)``: each edge with the smallest vertex that the edges
    of its run connect it to, and the run's number. Self-loops are edges too.

    Runs are numbered by task: write the frame before reading it twice.
    """
    k = list(keys)
    rows = oriented.select(*k, "_hi", "_lo")
    placed = rows.repartitionByRange(*k, "_lo", "_hi").sortWithinPartitions(*k, "_lo", "_hi")
    schema = StructType([*rows.schema.fields, StructField("_near", rows.schema["_lo"].dataType),
                         StructField("_run", LongType())])
    return placed.mapInArrow(_labeller(k, int(run_rows or RUN_ROWS)), schema)
