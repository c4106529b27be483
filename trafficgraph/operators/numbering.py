"""Consecutive numbering of sorted keys without a single-partition window.

``row_number() over (order by k)`` moves every row into one task. Here the
keys are range-partitioned and sorted inside each partition; each row's
position in its partition comes from ``monotonically_increasing_id`` and is
frozen by a table written to the checkpoint folder. Per-partition counts (one row per partition
and group) give the offsets, added back with a join. Work stays spread over
all partitions, also when one group holds most keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficgraph.operators.materialize import materialize

_ROW_BITS = 33  # monotonically_increasing_id = partition index << 33 | row in partition


def dense_number(df: DataFrame, order_col: str, group_cols: Sequence[str] = (),
                 name: str = "number", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of ``order_col`` within ``group_cols``.

    Rows must be distinct on ``(*group_cols, order_col)`` and keys non-null;
    then the number is the dense rank. Returns all columns of ``df`` plus ``name``
    (bigint).
    """
    groups = list(group_cols)
    keys = groups + [order_col]
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))
    placed = materialize(ranged.sortWithinPartitions(*keys)
                         .withColumn("_pos", F.monotonically_increasing_id()))
    framed = placed.select(
        "*",
        F.shiftright(F.col("_pos"), _ROW_BITS).alias("_pid"),
        F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"))
    counts = framed.groupBy("_pid", *groups).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = (Window.partitionBy(*groups) if groups else Window.partitionBy()) \
        .orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", *groups, "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (framed.join(offsets, ["_pid", *groups])
            .withColumn(name, F.col("_offset") + F.col("_row") - F.col("_first") + F.lit(1))
            .drop("_pos", "_pid", "_row", "_first", "_offset"))
