"""Equi-joins whose hot keys are split over several tasks (salting).

A key with more than ``hot_rows`` rows on the large side is *hot*. Each of
its rows gets a deterministic salt in ``[0, n)``, ``n = ceil(rows /
hot_rows)``, and the key's row on the other side is repeated ``n`` times, so
no task joins more than about ``hot_rows`` rows of one key. The hot-key table
has at most ``total_rows / hot_rows`` entries, and ``hot_threshold`` raises the
threshold with the rows so that it stays below ``MAX_HOT_KEYS``: a bounded
broadcast. Adaptive skew-join handling does not apply here: the small sides
are aggregates of their own shuffle, a plan shape it does not split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task may join; above it the key is split.
DEFAULT_HOT_ROWS = 1_000_000
# Most keys that may be hot at once: the list of them is broadcast.
MAX_HOT_KEYS = 20_000


def hot_threshold(total_rows: int, hot_rows: int = DEFAULT_HOT_ROWS) -> int:
    """Rows that make a key hot: ``hot_rows``, or more where the join is so large
    that more than ``MAX_HOT_KEYS`` keys could reach it (a key's split then
    grows with the whole join's rows, as its tasks do)."""
    return max(int(hot_rows), total_rows // MAX_HOT_KEYS)


def hot_keys(counts: DataFrame, keys: Sequence[str], rows: str | Column,
             hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """``(*keys, _splits)`` for keys whose row count exceeds ``hot_rows``."""
    n = F.col(rows) if isinstance(rows, str) else rows
    return (counts.where(n > F.lit(int(hot_rows)))
            .select(*keys, F.ceil(n / F.lit(int(hot_rows))).cast("int").alias("_splits")))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], hot: DataFrame | None,
                salt_by: Sequence[str], how: str = "inner") -> DataFrame:
    """``big.join(small, on, how)`` with the ``hot`` keys split.

    ``small`` has at most one row per key; ``salt_by`` are columns of ``big``
    that vary within a hot key (the salt is their hash, so a recomputed task
    salts the same way). ``how`` is ``inner``, ``left``, ``left_semi`` or
    ``left_anti``; with ``hot=None`` this is the plain join.
    """
    on = list(on)
    if hot is None:
        return big.join(small, on, how)
    h = F.broadcast(hot.select(*on, "_splits"))
    salted_big = (big.join(h, on, "left")
                  .withColumn("_salt", F.when(F.col("_splits").isNull(), F.lit(0))
                              .otherwise(F.pmod(F.xxhash64(*salt_by), F.col("_splits")))
                              .cast("int"))
                  .drop("_splits"))
    repeated_small = (small.join(h, on, "left")
                      .withColumn("_salt", F.explode(
                          F.when(F.col("_splits").isNull(), F.array(F.lit(0)))
                          .otherwise(F.sequence(F.lit(0), F.col("_splits") - F.lit(1)))))
                      .drop("_splits"))
    return salted_big.join(repeated_small, [*on, "_salt"], how).drop("_salt")
