"""Cutting lineage with tables in the shared checkpoint folder; size-checked broadcasts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trafficgraph.session import checkpoint_dir

# Largest static side that is shipped whole to every executor, and what a row
# takes besides its values.
DEFAULT_BROADCAST_MAX_BYTES = 64 << 20
ROW_BYTES = 32


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a parquet table in the shared checkpoint folder; read it back.

    Iterative operators call this once per round so that lineage stays short
    and a lost executor costs one re-read, not a replay of every round. One
    job runs the plan and writes the table; later reads are columnar scans
    that prune columns and push filters down. Returns the frame and its path.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _on_scope_exit(lambda: drop_table(spark, path))
    return spark.read.parquet(path), path


_local = threading.local()   # per thread: each streaming query runs its batches on its own


def _on_scope_exit(cleanup: Callable[[], None]) -> None:
    scopes = getattr(_local, "scopes", None)
    if scopes:
        scopes[-1].append(cleanup)


@contextmanager
def table_scope() -> Iterator[None]:
    """Delete every table written, and release every cache made, inside the block.

    For work whose results are consumed inside the block, e.g. one
    ``foreachBatch`` call that labels a micro-batch and hands the labels to
    its sink: the intermediate tables and caches of that batch do not pile
    up over a long-running stream.
    """
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    cleanups: list[Callable[[], None]] = []
    _local.scopes.append(cleanups)
    try:
        yield
    finally:
        _local.scopes.pop()
        for cleanup in cleanups:
            cleanup()


def materialize(df: DataFrame) -> DataFrame:
    """``write_table`` for tables that live as long as the frames built on them."""
    return write_table(df)[0]


def drop_table(spark, path: str) -> None:
    """Delete a table of ``write_table`` once no frame reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cached(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Cache ``df`` for a few reads; returns it and a ``release`` function.

    For short lineages over a written table (a lost block is recomputed from
    the table), e.g. the per-round vertex summary of the components loop.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)

    def release() -> None:
        kept.unpersist(blocking=False)

    _on_scope_exit(release)
    return kept, release


def path_exists(spark, path: str) -> bool:
    """Whether a folder or file is there; other errors are raised."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


@dataclass(frozen=True)
class Size:
    """Rows of a table and the bytes that one row takes at most, by column."""
    rows: int
    widths: dict[str, int]

    def bytes_of(self, columns: list[str]) -> int:
        return self.rows * (ROW_BYTES + sum(self.widths[c] for c in columns))


def materialize_sized(df: DataFrame) -> tuple[DataFrame, Size]:
    """``materialize`` that also measures row count and largest widths, in the writing job.

    A task that runs twice may count its rows twice: the size is an upper bound, which
    is what a broadcast is checked against.
    """
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("_rows"),
                                   *[F.max(F.octet_length(c)).alias(c) for c in text]))
    got = seen.get
    widths = {f.name: 8 + (int(got.get(f.name) or 0) if f.name in text else 0) for f in df.schema.fields}
    return table, Size(int(got.get("_rows") or 0), widths)


def measured(table: DataFrame) -> Size:
    """The size of a written table, by one scan (also where no observation arrives)."""
    text = [f.name for f in table.schema.fields if f.dataType.typeName() == "string"]
    got = table.agg(F.count(F.lit(1)).alias("_rows"), *[F.max(F.octet_length(c)).alias(c) for c in text]).first()
    return Size(int(got["_rows"]), {f.name: 8 + (int(got[f.name] or 0) if f.name in text else 0)
                                    for f in table.schema.fields})


def broadcast_within(df: DataFrame, size: Size, max_bytes: int | None) -> DataFrame:
    """Hint a broadcast only if all rows of ``df``'s columns fit ``max_bytes``.

    ``size`` was measured on the table that ``df`` selects from. Beyond the
    bound the frame is returned as is: the join then shuffles both sides on the
    key, and adaptive execution may still split skewed keys.
    """
    if max_bytes and size.bytes_of(df.columns) <= max_bytes:
        return F.broadcast(df)
    return df
