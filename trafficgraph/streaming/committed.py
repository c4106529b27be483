"""Batches that appear whole or not at all.

``parquet_batch_sink`` overwrites a batch's folder, so a reader can meet one that is being
replaced. Here every attempt of a batch writes a folder of its own; the batch
counts from the moment its commit record, which names that folder, is renamed into
place. Readers go by the commit records: they see all rows of a batch or none, a
batch killed half-way is invisible, and a replayed one appears once (the attempt its
record names). Folders of other attempts are deleted after the commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "_commits"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _commit(spark: SparkSession, base: str, batch_id: int, attempt: str) -> None:
    fs, record = _fs(spark, f"{base}/{COMMITS}/{int(batch_id)}")
    _, torn = _fs(spark, f"{base}/{COMMITS}/.{int(batch_id)}-{attempt}")
    out = fs.create(torn, True)
    try:
        out.write(bytearray(attempt.encode()))
    finally:
        out.close()
    if fs.exists(record):          # a replay: until the rename the batch is not seen
        fs.delete(record, False)
    if not fs.rename(torn, record):
        raise RuntimeError(f"could not commit batch {batch_id} in {base}")


def committed_attempts(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed batch ids and the folder name of the attempt that counts."""
    base = path.rstrip("/")
    out = {}
    for name in _children(spark, f"{base}/{COMMITS}"):
        if name.isdigit():
            fs, p = _fs(spark, f"{base}/{COMMITS}/{name}")
            n = fs.getFileStatus(p).getLen()
            stream = fs.open(p)
            try:
                out[int(name)] = "".join(chr(stream.read()) for _ in range(n))
            finally:
                stream.close()
    return out


def committed_batch_sink(path: str, partition_by: str | None = "state") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: each batch to a folder of its own, then its commit record."""
    base = path.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, attempt = batch.sparkSession, f"attempt={uuid.uuid4().hex}"
        rows = batch
        if partition_by:
            rows = batch.withColumn(partition_by, F.when(F.col("final"), "final").otherwise("interim"))
        writer = rows.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        folder = f"{base}/batchId={int(batch_id)}"
        writer.parquet(f"{folder}/{attempt}")
        _commit(spark, base, batch_id, attempt)
        for other in _children(spark, folder):
            if other != attempt:
                fs, p = _fs(spark, f"{folder}/{other}")
                fs.delete(p, True)
    return write


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the committed batches with their ``batchId``; ``schema`` is that of the rows."""
    base = path.rstrip("/")
    folders = [f"{base}/batchId={b}/{attempt}" for b, attempt in sorted(committed_attempts(spark, base).items())]
    stored = T.StructType([*schema.fields, T.StructField("batchId", T.LongType())])
    if not folders:
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).option("basePath", base).parquet(*folders)
