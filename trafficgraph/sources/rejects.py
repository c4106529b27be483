"""Measurement lines that cannot be used: kept with a reason and counted, not lost.

``read_measurements_csv`` follows the CSV reader's default: a malformed field turns null
and the row goes unseen in ``valid_measurements``. Here the reader keeps the raw
line of such rows, every row is tagged with the reason that rules it out (null: none),
and the rows part into measurements and rejects. Counts are observed in the job that
reads the rows: valid and rejected rows together are all lines. Works for batches
and streams; a stream's counts are in its progress, under ``OBSERVED``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from trafficgraph.operators.materialize import materialize
from trafficgraph.schemas import MEASUREMENT_SCHEMA

LINE = "_line"
REASON = "_reason"
OBSERVED = "measurement_lines"
MALFORMED, NO_TIME, NO_DETECTOR = "malformed line", "no event time", "no detector"
REASONS = (MALFORMED, NO_TIME, NO_DETECTOR)
_SCHEMA = T.StructType([*MEASUREMENT_SCHEMA.fields, T.StructField(LINE, T.StringType())])


def _reader(reader):
    return (reader.schema(_SCHEMA).option("sep", ",").option("header", False)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE)
            .option("columnPruning", False))


def tagged_measurements_csv(spark: SparkSession, path: str) -> DataFrame:
    """Measurement CSV files with their raw line (malformed rows only) and reason."""
    return tagged(_reader(spark.read).csv(path))


def stream_tagged_measurements_csv(spark: SparkSession, path: str,
                                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = _reader(spark.readStream)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return tagged(reader.csv(path))


def tagged(rows: DataFrame) -> DataFrame:
    """``rows`` with the reason that rules each out, null for measurements."""
    # The reader looks only at fields that are asked for, and a line is to be judged alike
    # whatever a query reads: a test that no row passes, on all fields, asks for all.
    every = F.bit_count(F.xxhash64(*MEASUREMENT_SCHEMA.names)) > 64
    reason = (F.when(F.col(LINE).isNotNull() | every, MALFORMED).when(F.col("eventTime").isNull(), NO_TIME)
              .when(F.col("detectorId").isNull(), NO_DETECTOR))
    return rows.withColumn(REASON, reason)


def line_counts() -> list[Column]:
    """Counts to observe: ``lines``, ``valid`` and one per reason (blanks as ``_``)."""
    by = [F.count(F.when(F.col(REASON) == r, 1)).alias(r.replace(" ", "_")) for r in REASONS]
    return [F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col(REASON).isNull(), 1)).alias("valid"), *by]


def accepted(rows: DataFrame) -> DataFrame:
    """The measurements among tagged rows, in the measurement schema."""
    return rows.where(F.col(REASON).isNull()).select(*MEASUREMENT_SCHEMA.names)


def rejected(rows: DataFrame) -> DataFrame:
    """``(reason, line, eventTime, detectorId)``: the rows ruled out, malformed ones with their raw line."""
    return (rows.where(F.col(REASON).isNotNull())
            .select(F.col(REASON).alias("reason"), F.col(LINE).alias("line"), "eventTime", "detectorId"))


def split_measurements(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """``(measurements, rejects, counts)`` of a batch; the files are parsed once, by the
    job that also counts."""
    seen = Observation()
    table = materialize(rows.observe(seen, *line_counts()))
    return accepted(table), rejected(table), {k: int(v) for k, v in seen.get.items()}


def observed(rows: DataFrame) -> DataFrame:
    """A stream of tagged rows whose counts appear in its query's progress."""
    return rows.observe(OBSERVED, *line_counts())


def rejects_writer(rows: DataFrame, path: str, checkpoint_location: str) -> DataStreamWriter:
    """Append the rejects of a stream of tagged rows to parquet files, by reason."""
    return (rejected(observed(rows)).writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint_location).partitionBy("reason"))
