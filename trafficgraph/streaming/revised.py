"""Finals that can be corrected: late rows are kept, idle event times become final by the clock.

``relabel`` and ``carried`` leave lateness to Spark's watermark: rows below it are dropped
before a batch sees them, and the last event times stay open until later data
comes. Here the stream has no stateful operator. Each micro-batch is aggregated per
``(eventTime, src, dst)`` inside ``foreachBatch`` and written to the edge store, so every
row is seen, and finality is decided from written tables, one folder per batch:

- ``edges``   the batch's edges (or smallest distances), calm marker rows included;
- ``times``   its distinct event times, one row each;
- ``idle``    event times that became final by the clock with that batch;
- ``late``    measurement rows of event times that were final before, as they arrived
  (never deleted here);
- ``progress`` running largest event time, the batch's clock, folders still needed.

An event time is final **by the watermark** as in ``relabel``: ``T + grace < M - delay``,
with ``M`` the largest event time of the batches before. It is final **by the clock** once no
row of it came for ``idle`` of processing time. The clock is that of the driver at the start of
the batch, never running back, and is read again from ``progress`` when a batch is replayed, so a
replay decides alike. Batches must come without data, too: ``with_heartbeat``.

Rows of a final event time are late. They go to ``late`` and into the edge store, and
the event time is labelled again from all its edges: a *correction*, ``final`` with
``revision`` = the number of its batch. Interim rows and first finals have revision 0. So the
rows of an event time's largest revision are those of a batch job over all rows
(``latest_finals``). Edges are kept for ``keep`` of event time below the watermark's cut
(None: for ever); rows later than that stay in ``late`` with ``reason`` ``beyond_keep`` and
bring no correction.

Everything is joined on ``eventTime`` between distributed tables; what reaches the driver is one
number a folder, and the list of event times is broadcast below a checked size only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from trafficgraph.constants import (CONGESTION_CLASS_THRESHOLD, CONGESTION_THRESHOLDS,
                                    DENGRAPH_EPSILON, DENGRAPH_ETA, DENGRAPH_WEIGHT_FIELD,
                                    FINAL_GRACE, WATERMARK_DELAY)
from trafficgraph.functions.output import with_key
from trafficgraph.operators.graph import RoadGraph
from trafficgraph.operators.materialize import drop_table, materialize, path_exists, table_scope
from trafficgraph.sources.measurements import bucketed, valid_measurements
from trafficgraph.streaming.finals import marked_congested_edges, marked_edge_distances
from trafficgraph.streaming.jobs import interval_ms
from trafficgraph.streaming.relabel import (MAX_TOUCHED_TIMES, BatchSink, Labeller, _lag_micros,
                                            cluster_labeller, component_labeller)

AFTER_FINAL, BEYOND_KEEP = "after_final", "beyond_keep"

_FOLDERS = T.ArrayType(T.StructType([T.StructField("batchId", T.LongType()),
                                     T.StructField("maxMicros", T.LongType()),
                                     T.StructField("clock", T.LongType())]))
_PROGRESS = T.StructType([T.StructField("batchId", T.LongType()),
                          T.StructField("maxMicros", T.LongType()),
                          T.StructField("clock", T.LongType()),
                          T.StructField("folders", _FOLDERS)])
_TIMES = T.StructType([T.StructField("eventTime", T.TimestampType())])


def driver_clock() -> int:
    return time.time_ns() // 1000


def with_heartbeat(measurements: DataFrame) -> DataFrame:
    """The stream plus one row a second that holds nulls only, so that batches come in calm times.

    The handlers drop such rows as they drop all rows without an event time. Give the query
    a processing-time trigger, or each second becomes a batch.
    """
    beat = (measurements.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
            .select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in measurements.schema.fields]))
    return measurements.unionByName(beat)


class RevisedFinals:
    """``foreachBatch`` function over measurements: interim rows, finals and corrections.

    The sink is called only for batches that concern some event time.
    """

    def __init__(self, store: str, edges_of: Callable[[DataFrame], DataFrame], labeller: Labeller,
                 vertex: str, sink: BatchSink, lag_micros: int, idle_micros: int | None = None,
                 keep_micros: int | None = None, bucket: str | None = None,
                 clock: Callable[[], int] = driver_clock) -> None:
        self.store = store.rstrip("/")
        self.edges_of, self.labeller, self.vertex, self.sink = edges_of, labeller, vertex, sink
        self.lag_micros, self.idle_micros, self.keep_micros = int(lag_micros), idle_micros, keep_micros
        self.bucket, self.clock = bucket, clock

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.store}/{table}/batchId={int(batch_id)}"

    def _progress_of(self, spark: SparkSession, batch_id: int):
        path = self._path("progress", batch_id)
        return spark.read.schema(_PROGRESS).parquet(path).first() if (
            batch_id >= 0 and path_exists(spark, path)) else None

    def _stored(self, spark: SparkSession, table: str, schema: T.StructType, ids: Sequence[int]) -> DataFrame:
        stored = T.StructType([*schema.fields, T.StructField("batchId", T.LongType())])
        paths = [p for p in (self._path(table, b) for b in ids) if path_exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], stored)
        return spark.read.schema(stored).option("basePath", f"{self.store}/{table}").parquet(*paths)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, batch_id = batch.sparkSession, int(batch_id)
        with table_scope():
            self._run(spark, batch, batch_id)

    def _run(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        before, before2 = (self._progress_of(spark, batch_id - n) for n in (1, 2))
        if before is None and batch_id > 0:
            raise RuntimeError(f"no progress record {self._path('progress', batch_id - 1)}")
        replayed = self._progress_of(spark, batch_id)
        now = replayed["clock"] if replayed else max(self.clock(), before["clock"] if before else 0)
        folders = [tuple(f) for f in before["folders"]] if before else []
        ids = [b for b, _, _ in folders]
        cut, cut_before = self._cut(before), self._cut(before2)

        # One execution of the micro-batch; all else reads what it wrote.
        edges = self.edges_of(batch)
        edges.write.mode("overwrite").parquet(self._path("edges", batch_id))
        this = spark.read.schema(edges.schema).parquet(self._path("edges", batch_id))
        this.select("eventTime").distinct().write.mode("overwrite").parquet(self._path("times", batch_id))

        decided = self._decide(spark, batch_id, ids, folders, now, cut, cut_before)
        micros, news = F.unix_micros("eventTime"), F.col("_rows") | F.col("_by_clock")
        n = decided.agg(F.max(F.when(F.col("_rows"), micros)).alias("seen"),
                        F.max(F.when(news, micros)).alias("top"),
                        *[F.count_if(c).alias(c) for c in ("_by_clock", "_late", "_emit")]).first()
        self._put(spark, "idle", batch_id, n["_by_clock"], decided.where("_by_clock").select("eventTime"))
        late = self._small(decided.where("_late").select("eventTime", "_reason"), n["_late"])
        self._put(spark, "late", batch_id, n["_late"], self._late_rows(batch, late))

        # A folder counts while the newest event time that it names may be asked for.
        if n["top"] is not None:
            folders = folders + [(batch_id, n["top"], now)]
        seen = [v for v in (before["maxMicros"] if before else None, n["seen"]) if v is not None]
        oldest = None if cut is None or self.keep_micros is None else cut - self.keep_micros
        kept = [f for f in folders if oldest is None or f[1] >= oldest]
        (spark.createDataFrame([(batch_id, max(seen) if seen else None, now, kept)], _PROGRESS)
         .coalesce(1).write.mode("overwrite").parquet(self._path("progress", batch_id)))

        if n["_emit"]:           # else the batch changes no label and closes no event time
            emit = self._small(decided.where("_emit").select("eventTime", "final", "revision"), n["_emit"])
            holding = (self._stored(spark, "times", _TIMES, [f[0] for f in folders])
                       .join(emit, "eventTime", "left_semi").select("batchId").distinct())
            stored = self._stored(spark, "edges", this.schema, [r["batchId"] for r in holding.collect()])
            scope = (stored.drop("batchId").where(F.col("src").isNotNull())
                     .join(emit, "eventTime", "left_semi"))
            out = self.labeller(scope, F.lit(True)).drop("final", "key").join(emit, "eventTime")
            self.sink(with_key(out, self.vertex), batch_id)
        self._expire(spark, batch_id, ids, [f["batchId"] for f in before2["folders"]] if before2 else [])

    def _put(self, spark: SparkSession, table: str, batch_id: int, rows: int, df: DataFrame) -> None:
        """Write a batch's folder, or delete what an attempt that failed may have left."""
        if rows:
            df.write.mode("overwrite").parquet(self._path(table, batch_id))
        else:
            drop_table(spark, self._path(table, batch_id))

    def _late_rows(self, batch: DataFrame, late: DataFrame) -> DataFrame:
        """The batch's rows of late event times as they arrived, with the reason."""
        rows = bucketed(valid_measurements(batch).withColumn("_arrived", F.col("eventTime")), self.bucket)
        return (rows.withColumn("eventTime", F.col("eventTime").cast("timestamp"))
                .join(late, "eventTime").withColumn("eventTime", F.col("_arrived")).drop("_arrived")
                .withColumnRenamed("_reason", "reason"))

    def _decide(self, spark, batch_id, ids, folders, now, cut, cut_before) -> DataFrame:
        """One row for each event time that this batch touches or that becomes final with it.

        ``final``, ``revision``, ``_late`` (final before, and rows came), ``_reason``,
        ``_emit`` (to be labelled), ``_by_clock`` (became final by the clock).
        """
        past = (self._stored(spark, "times", _TIMES, ids).groupBy("eventTime").agg(F.max("batchId").alias("_last")))
        touched = self._stored(spark, "times", _TIMES, [batch_id]).select("eventTime", F.lit(True).alias("_touched"))
        closed = (self._stored(spark, "idle", _TIMES, ids).select("eventTime").distinct()
                  .withColumn("_closed", F.lit(True)))
        micros, no = F.unix_micros("eventTime"), F.lit(False)
        was = F.coalesce("_closed", no) | (micros < F.lit(cut_before) if cut_before is not None else no)
        rows = F.coalesce("_touched", no)
        by_cut = micros < F.lit(cut) if cut is not None else no
        # The newest batch whose clock is old enough: event times last seen by then are idle.
        quiet = [b for b, _, at in folders if self.idle_micros is not None and at <= now - self.idle_micros]
        idle = (F.coalesce(F.col("_last") <= F.lit(max(quiet)), no) & ~rows) if quiet else no
        gone = (micros < F.lit(cut_before - self.keep_micros)
                if cut_before is not None and self.keep_micros is not None else no)
        facts = (past.join(touched, "eventTime", "full").join(closed, "eventTime", "left")
                 .select("eventTime", was.alias("_was"), rows.alias("_rows"), by_cut.alias("_cut"),
                         idle.alias("_idle"), gone.alias("_gone")))
        late = F.col("_was") & F.col("_rows")
        return materialize(
            facts.where(F.col("_rows") | (~F.col("_was") & (F.col("_cut") | F.col("_idle"))))
            .select("eventTime", (F.col("_was") | F.col("_cut") | F.col("_idle")).alias("final"),
                    F.when(late, F.lit(batch_id)).otherwise(F.lit(0)).cast("long").alias("revision"),
                    "_rows", late.alias("_late"), (~(late & F.col("_gone"))).alias("_emit"),
                    F.when(F.col("_gone"), F.lit(BEYOND_KEEP)).otherwise(F.lit(AFTER_FINAL)).alias("_reason"),
                    (F.col("_idle") & ~F.col("_was") & ~F.col("_cut")).alias("_by_clock")))

    def _cut(self, progress) -> int | None:
        return None if progress is None or progress["maxMicros"] is None else progress["maxMicros"] - self.lag_micros

    @staticmethod
    def _small(times: DataFrame, rows: int) -> DataFrame:
        """A list of event times, broadcast while it is short."""
        return F.broadcast(times) if rows <= MAX_TOUCHED_TIMES else times

    def _expire(self, spark: SparkSession, batch_id: int, ids: list[int], ids_before: list[int]) -> None:
        """Delete folders that neither a later batch nor a replay of this one reads (those
        of batches without rows among them)."""
        for b in sorted((set(ids_before) | {batch_id - 2}) - set(ids) - {batch_id}):
            for table in ("edges", "times", "idle"):
                drop_table(spark, self._path(table, b))
        if batch_id >= 3:
            drop_table(spark, self._path("progress", batch_id - 3))


def _store(checkpoint_location: str) -> str:
    return f"{checkpoint_location.rstrip('/')}/revised-store"


def _micros(spark: SparkSession, interval: str | None) -> int | None:
    return None if interval is None else 1000 * interval_ms(spark, interval)


def _writer(measurements: DataFrame, checkpoint_location: str, handler: RevisedFinals) -> DataStreamWriter:
    return (measurements.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint_location).foreachBatch(handler))


def revised_congested_components(measurements: DataFrame, graph: RoadGraph, sink: BatchSink,
                                 checkpoint_location: str, threshold: int = CONGESTION_CLASS_THRESHOLD,
                                 thresholds: Sequence[float] = CONGESTION_THRESHOLDS,
                                 watermark_delay: str = WATERMARK_DELAY, grace: str = FINAL_GRACE,
                                 idle: str | None = None, keep: str | None = "1 day",
                                 bucket: str | None = None,
                                 clock: Callable[[], int] = driver_clock) -> DataStreamWriter:
    """Congested components, interim, final and corrected (``revision`` beside ``final``).

    ``idle``: processing time without rows after which an event time becomes final (None: by
    the watermark only); ``keep``: event time below the cut for which edges stay for
    corrections (None: for ever).
    """
    spark = measurements.sparkSession
    handler = RevisedFinals(
        _store(checkpoint_location),
        lambda batch: marked_congested_edges(batch, graph, threshold, thresholds, watermark_delay,
                                             bucket).select("eventTime", "src", "dst"),
        component_labeller(graph), "id", sink, _lag_micros(spark, watermark_delay, grace),
        _micros(spark, idle), _micros(spark, keep), bucket, clock)
    return _writer(measurements, checkpoint_location, handler)


def revised_dengraph(measurements: DataFrame, graph: RoadGraph, sink: BatchSink, checkpoint_location: str,
                     weight_field: str = DENGRAPH_WEIGHT_FIELD, eps: float = DENGRAPH_EPSILON,
                     eta: int = DENGRAPH_ETA, watermark_delay: str = WATERMARK_DELAY,
                     grace: str = FINAL_GRACE, idle: str | None = None, keep: str | None = "1 day",
                     bucket: str | None = None, clock: Callable[[], int] = driver_clock) -> DataStreamWriter:
    """DenGraph clusters, interim, final and corrected; parameters as above."""
    spark = measurements.sparkSession
    handler = RevisedFinals(
        _store(checkpoint_location),
        lambda batch: marked_edge_distances(batch, graph, weight_field, watermark_delay, bucket),
        cluster_labeller(eps, eta), "vertexId", sink, _lag_micros(spark, watermark_delay, grace),
        _micros(spark, idle), _micros(spark, keep), bucket, clock)
    return _writer(measurements, checkpoint_location, handler)


def latest_finals(labels: DataFrame) -> DataFrame:
    """Of each event time's final rows those of its newest revision (others were corrected)."""
    done = labels.where("final")
    newest = done.groupBy("eventTime").agg(F.max("revision").alias("revision"))
    return done.join(newest, ["eventTime", "revision"], "left_semi")


def read_late(spark: SparkSession, checkpoint_location: str, schema: T.StructType) -> DataFrame:
    """Late measurement rows with ``reason`` and ``batchId``; ``schema`` is that of the measurements."""
    base = f"{_store(checkpoint_location)}/late"
    stored = T.StructType([*schema.fields, T.StructField("reason", T.StringType()),
                           T.StructField("batchId", T.LongType())])
    return spark.read.schema(stored).parquet(base) if path_exists(spark, base) else spark.createDataFrame([], stored)
