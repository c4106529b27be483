"""Interim and final labels at any graph size (per-edge state, distributed relabel).

No event time is gathered in one task or group:

1. The stream is aggregated per ``(eventTime, src, dst)`` in **update** mode
   (partial aggregation map-side, state spread over all state partitions).
   Each trigger therefore yields only the edges it changed, pre-aggregated.
2. ``foreachBatch`` writes those rows to an edge store below the query's
   checkpoint folder, one folder per batch id. A batch replayed after a
   failure overwrites its own folder, so the store is written exactly once.
3. The event times touched by the batch, plus those that became final, are
   relabelled from the store with the distributed batch operators (connected
   components, DenGraph); all other event times are left alone.

Event time ``T`` is final in batch ``N`` when ``T + grace < M - delay``, where
``M`` is the largest event time of batches ``0 .. N-1``, calm ones included
(marker rows carry them). Spark's
late-row filter then already rejects ``T`` (it lags by one batch, and
``T < M - delay``), so no row of ``T`` can arrive after its final. The
running maximum is kept as one row per batch next to the store.

Each batch reads only the folders of batches that still hold open event
times, and folders that no later batch (nor a replay) can read are deleted,
so the store stays as large as the open time window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from trafficgraph.constants import (CONGESTION_CLASS_THRESHOLD, CONGESTION_THRESHOLDS,
                                    DENGRAPH_EPSILON, DENGRAPH_ETA, DENGRAPH_WEIGHT_FIELD,
                                    FINAL_GRACE, WATERMARK_DELAY)
from trafficgraph.functions.output import with_key
from trafficgraph.operators.components import connected_components
from trafficgraph.operators.density import clusters_from_distances
from trafficgraph.operators.graph import RoadGraph
from trafficgraph.operators.materialize import drop_table, path_exists, table_scope
from trafficgraph.streaming.finals import marked_congested_edges, marked_edge_distances
from trafficgraph.streaming.jobs import interval_ms

# Largest list of event times that one batch touched to be broadcast (16 MB at most).
MAX_TOUCHED_TIMES = 500_000

BatchSink = Callable[[DataFrame, int], None]
# labels(edges of the relabelled event times, final column) -> output rows
Labeller = Callable[[DataFrame, F.Column], DataFrame]


_OPEN = T.ArrayType(T.StructType([T.StructField("batchId", T.LongType()),
                                   T.StructField("minMicros", T.LongType()),
                                   T.StructField("maxMicros", T.LongType())]))
_PROGRESS = T.StructType([T.StructField("batchId", T.LongType()),
                          T.StructField("maxMicros", T.LongType()),
                          T.StructField("open", _OPEN)])


@dataclass
class Trigger:
    """What one micro-batch brought and which event times it concerns."""
    spark: SparkSession
    batch_id: int
    rows: DataFrame             # the batch's rows, read from its folder
    micros: F.Column            # event time in microseconds
    cut: int | None             # event times below it are final
    cut_before: int | None      # ... and those below this one were before
    folders: list[int]          # batches that hold open event times
    everything: bool            # read all folders instead

    def final(self) -> F.Column:
        return (self.micros < F.lit(self.cut)) if self.cut is not None else F.lit(False)

    def wanted(self, df: DataFrame) -> DataFrame:
        """The rows of event times that the batch touched or that became final with it."""
        touched = self.rows.select("eventTime").distinct().withColumn("_touched", F.lit(True))
        if touched.count() <= MAX_TOUCHED_TIMES:
            touched = F.broadcast(touched)
        wanted = F.col("_touched").isNotNull()
        if self.cut is not None:
            newly_final = self.micros < F.lit(self.cut)
            if self.cut_before is not None:
                newly_final = newly_final & (self.micros >= F.lit(self.cut_before))
            wanted = wanted | newly_final
        return df.join(touched, "eventTime", "left").where(wanted).drop("_touched")


class EdgeStoreRelabel:
    """``foreachBatch`` function: store changed edges, relabel, pass labels on.

    Each batch's progress row holds the running maximum event time and the
    *open* batch folders: those whose newest event time is not below the
    final cutoff. Every event time a later batch can touch or finalise lies
    at or after that cutoff, so only open folders are read; the list stays
    as short as the open time window, however long the stream runs.
    """

    def __init__(self, store: str, columns: Sequence[str], labeller: Labeller, sink: BatchSink,
                 lag_micros: int) -> None:
        self.store = store.rstrip("/")
        self.columns = list(columns)
        self.labeller = labeller
        self.sink = sink
        self.lag_micros = int(lag_micros)        # delay + grace
        self._progress_rows: dict[int, tuple] = {}   # batch id -> (max so far, open folders)

    def _edges(self, batch_id: int | None = None) -> str:
        base = f"{self.store}/edges"
        return base if batch_id is None else f"{base}/batchId={int(batch_id)}"

    def _progress(self, batch_id: int) -> str:
        return f"{self.store}/progress/batchId={int(batch_id)}"

    def _progress_of(self, spark: SparkSession, batch_id: int) -> tuple:
        """``(largest event time µs of batches 0..batch_id, open folders)``."""
        if batch_id < 0:
            return None, []
        if batch_id not in self._progress_rows:
            row = None           # no record: the batch never ran (fresh store)
            if path_exists(spark, self._progress(batch_id)):
                row = spark.read.schema(_PROGRESS).parquet(self._progress(batch_id)).first()
                if row is None:
                    raise RuntimeError(f"empty progress record {self._progress(batch_id)}")
            self._progress_rows[batch_id] = (
                (None, []) if row is None else
                (row["maxMicros"], [(o["batchId"], o["minMicros"], o["maxMicros"])
                                    for o in row["open"] or []]))
        return self._progress_rows[batch_id]

    def _cut(self, running: int | None) -> int | None:
        return None if running is None else running - self.lag_micros

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch_id = int(batch_id)
        # One execution of the micro-batch: everything below reads the files.
        rows = batch.select(*self.columns)
        rows.write.mode("overwrite").parquet(self._edges(batch_id))
        this = spark.read.schema(rows.schema).parquet(self._edges(batch_id))
        micros = F.unix_micros(F.col("eventTime"))
        span = this.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
        before, open_before = self._progress_of(spark, batch_id - 1)
        before2, open_before2 = self._progress_of(spark, batch_id - 2)
        cut, cut_before = self._cut(before), self._cut(before2)

        opened = [o for o in open_before if o[0] != batch_id]
        if span["hi"] is not None:
            opened.append((batch_id, span["lo"], span["hi"]))
        seen = [v for v in (before, span["hi"]) if v is not None]
        running = max(seen) if seen else None
        keep = [o for o in opened if cut is None or o[2] >= cut]
        (spark.createDataFrame([(batch_id, running, keep)], _PROGRESS)
         .coalesce(1).write.mode("overwrite").parquet(self._progress(batch_id)))
        self._progress_rows[batch_id] = (running, keep)

        trigger = Trigger(spark, batch_id, this, micros, cut, cut_before,
                          [b for b, _, hi in opened if cut_before is None or hi >= cut_before],
                          # a row older than the cutoff: read everything
                          cut_before is not None and span["lo"] is not None and span["lo"] < cut_before)
        with table_scope():                # the labels are consumed by the sink
            self.sink(self._labels(trigger), batch_id)
        self._expire(spark, batch_id, open_before, open_before2)

    def _stored(self, trigger: "Trigger", base: str, schema: T.StructType,
                before: bool = False) -> DataFrame:
        """Rows of a table with one folder per batch: the open folders up to the
        trigger's batch (``before``: without it), with their ``batchId``."""
        stored = T.StructType(schema.fields + [T.StructField("batchId", T.LongType())])
        ids = [b for b in trigger.folders if not before or b < trigger.batch_id]
        paths = [base] if trigger.everything else [f"{base}/batchId={b}" for b in ids]
        paths = [p for p in paths if not before or path_exists(trigger.spark, p)]
        if not paths:
            return trigger.spark.createDataFrame([], stored)
        last = trigger.batch_id - 1 if before else trigger.batch_id
        return (trigger.spark.read.schema(stored).option("basePath", base).parquet(*paths)
                .where(F.col("batchId") <= F.lit(last)))

    def _labels(self, trigger: "Trigger") -> DataFrame:
        # One read of the store: event times that became final by their own
        # value, those that this batch touched by a broadcast of their list.
        store = self._stored(trigger, self._edges(), trigger.rows.schema).drop("batchId")
        scope = trigger.wanted(store.where(F.col("src").isNotNull()))
        return self.labeller(scope, trigger.final())

    def _expire(self, spark: SparkSession, batch_id: int, open_before: list,
                open_before2: list) -> None:
        """Delete folders no batch from ``batch_id`` on can read, even on replay.

        A replay of this batch reads only the folders open after batch - 1
        (and its own); so folders open after batch - 2, and that batch's own
        folder (empty, or closed at once), are gone for good unless still
        open. Progress rows older than batch - 2 are not read either.
        """
        still = {b for b, _, _ in open_before} | {batch_id}
        candidates = {b for b, _, _ in open_before2}
        if batch_id - 2 >= 0:
            candidates.add(batch_id - 2)
        for b in sorted(candidates - still):
            self._drop_batch(spark, b)
        if batch_id - 3 >= 0:
            drop_table(spark, self._progress(batch_id - 3))
            self._progress_rows.pop(batch_id - 3, None)

    def _drop_batch(self, spark: SparkSession, batch_id: int) -> None:
        drop_table(spark, self._edges(batch_id))


def _store_path(checkpoint_location: str) -> str:
    return f"{checkpoint_location.rstrip('/')}/relabel-store"


def _lag_micros(spark: SparkSession, watermark_delay: str, grace: str) -> int:
    return 1000 * (interval_ms(spark, watermark_delay) + interval_ms(spark, grace))


def component_labeller(graph: RoadGraph) -> Labeller:
    """Congested edges of some event times to keyed component rows."""
    def labels(edges: DataFrame, final: F.Column) -> DataFrame:
        cc = connected_components(edges, "src", "dst", ["eventTime"])
        out = cc.select(F.col("componentId").cast("int").alias("componentId"), "eventTime",
                        final.alias("final"), F.col("vertexId").cast("int").alias("vertexId"))
        return with_key(graph.decode(out), "id")
    return labels


def cluster_labeller(eps: float = DENGRAPH_EPSILON, eta: int = DENGRAPH_ETA) -> Labeller:
    """Pair distances of some event times, by batch, to keyed cluster rows."""
    def labels(pairs: DataFrame, final: F.Column) -> DataFrame:
        best = pairs.groupBy("eventTime", "src", "dst").agg(F.min("distance").alias("distance"))
        c = clusters_from_distances(best, eps, eta, ["eventTime"])
        out = c.select("clusterId", "eventTime", final.alias("final"), "vertexId", "vertexType")
        return with_key(out, "vertexId")
    return labels


def relabel_congested_components(measurements: DataFrame, graph: RoadGraph, sink: BatchSink,
                                 checkpoint_location: str,
                                 threshold: int = CONGESTION_CLASS_THRESHOLD,
                                 thresholds: Sequence[float] = CONGESTION_THRESHOLDS,
                                 watermark_delay: str = WATERMARK_DELAY,
                                 grace: str = FINAL_GRACE,
                                 bucket: str | None = None) -> DataStreamWriter:
    """Congested components of every open event time, interim and final.

    ``sink(df, batch_id)`` receives ``componentId, eventTime, final, vertexId,
    id, key`` rows: all vertices of each event time touched by the batch
    (``final = false``) or finalised in it (``final = true``). Start the
    returned writer; the edge store lives below ``checkpoint_location``.
    """
    changed = marked_congested_edges(measurements, graph, threshold, thresholds, watermark_delay,
                                     bucket)
    handler = EdgeStoreRelabel(_store_path(checkpoint_location), ["eventTime", "src", "dst"],
                               component_labeller(graph), sink,
                               _lag_micros(measurements.sparkSession, watermark_delay, grace))
    return (changed.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint_location).foreachBatch(handler))


def relabel_dengraph(measurements: DataFrame, graph: RoadGraph, sink: BatchSink,
                     checkpoint_location: str, weight_field: str = DENGRAPH_WEIGHT_FIELD,
                     eps: float = DENGRAPH_EPSILON, eta: int = DENGRAPH_ETA,
                     watermark_delay: str = WATERMARK_DELAY,
                     grace: str = FINAL_GRACE, bucket: str | None = None) -> DataStreamWriter:
    """DenGraph clusters of every open event time, interim and final.

    ``sink`` receives ``clusterId, eventTime, final, vertexId, vertexType, key``.
    The store keeps each pair's running smallest distance per batch; the
    relabel takes the smallest over batches.
    """
    changed = marked_edge_distances(measurements, graph, weight_field, watermark_delay, bucket)
    handler = EdgeStoreRelabel(_store_path(checkpoint_location),
                               ["eventTime", "src", "dst", "distance"],
                               cluster_labeller(eps, eta), sink,
                               _lag_micros(measurements.sparkSession, watermark_delay, grace))
    return (changed.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint_location).foreachBatch(handler))
