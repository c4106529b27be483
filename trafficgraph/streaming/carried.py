"""Labels carried over triggers: each trigger works on its own edges, not on the event time's.

``relabel`` labels every touched event time anew from all its edges. Here the labels
themselves are the state: a versioned table, one folder per batch id (overwritten
when a batch is replayed), in which the newest row of a vertex counts. A trigger
reads the current rows of the event times it concerns and writes only what it changed.

- **Components** (``CarriedComponents``). The ends of new edges are replaced by their
  vertices' current labels; components of that contracted graph, whose size is that
  of the trigger's news, say which labels merge. A label is the smallest vertex of
  its component, so a label that loses is replaced everywhere by one join.
- **DenGraph** (``CarriedClusters``). A pair's smallest distance only falls, so pairs become
  neighbours but never cease to be. New neighbour rows add to stored
  neighbour counts; vertices that reach ``eta`` become cores. Only the *frontier*
  is looked at: new rows, and stored rows of new cores and of cores whose cluster got a new
  name. Core labels merge as above; a border vertex takes the smallest label
  among those it had and those the frontier brings.

Output rows, finality, expiry and replays are those of ``relabel``: whole event times,
interim or final. Nothing is gathered by event time; all joins are on
``(eventTime, vertex)`` or ``(eventTime, label)`` between written tables, so adaptive
execution splits a label or vertex that holds most rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from trafficgraph.constants import (BORDER, CONGESTION_CLASS_THRESHOLD, CONGESTION_THRESHOLDS, CORE,
                                    DENGRAPH_EPSILON, DENGRAPH_ETA, DENGRAPH_WEIGHT_FIELD,
                                    FINAL_GRACE, NOISE, NOISE_CLUSTER_ID, WATERMARK_DELAY)
from trafficgraph.functions.output import with_key
from trafficgraph.operators.components import connected_components
from trafficgraph.operators.density import neighbour_rows
from trafficgraph.operators.graph import RoadGraph
from trafficgraph.operators.materialize import drop_table, materialize
from trafficgraph.operators.numbering import dense_number
from trafficgraph.streaming.finals import marked_congested_edges, marked_edge_distances
from trafficgraph.streaming.relabel import (BatchSink, EdgeStoreRelabel, Trigger, _lag_micros,
                                            _store_path)


def merged_labels(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(eventTime, _label, _new)``: components of a graph whose vertices are labels."""
    return connected_components(links, a, b, ["eventTime"], vertex="_label", component="_new")


class CarriedLabels(EdgeStoreRelabel):
    """The part both analyses share: a versioned state table beside the batch folders."""

    state: T.StructType

    def __init__(self, store, columns, sink, lag_micros) -> None:
        super().__init__(store, columns, None, sink, lag_micros)

    def _state_path(self, batch_id: int | None = None) -> str:
        base = f"{self.store}/state"
        return base if batch_id is None else f"{base}/batchId={int(batch_id)}"

    def _current(self, trigger: Trigger) -> DataFrame:
        """State before this batch, of the event times it concerns: one row per vertex."""
        rows = trigger.wanted(self._stored(trigger, self._state_path(), self.state, before=True))
        values = [f.name for f in self.state.fields if f.name not in ("eventTime", "vertexId")]
        newest = F.max_by(F.struct(*values), "batchId").alias("_s")
        return materialize(rows.groupBy("eventTime", "vertexId").agg(newest)
                           .select("eventTime", "vertexId", *[F.col(f"_s.{v}").alias(v) for v in values]))

    def _write(self, trigger: Trigger, changed: DataFrame) -> DataFrame:
        path = self._state_path(trigger.batch_id)
        changed.select(*self.state.names).write.mode("overwrite").parquet(path)
        return trigger.spark.read.schema(self.state).parquet(path)

    def _with_changes(self, old: DataFrame, changed: DataFrame) -> DataFrame:
        untouched = old.join(changed.select("eventTime", "vertexId"), ["eventTime", "vertexId"], "left_anti")
        return untouched.select(*self.state.names).unionByName(changed)

    def _drop_batch(self, spark, batch_id: int) -> None:
        super()._drop_batch(spark, batch_id)
        drop_table(spark, self._state_path(batch_id))


class CarriedComponents(CarriedLabels):
    """``foreachBatch`` function: components of every open event time from label to label."""

    state = T.StructType([T.StructField("eventTime", T.TimestampType()),
                          T.StructField("vertexId", T.IntegerType()),
                          T.StructField("label", T.IntegerType())])

    def __init__(self, store: str, graph: RoadGraph, sink: BatchSink, lag_micros: int) -> None:
        super().__init__(store, ["eventTime", "src", "dst"], sink, lag_micros)
        self.graph = graph


    def _labels(self, trigger: Trigger) -> DataFrame:
        key = ["eventTime", "vertexId"]
        old = self._current(trigger)
        new = (trigger.rows.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
               .select("eventTime", "src", "dst").distinct())
        for end in ("src", "dst"):       # a vertex without a label is its own
            named = old.select("eventTime", F.col("vertexId").alias(end), F.col("label").alias("_l"))
            new = (new.join(named, ["eventTime", end], "left")
                   .withColumn(f"_{end}", F.coalesce("_l", end)).drop("_l"))
        links = materialize(new.select("eventTime", F.col("_src"), F.col("_dst")).distinct())
        cc = materialize(merged_labels(links, "_src", "_dst"))
        lost = cc.where(F.col("_label") != F.col("_new")).withColumnRenamed("_label", "label")
        moved = old.join(lost, ["eventTime", "label"]).select(*key, F.col("_new").alias("label"))
        fresh = (cc.select("eventTime", F.col("_label").alias("vertexId"), F.col("_new").alias("label"))
                 .join(old, key, "left_anti"))
        now = self._with_changes(old, self._write(trigger, moved.unionByName(fresh)))
        out = now.select(F.col("label").alias("componentId"), "eventTime",
                         trigger.final().alias("final"), "vertexId")
        return with_key(self.graph.decode(out), "id")


class CarriedClusters(CarriedLabels):
    """``foreachBatch`` function: DenGraph clusters of every open event time, change by change."""

    state = T.StructType([T.StructField("eventTime", T.TimestampType()),
                          T.StructField("vertexId", T.StringType()),
                          T.StructField("n", T.LongType()),            # neighbour rows
                          T.StructField("label", T.StringType())])     # smallest core, null: noise
    pairs = T.StructType([T.StructField("eventTime", T.TimestampType()),
                          T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])

    def __init__(self, store: str, sink: BatchSink, lag_micros: int, eps: float = DENGRAPH_EPSILON,
                 eta: int = DENGRAPH_ETA) -> None:
        super().__init__(store, ["eventTime", "src", "dst", "distance"], sink, lag_micros)
        self.eps, self.eta = float(eps), int(eta)

    def _near_path(self, batch_id: int | None = None) -> str:
        base = f"{self.store}/near"
        return base if batch_id is None else f"{base}/batchId={int(batch_id)}"

    def _drop_batch(self, spark, batch_id: int) -> None:
        super()._drop_batch(spark, batch_id)
        drop_table(spark, self._near_path(batch_id))

    def _is_core(self) -> F.Column:
        return F.col("n") >= F.lit(self.eta)

    def _labels(self, trigger: Trigger) -> DataFrame:
        key = ["eventTime", "vertexId"]
        old = self._current(trigger)
        rows = trigger.rows.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        near = rows.where(F.col("distance") <= F.lit(self.eps)).select("eventTime", "src", "dst").distinct()
        stored = self._stored(trigger, self._near_path(), self.pairs, before=True).drop("batchId")
        # Pairs that were neighbours before bring nothing new.
        path = self._near_path(trigger.batch_id)
        (near.join(stored, ["eventTime", "src", "dst"], "left_anti")
         .write.mode("overwrite").parquet(path))
        fresh = materialize(neighbour_rows(trigger.spark.read.schema(self.pairs).parquet(path)))
        stored_rows = neighbour_rows(stored)

        # Signed changes of the neighbour counts (none is negative: distances only fall).
        ends = (rows.select("eventTime", F.col("src").alias("vertexId"))
                .unionByName(rows.select("eventTime", F.col("dst").alias("vertexId"))))
        delta = (fresh.select(*key, F.lit(1).cast("long").alias("_d"))
                 .unionByName(ends.select(*key, F.lit(0).cast("long").alias("_d")))
                 .groupBy(*key).agg(F.sum("_d").alias("_d")))
        counted = materialize(
            delta.join(old.withColumn("_known", F.lit(True)), key, "left")
            .select(*key, (F.coalesce("n", F.lit(0).cast("long")) + F.col("_d")).alias("n"), "label",
                    (F.coalesce("n", F.lit(0).cast("long")) >= F.lit(self.eta)).alias("_was_core"),
                    (F.col("_known").isNull() | (F.col("_d") > 0)).alias("_changed")))
        new_core = materialize(counted.where(self._is_core() & ~F.col("_was_core")).select(*key))

        # Core labels: those of old cores, and each new core is its own.
        labels = materialize(old.where(self._is_core()).select(*key, "label")
                             .unionByName(new_core.select(*key, F.col("vertexId").alias("label"))))
        frontier = fresh.unionByName(stored_rows.join(new_core, key, "left_semi"))
        links = (frontier.join(labels.withColumnRenamed("label", "_a"), key)
                 .join(labels.select("eventTime", F.col("vertexId").alias("neighbourId"),
                                     F.col("label").alias("_b")), ["eventTime", "neighbourId"])
                 .select("eventTime", "_a", "_b")
                 .unionByName(new_core.select("eventTime", F.col("vertexId").alias("_a"),
                                              F.col("vertexId").alias("_b"))).distinct())
        lost = materialize(merged_labels(links, "_a", "_b").where(F.col("_label") != F.col("_new")))
        named = (labels.join(lost.withColumnRenamed("_label", "label"), ["eventTime", "label"], "left")
                 .select(*key, F.coalesce("_new", "label").alias("label"), F.col("_new").isNotNull().alias("_moved")))
        named = materialize(named.join(new_core.withColumn("_fresh", F.lit(True)), key, "left")
                            .withColumn("_touched", F.col("_moved") | F.col("_fresh").isNotNull())
                            .drop("_moved", "_fresh"))
        touched = named.where("_touched").select(*key, "label")

        # Border vertices see what new rows and touched cores bring them.
        seen = (fresh.join(named.select(*key, "label"), key)
                .unionByName(stored_rows.join(touched, key))
                .groupBy("eventTime", F.col("neighbourId").alias("vertexId"))
                .agg(F.min("label").alias("_seen"))
                .join(named.select(*key), key, "left_anti"))
        changed = materialize(
            counted.where("_changed").select(*key, F.col("n").alias("_n"))
            .join(touched.withColumnRenamed("label", "_core"), key, "full")
            .join(seen, key, "full").join(old, key, "left")
            .select(*key, F.coalesce("_n", "n").alias("n"),
                    F.coalesce("_core", F.least("label", "_seen")).alias("label")))
        now = materialize(self._with_changes(old, self._write(trigger, changed)))

        core = now.where(self._is_core())
        ranks = dense_number(core.select("eventTime", "label").distinct(), "label", ["eventTime"], name="_rank")
        kind = (F.when(self._is_core(), F.lit(CORE)).when(F.col("label").isNotNull(), F.lit(BORDER))
                .otherwise(F.lit(NOISE)))
        in_cluster = now.where(F.col("label").isNotNull()).join(ranks, ["eventTime", "label"])
        noise = now.where(F.col("label").isNull())
        out = (in_cluster.select((F.col("_rank") - 1).cast("int").alias("clusterId"), "eventTime",
                                 trigger.final().alias("final"), "vertexId", kind.alias("vertexType"))
               .unionByName(noise.select(F.lit(NOISE_CLUSTER_ID).cast("int").alias("clusterId"), "eventTime",
                                         trigger.final().alias("final"), "vertexId", kind.alias("vertexType"))))
        return with_key(out, "vertexId")


def carry_congested_components(measurements: DataFrame, graph: RoadGraph, sink: BatchSink,
                               checkpoint_location: str, threshold: int = CONGESTION_CLASS_THRESHOLD,
                               thresholds=CONGESTION_THRESHOLDS, watermark_delay: str = WATERMARK_DELAY,
                               grace: str = FINAL_GRACE, bucket: str | None = None) -> DataStreamWriter:
    """As ``relabel_congested_components``, with labels carried from trigger to trigger."""
    changed = marked_congested_edges(measurements, graph, threshold, thresholds, watermark_delay, bucket)
    handler = CarriedComponents(_store_path(checkpoint_location), graph, sink,
                                _lag_micros(measurements.sparkSession, watermark_delay, grace))
    return (changed.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint_location).foreachBatch(handler))


def carry_dengraph(measurements: DataFrame, graph: RoadGraph, sink: BatchSink, checkpoint_location: str,
                   weight_field: str = DENGRAPH_WEIGHT_FIELD, eps: float = DENGRAPH_EPSILON,
                   eta: int = DENGRAPH_ETA, watermark_delay: str = WATERMARK_DELAY,
                   grace: str = FINAL_GRACE, bucket: str | None = None) -> DataStreamWriter:
    """As ``relabel_dengraph``, with counts and labels carried from trigger to trigger."""
    changed = marked_edge_distances(measurements, graph, weight_field, watermark_delay, bucket)
    handler = CarriedClusters(_store_path(checkpoint_location), sink,
                              _lag_micros(measurements.sparkSession, watermark_delay, grace), eps, eta)
    return (changed.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint_location).foreachBatch(handler))
