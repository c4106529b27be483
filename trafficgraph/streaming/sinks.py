"""Sinks: console, message bus (key/value), partitioned files; starting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from trafficgraph.functions.output import to_key_value
from trafficgraph.constants import JSON_TIMESTAMP_FORMAT


def console_writer(df: DataFrame, output_mode: str = "update",
                   truncate: bool = False) -> DataStreamWriter:
    """Key/value rows to the console, untruncated."""
    return (to_key_value(df).writeStream.outputMode(output_mode).format("console")
            .option("truncate", str(bool(truncate)).lower()))


def kafka_options(bootstrap_servers: str, topic: str, checkpoint_location: str,
                  **extra: str) -> dict[str, str]:
    """Options of the message-bus sink; the frame must be ``key, value`` strings."""
    opts = {"kafka.bootstrap.servers": bootstrap_servers, "topic": topic,
            "checkpointLocation": checkpoint_location}
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def kafka_writer(df: DataFrame, bootstrap_servers: str, topic: str, checkpoint_location: str,
                 output_mode: str = "update",
                 timestamp_format: str = JSON_TIMESTAMP_FORMAT, **extra: str) -> DataStreamWriter:
    """Key/value rows to a topic (needs the Kafka connector on the classpath)."""
    return (to_key_value(df, timestamp_format).writeStream.outputMode(output_mode)
            .format("kafka").options(**kafka_options(bootstrap_servers, topic,
                                                     checkpoint_location, **extra)))


def console_batch_sink(rows: int = 20, truncate: bool = False):
    """``foreachBatch`` sink printing up to ``rows`` key/value rows of each batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        print(f"-------- batch {int(batch_id)} --------")
        to_key_value(batch).show(rows, truncate)
    return write


def kafka_batch_sink(bootstrap_servers: str, topic: str,
                     timestamp_format: str = JSON_TIMESTAMP_FORMAT, **extra: str):
    """``foreachBatch`` sink writing key/value rows to a topic (needs the Kafka
    connector on the classpath). A replayed batch is sent again with the same keys."""
    options = kafka_options(bootstrap_servers, topic, "", **extra)
    options.pop("checkpointLocation")       # the query's own, not the writer's

    def write(batch: DataFrame, batch_id: int) -> None:
        (to_key_value(batch, timestamp_format).write.format("kafka").options(**options).save())
    write.options = options
    return write


def parquet_batch_sink(path: str, partition_by: str | None = "state"):
    """``foreachBatch`` sink writing each batch to ``path/batchId=<id>/``.

    A batch replayed after a failure overwrites its own folder, so the
    result is written exactly once. Rows keep the boolean ``final``; folders
    are split by ``partition_by``, derived from it (``final`` or
    ``interim``), so readers can prune on it and on ``batchId``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch
        if partition_by:
            writer = batch.withColumn(partition_by, F.when(F.col("final"), "final").otherwise("interim"))
        writer = writer.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{path.rstrip('/')}/batchId={int(batch_id)}")
    return write


def file_writer(df: DataFrame, path: str, checkpoint_location: str,
                output_mode: str = "update") -> DataStreamWriter:
    """Partitioned parquet output for update-mode results (via ``foreachBatch``).

    The built-in file sink accepts only append mode; stateful updates are
    written batch by batch instead.
    """
    return (df.writeStream.outputMode(output_mode)
            .option("checkpointLocation", checkpoint_location)
            .foreachBatch(parquet_batch_sink(path)))


def start(writer: DataStreamWriter, available_now: bool = False,
          processing_time: str | None = None, query_name: str | None = None) -> StreamingQuery:
    """Start a query; ``available_now`` processes what is there, then stops."""
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
