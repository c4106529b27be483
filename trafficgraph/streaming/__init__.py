"""Structured Streaming: interim/final labels, finals at scale, sinks, monitoring."""

from trafficgraph.streaming.carried import (CarriedClusters, CarriedComponents,
                                            carry_congested_components, carry_dengraph)
from trafficgraph.streaming.committed import (committed_attempts, committed_batch_sink,
                                              read_committed)
from trafficgraph.streaming.finals import (clusters_handler, components_handler,
                                           final_congested_edges, final_edge_distances,
                                           marked_congested_edges, marked_edge_distances)
from trafficgraph.streaming.jobs import interval_ms, watermarked
from trafficgraph.streaming.listener import ProgressCollector, progress_record, query_progress
from trafficgraph.streaming.relabel import (EdgeStoreRelabel, relabel_congested_components,
                                            relabel_dengraph)
from trafficgraph.streaming.revised import (RevisedFinals, latest_finals, read_late,
                                            revised_congested_components, revised_dengraph,
                                            with_heartbeat)
from trafficgraph.streaming.sinks import (console_batch_sink, console_writer, file_writer,
                                          kafka_batch_sink, kafka_options, kafka_writer,
                                          parquet_batch_sink, start)

__all__ = ["CarriedClusters", "CarriedComponents", "EdgeStoreRelabel", "ProgressCollector",
           "carry_congested_components", "carry_dengraph", "clusters_handler", "committed_attempts",
           "committed_batch_sink", "read_committed", "components_handler",
           "console_batch_sink", "console_writer", "file_writer", "final_congested_edges",
           "final_edge_distances", "interval_ms", "kafka_batch_sink", "kafka_options",
           "kafka_writer", "latest_finals", "marked_congested_edges", "marked_edge_distances",
           "parquet_batch_sink", "progress_record", "query_progress", "read_late",
           "relabel_congested_components", "relabel_dengraph",
           "RevisedFinals", "revised_congested_components", "revised_dengraph", "start",
           "watermarked", "with_heartbeat"]
