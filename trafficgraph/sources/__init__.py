"""Sources: edge graph, measurement batches and streams, test binding."""

from trafficgraph.sources.binding import edges_from_events, measurements_from_events, road_tables
from trafficgraph.sources.conform import conform
from trafficgraph.sources.edges import read_edges, read_edges_csv
from trafficgraph.sources.measurements import (bucketed, read_measurements_csv,
                                               stream_measurements_csv, valid_measurements)
from trafficgraph.sources.rejects import (accepted, observed, rejected, rejects_writer,
                                          split_measurements, stream_tagged_measurements_csv,
                                          tagged_measurements_csv)

__all__ = ["accepted", "observed", "rejected", "rejects_writer", "split_measurements",
           "stream_tagged_measurements_csv", "tagged_measurements_csv", "bucketed", "conform", "edges_from_events", "measurements_from_events", "read_edges",
           "read_edges_csv", "read_measurements_csv", "road_tables", "stream_measurements_csv",
           "valid_measurements"]
