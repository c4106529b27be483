"""Distributed operators: placement, vertex ids, graph algorithms."""

from trafficgraph.operators.components import ComponentsDidNotConverge, connected_components
from trafficgraph.operators.density import (core_vertices, dengraph_clusters, edge_distances,
                                            epsilon_edges, neighbour_rows, neighbourhood_sizes,
                                            with_distance)
from trafficgraph.operators.materialize import materialize, table_scope
from trafficgraph.operators.numbering import dense_number
from trafficgraph.operators.placement import place_on_edges
from trafficgraph.operators.vertices import road_vertices, vertex_numeric_ids

__all__ = ["ComponentsDidNotConverge", "connected_components", "core_vertices",
           "dengraph_clusters", "dense_number", "edge_distances", "epsilon_edges", "materialize",
           "neighbour_rows", "neighbourhood_sizes", "place_on_edges", "road_vertices",
           "table_scope", "vertex_numeric_ids", "with_distance"]
