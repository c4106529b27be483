"""End-to-end batch jobs."""

from trafficgraph.plans.congested import (CongestedComponentsResult, component_labels,
                                          congested_components, congested_edges,
                                          register_views, with_congestion_class)
from trafficgraph.plans.dengraph import DengraphResult, dengraph, weighted_edges

__all__ = ["CongestedComponentsResult", "DengraphResult", "component_labels",
           "congested_components", "congested_edges", "dengraph", "register_views",
           "weighted_edges",
           "with_congestion_class"]
