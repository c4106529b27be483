"""Scalar ``Column`` functions."""

from trafficgraph.functions.congestion import congestion_class
from trafficgraph.functions.distance import proximity_distance
from trafficgraph.functions.output import to_key_value, update_key, with_key

__all__ = ["congestion_class", "proximity_distance", "to_key_value", "update_key", "with_key"]
