"""Congestion analysis of road-sensor graphs on Spark DataFrames."""

from trafficgraph.plans import congested_components, dengraph

__all__ = ["congested_components", "dengraph"]
__version__ = "0.1.0"
