"""Congestion class of a measurement (a ``Column`` expression, no UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficgraph.constants import CONGESTION_THRESHOLDS


def congestion_class(free_flow: Column | str = "vFreeflowMin",
                     speed: Column | str = "averageSpeed",
                     thresholds: Sequence[float] = CONGESTION_THRESHOLDS) -> Column:
    """Grade how far the speed falls below free flow.

    ``diff = free_flow - speed``. ``diff <= t0`` is class 0; ``t(k-1) <= diff < t(k)``
    is class k; anything else (at or above the last threshold, or NaN) is the
    top class ``len(thresholds)``. A null input gives null.

    Written as a compare chain rather than ``floor(diff / 5)``: Spark maps
    ``floor(NaN)`` to 0, while NaN must land in the top class.
    """
    ts = [float(t) for t in thresholds]
    if len(ts) < 2 or any(a >= b for a, b in zip(ts, ts[1:])):
        raise ValueError("thresholds must be strictly increasing, at least two")
    ff = F.col(free_flow) if isinstance(free_flow, str) else free_flow
    sp = F.col(speed) if isinstance(speed, str) else speed
    diff = ff - sp
    expr = F.when(diff.isNull(), F.lit(None).cast("int")).when(diff <= F.lit(ts[0]), F.lit(0))
    for k, upper in enumerate(ts[1:], start=1):
        expr = expr.when(diff < F.lit(upper), F.lit(k))
    return expr.otherwise(F.lit(len(ts))).cast("int")
