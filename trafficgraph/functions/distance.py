"""Edge weight -> DenGraph distance (a ``Column`` expression, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def proximity_distance(src: Column | str = "src", dst: Column | str = "dst",
                       weight: Column | str = "weight") -> Column:
    """``distance = 1 - proximity`` with ``proximity = 1 - 1/weight``.

    A self-loop has proximity 1 (distance 0). Weight 0 gives +Infinity (far;
    ANSI mode would raise on ``1/0``). A negative weight gives a negative
    distance, which counts as near. A null weight gives null (never near).
    The double subtraction is kept on purpose: it is not bitwise ``1/weight``
    and the neighbour test compares against a fixed radius.
    """
    s = F.col(src) if isinstance(src, str) else src
    d = F.col(dst) if isinstance(dst, str) else dst
    w = (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    proximity = F.lit(1.0) - F.lit(1.0) / F.when(w != F.lit(0.0), w)
    return (F.when(s == d, F.lit(0.0))
            .when(w == F.lit(0.0), F.lit(float("inf")))
            .otherwise(F.lit(1.0) - proximity))
