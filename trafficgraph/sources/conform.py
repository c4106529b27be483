"""Typed decoding of rows: select and cast to a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType, allow_missing: bool = False) -> DataFrame:
    """Project ``df`` onto ``schema``: same names, same order, cast types.

    A missing column raises (the typed decode of the original fails the same
    way) unless ``allow_missing``, which fills it with null.
    """
    present = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name in present:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif allow_missing:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"missing column {field.name!r}; have {sorted(present)}")
    return df.select(*cols)
