"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def literal_frame(spark, rows, schema) -> DataFrame:
    """A small DataFrame built from constants; its size is bounded by
    construction, so it may be broadcast without a check."""
    return F.broadcast(spark.createDataFrame(rows, schema))
