"""Extension: statistics that a stream can keep up to date.

What is kept is of constant size for each group, so these run on unbounded input. Quantiles and exact distinct counts
are left to the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import require_categorical, require_numeric


def running_numeric(stream: DataFrame, column: str) -> DataFrame:
    """Counts, mean, extremes and deviation of a column so far; for output mode ``complete`` or ``update``."""
    c = F.col(require_numeric(stream, column))
    x = c.cast("double")
    return stream.groupBy().agg(
        F.count(c).alias("count"),
        F.count_if(c.isNull()).alias("null_count"),
        F.mean(x).alias("mean"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.stddev_samp(x).alias("std"),
    )


def windowed_frequencies(stream: DataFrame, column: str, time: str, width: str, late: str) -> DataFrame:
    """How often each value occurs in each window of ``time``; rows more than ``late`` behind are left out."""
    require_categorical(stream, column)
    seen = stream.withWatermark(time, late).groupBy(
        F.window(time, width), F.col(column).alias("Column_value")
    ).agg(F.count(F.lit(1)).alias("Value_count"))
    return seen.select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "Column_value", "Value_count"
    )
