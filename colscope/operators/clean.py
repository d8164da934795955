"""Cleaning actions on one column."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.types import cast_type, require_column, require_numeric


class Cleaning(str, Enum):
    DROP_ROWS = "drop_rows"
    IMPUTE_MEDIAN = "impute_median"
    IMPUTE_MEAN = "impute_mean"
    IMPUTE_MODE = "impute_mode"
    CAST_DTYPE = "cast_dtype"
    DROP_COLUMN = "drop_column"


def drop_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows in which the column is not null."""
    return df.filter(F.col(require_column(df, column)).isNotNull())


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(require_column(df, column))


def _filled(df: DataFrame, column: str, one: DataFrame) -> DataFrame:
    """Nulls become the value in the single row of ``one``; numbers are then doubles."""
    out = df.crossJoin(F.broadcast(one))
    kind = one.schema["__fill"].dataType
    return out.withColumn(column, F.coalesce(F.col(column).cast(kind), F.col("__fill"))).drop("__fill")


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    require_numeric(df, column)
    return _filled(df, column, df.agg(F.mean(F.col(column).cast("double")).alias("__fill")))


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """The exact median, the mean of the middle two."""
    require_numeric(df, column)
    return _filled(df, column, quantiles(df, column, [("__fill", 0.5, "linear")]))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, ties to the smallest."""
    c = F.col(require_column(df, column))
    counts = df.filter(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return _filled(df, column, counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("__fill")))


def cast(df: DataFrame, column: str, target_dtype: str, strict: bool = True) -> DataFrame:
    """A strict cast fails on a value that the type can't hold; else such values become null."""
    c = F.col(require_column(df, column))
    kind = cast_type(target_dtype)
    return df.withColumn(column, c.cast(kind) if strict else c.try_cast(kind))


def clean(
    df: DataFrame, column: str, action: Cleaning | str, target_dtype: str | None = None, strict: bool = True
) -> DataFrame:
    """The table after the action."""
    action = Cleaning(action)
    if action is Cleaning.CAST_DTYPE:
        if not target_dtype:
            raise ValueError("cast_dtype needs target_dtype")
        return cast(df, column, target_dtype, strict)
    run = {
        Cleaning.DROP_ROWS: drop_rows,
        Cleaning.IMPUTE_MEDIAN: impute_median,
        Cleaning.IMPUTE_MEAN: impute_mean,
        Cleaning.IMPUTE_MODE: impute_mode,
        Cleaning.DROP_COLUMN: drop_column,
    }
    return run[action](df, column)
