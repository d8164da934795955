"""Standardising and binning a numeric column."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.types import require_numeric
from .encode import head


class Binning(str, Enum):
    EQUAL_WIDTH = "equal_width"
    QUANTILE = "quantile"
    STANDARDIZE = "standardize"


class NotApplicable(ValueError):
    """The column has no spread to standardise by."""


def standardize(df: DataFrame, column: str) -> DataFrame:
    """Adds ``column_std``: the distance from the mean in sample deviations; null where there is no spread."""
    require_numeric(df, column)
    x = F.col(column).cast("double")
    one = df.agg(F.mean(x).alias("__mean"), F.stddev_samp(x).alias("__std"))
    return df.crossJoin(F.broadcast(one)).withColumn(
        f"{column}_std", F.try_divide(x - F.col("__mean"), F.col("__std"))
    ).drop("__mean", "__std")


def spread(df: DataFrame, column: str) -> float:
    """The sample deviation; ``NotApplicable`` if it is null or zero."""
    require_numeric(df, column)
    found = df.agg(F.stddev_samp(F.col(column).cast("double"))).first()[0]
    if not found:
        raise NotApplicable(f"{column!r} has no spread")
    return found


def _index(x: Column, breaks: Column) -> Column:
    """How many breaks lie below: bins are closed on the right."""
    return F.when(x.isNotNull(), F.size(F.filter(breaks, lambda b: b < x)))


def _binned(df: DataFrame, column: str, breaks: DataFrame) -> DataFrame:
    """Adds ``column_binned`` (from 0), ``column_lower`` and ``column_upper`` (null: none); ``breaks`` is one row."""
    x = F.col(column).cast("double")
    out = df.crossJoin(F.broadcast(breaks)).withColumn("__bin", _index(x, F.col("__breaks")))
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("__bin").alias(f"{column}_binned"),
        F.get("__breaks", F.col("__bin") - 1).alias(f"{column}_lower"),
        F.get("__breaks", F.col("__bin")).alias(f"{column}_upper"),
    )


def _check(n_bin: int) -> None:
    if n_bin < 1:
        raise ValueError("n_bin is 1 at least")


def equal_width_breaks(df: DataFrame, column: str, n_bin: int = 10) -> DataFrame:
    """One row with the inner ``__breaks``; none if all values are equal."""
    _check(n_bin)
    x = F.col(require_numeric(df, column)).cast("double")
    step = (F.col("high") - F.col("low")) / F.lit(n_bin)
    breaks = F.array(*[F.col("low") + i * step for i in range(1, n_bin)]).cast("array<double>")
    return df.agg(F.min(x).alias("low"), F.max(x).alias("high")).select(
        F.when(F.col("high") > F.col("low"), breaks).otherwise(F.array().cast("array<double>")).alias("__breaks")
    )


def quantile_breaks(df: DataFrame, column: str, n_bin: int = 10) -> DataFrame:
    """One row with the inner ``__breaks`` at even probabilities, interpolated, each once."""
    _check(n_bin)
    require_numeric(df, column)
    if n_bin == 1:
        return df.sparkSession.range(1).select(F.array().cast("array<double>").alias("__breaks"))
    names = [f"q{i}" for i in range(1, n_bin)]
    found = quantiles(df, column, [(name, i / n_bin, "linear") for i, name in enumerate(names, 1)])
    return found.select(F.array_distinct(F.filter(F.array(*names), lambda b: b.isNotNull())).alias("__breaks"))


def bin_equal_width(df: DataFrame, column: str, n_bin: int = 10) -> DataFrame:
    return _binned(df, column, equal_width_breaks(df, column, n_bin))


def bin_quantile(df: DataFrame, column: str, n_bin: int = 10) -> DataFrame:
    return _binned(df, column, quantile_breaks(df, column, n_bin))


def bin_label(df: DataFrame, column: str) -> DataFrame:
    """Adds ``column_label``, the interval in words, to a binned table."""
    low, high = F.col(f"{column}_lower"), F.col(f"{column}_upper")
    text = F.concat(
        F.lit("("),
        F.coalesce(low.cast("string"), F.lit("-inf")),
        F.lit(", "),
        F.coalesce(high.cast("string"), F.lit("inf")),
        F.lit("]"),
    )
    return df.withColumn(f"{column}_label", F.when(F.col(f"{column}_binned").isNotNull(), text))


def transform(
    df: DataFrame,
    column: str,
    kind: Binning | str,
    n_bin: int = 10,
    order_key: str | None = None,
    scope: str = "full",
    length: int = 20,
) -> DataFrame:
    """The table with the column standardised or binned; a preview describes its first rows by ``order_key`` only."""
    kind = Binning(kind)
    if scope not in ("full", "preview"):
        raise ValueError(f"unknown scope {scope!r}")
    if scope == "preview" and order_key is None:
        raise ValueError("previews need an order key")
    rows = head(df, order_key, length) if scope == "preview" else df
    if kind is Binning.STANDARDIZE:
        return standardize(rows, column)
    return (bin_equal_width if kind is Binning.EQUAL_WIDTH else bin_quantile)(rows, column, n_bin)
