"""Statistics of one numeric or one categorical column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import constants, one_row, quantiles, sketch_columns
from ..functions.types import require_categorical, require_numeric

#: Absolute skewness below which a column counts as symmetric.
SYMMETRIC = 0.5


def skew_class(skewness: Column) -> Column:
    """In words; null and NaN are undetermined, and exactly the limit counts as skewed."""
    return F.when(skewness.isNull() | F.isnan(skewness), "undetermined").when(
        F.abs(skewness) < SYMMETRIC, "approximately symmetric"
    ).when(skewness > 0, "right-skewed").otherwise("left-skewed")


def _moment_columns(df: DataFrame, column: str) -> list[Column]:
    c = F.col(require_numeric(df, column))
    x = c.cast("double")
    return [
        F.count(c).alias("count"),
        F.count_if(c.isNull()).alias("null_count"),
        F.mean(x).alias("mean"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.var_samp(x).alias("variance"),
        F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("skewness"),
    ]


def _with_range(df: DataFrame, one: DataFrame, column: str) -> DataFrame:
    whole = not isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))
    high, low = (F.col(c).cast("bigint") if whole else F.col(c) for c in ("max", "min"))
    return one.withColumn("range", F.try_subtract(high, low))


def moments(df: DataFrame, column: str) -> DataFrame:
    """One row: ``count, null_count, mean, min, max, variance, std, skewness, range``. Variance and deviation are the
    sample's, skewness is the population's; all are null where undefined. Extremes are of the column's type; the range of
    whole numbers is a bigint, null if it is none."""
    return _with_range(df, df.agg(*_moment_columns(df, column)), column)


def _quartile_ranks(interpolation: str) -> list[tuple[str, float, str]]:
    return [("q1", 0.25, interpolation), ("median", 0.5, "linear"), ("q3", 0.75, interpolation)]


def quartiles(
    df: DataFrame, column: str, interpolation: str = "nearest", sketch: dict[str, Column] | None = None
) -> DataFrame:
    """One row: ``q1, median, q3, iqr, lower_bound, upper_bound``. The median always interpolates."""
    require_numeric(df, column)
    found = quantiles(df, column, _quartile_ranks(interpolation), sketch=sketch)
    spread = F.col("q3") - F.col("q1")
    return found.withColumns(
        {"iqr": spread, "lower_bound": F.col("q1") - 1.5 * spread, "upper_bound": F.col("q3") + 1.5 * spread}
    )


def outliers(df: DataFrame, column: str, interpolation: str = "nearest") -> DataFrame:
    """The rows strictly outside the bounds, which are found when this is called."""
    found = quartiles(df, column, interpolation).first()
    x = F.col(column).cast("double")
    return df.filter((x < F.lit(found["lower_bound"])) | (x > F.lit(found["upper_bound"])))


def univariate_numeric(df: DataFrame, column: str, interpolation: str = "nearest") -> DataFrame:
    """One row: all of ``moments`` and ``quartiles``, ``outlier_count`` and ``skew_class``.

    The column is read three times: for moments and sketch, for the quartiles, and for what lies outside their bounds.
    The first two results, a row each, are read by the driver when this is called.
    """
    x = F.col(require_numeric(df, column)).cast("double")
    sketched = df.agg(*_moment_columns(df, column), *sketch_columns(x, _quartile_ranks(interpolation)))
    known = constants(sketched, sketched.first())
    sketch = {c: known.pop(c) for c in ("n", "b")}
    bounds = quartiles(df, column, interpolation, sketch)
    bounds = one_row(df, constants(bounds, bounds.first()))
    outside = df.select(x.alias("__x")).crossJoin(F.broadcast(bounds)).agg(
        F.count_if(
            (F.col("__x") < F.col("lower_bound")) | (F.col("__x") > F.col("upper_bound"))
        ).alias("outlier_count")
    )
    whole = _with_range(df, one_row(df, known), column).crossJoin(bounds).crossJoin(outside)
    return whole.withColumn("skew_class", skew_class(F.col("skewness")))


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """``Column_value, Value_count, Frequency, Percentage`` by value, null being one; shares are of all rows."""
    require_categorical(df, column)
    counts = df.groupBy(F.col(column).alias("Column_value")).agg(F.count(F.lit(1)).alias("Value_count"))
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    share = F.col("Value_count") / F.col("__n")
    return counts.crossJoin(F.broadcast(total)).select(
        "Column_value", "Value_count", share.alias("Frequency"), (share * 100).alias("Percentage")
    )


def sorted_frequency_table(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value first, ties by value, null last."""
    return frequency_table(df, column).orderBy(F.col("Value_count").desc(), F.col("Column_value").asc_nulls_last())


def frequency_valid(df: DataFrame, column: str) -> DataFrame:
    return frequency_table(df, column).filter(F.col("Column_value").isNotNull())


def frequency_missing(df: DataFrame, column: str) -> DataFrame:
    return frequency_table(df, column).filter(F.col("Column_value").isNull())


def modes(df: DataFrame, column: str) -> DataFrame:
    """``value, count`` of every most frequent value, null aside. Counts are compared, values never gathered."""
    require_categorical(df, column)
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    most = counts.agg(F.max("count").alias("__most"))
    return counts.crossJoin(F.broadcast(most)).filter(F.col("count") == F.col("__most")).drop("__most")


def univariate_categorical(df: DataFrame, column: str, most_modes: int | None = None) -> DataFrame:
    """One row: ``modes`` (in order), ``n_modes, n_unique, valid_count, null_count, total_count``.

    If every value of a large column is as frequent as any other, all are modes. The list has them all, or the
    ``most_modes`` smallest if given; ``n_modes`` says how many there are, and ``modes`` (the function) gives all as a
    table, without a list that one task holds.
    """
    c = F.col(require_categorical(df, column))
    counts = df.groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    found = modes(df, column)
    first = found if most_modes is None else found.orderBy("value").limit(most_modes)
    listed = first.agg(F.sort_array(F.collect_list("value")).alias("modes"))
    number = found.agg(F.count(F.lit(1)).alias("n_modes"))
    valid = F.col("v").isNotNull()
    one = counts.agg(
        F.count("v").alias("n_unique"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid_count"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"),
    )
    return listed.crossJoin(F.broadcast(number)).crossJoin(F.broadcast(one))
