"""The column profile: types, nulls, distinct values and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _distinct(column: str, approximate: bool):
    """Distinct values, null counting as one."""
    c = F.col(f"`{column}`")
    values = F.approx_count_distinct(c) if approximate else F.count_distinct(c)
    return values + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def profile_wide(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: ``n_rows`` and, for each column c, ``c_nulls`` and ``c_nunique``, from one aggregate.

    Exact distinct counts make Spark keep one row for each column and value until the values have been counted;
    ``approximate`` counts with a sketch of constant size instead, for tables where that is too much. Maps can't be
    compared, so they have a null count of distinct values.
    """
    columns = [F.count(F.lit(1)).alias("n_rows")]
    for name, kind in df.dtypes:
        columns.append(F.count_if(F.col(f"`{name}`").isNull()).alias(f"{name}_nulls"))
        columns.append(
            (F.lit(None).cast("long") if "map<" in kind else _distinct(name, approximate)).alias(f"{name}_nunique")
        )
    return df.agg(*columns)


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row a column: ``column, dtype, nulls, nunique, n_rows``."""
    wide = profile_wide(df, approximate)
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("dtype"),
            F.col(f"`{name}_nulls`").alias("nulls"),
            F.col(f"`{name}_nunique`").alias("nunique"),
            F.col("n_rows"),
        )
        for name, kind in df.dtypes
    ]
    return wide.select(F.inline(F.array(*rows)))


def profile_record(df: DataFrame, approximate: bool = False) -> dict:
    """The profile as ``columns, dtypes, stats, n_rows``; one row reaches the driver."""
    stats = profile_wide(df, approximate).first().asDict()
    n = stats.pop("n_rows")
    return {"columns": df.columns, "dtypes": dict(df.dtypes), "stats": stats, "n_rows": n}
