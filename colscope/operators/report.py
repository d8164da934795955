"""Results in words. Only single rows and the first rows of tables are read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from .univariate import frequency_missing, modes, sorted_frequency_table, univariate_numeric


def number(value: float | None) -> str:
    return "n/a" if value is None else f"{value:.4f}"


def table(df: DataFrame, rows: int = 20, empty: str = "No rows.") -> str:
    """The first rows in columns of equal width, and whether there are more."""
    found = df.limit(rows + 1).collect()
    more, found = found[rows:], found[:rows]
    if not found:
        return empty
    cells = [
        df.columns,
        *[["null" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in found],
    ]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([*lines, *[f"... and more; these are the first {rows}" for _ in more]])


def numeric_report(df: DataFrame, column: str, interpolation: str = "nearest") -> str:
    s = univariate_numeric(df, column, interpolation).first().asDict()
    n = {k: number(v) for k, v in s.items() if k != "skew_class"}
    return "\n".join((
        f"{column}: {s['count']} values, {s['null_count']} null",
        f"centre: mean {n['mean']}, median {n['median']}",
        f"spread: range {n['range']} ({n['min']} to {n['max']}), variance {n['variance']}, deviation {n['std']}, interquartile range {n['iqr']} ({n['q1']} to {n['q3']})",
        f"shape: skewness {n['skewness']}, {s['skew_class']}",
        f"outliers: {s['outlier_count']} outside {n['lower_bound']} to {n['upper_bound']}",
    ))


def categorical_report(df: DataFrame, column: str, rows: int = 1000) -> str:
    """Modes and frequencies, all of them up to ``rows`` of each; beyond, the text says how many are left out."""
    s = sorted_frequency_table(df, column).agg(
        F.count("Column_value").alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col("Column_value").isNotNull(), F.col("Value_count"))), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("Column_value").isNull(), F.col("Value_count"))), F.lit(0)).alias("null"),
    ).first()
    most = modes(df, column)
    first = [r["value"] for r in most.orderBy("value").limit(rows + 1).collect()]
    left_out = f" and {most.count() - rows} more" if len(first) > rows else ""
    valid = sorted_frequency_table(df, column).filter("Column_value IS NOT NULL")
    beyond = [f"{s['n_unique'] - rows} more values are left out"] if s["n_unique"] > rows else []
    return "\n".join((
        f"{column}: {s['valid']} values, {s['null']} null, {s['n_unique']} different",
        f"most frequent: {', '.join(first[:rows]) or 'None'}{left_out}",
        table(valid.limit(rows), rows, "No valid data found."),
        *beyond,
        table(frequency_missing(df, column), 1, "No missing values."),
    ))


def preview_report(df: DataFrame, title: str, rows: int = 20) -> str:
    return f"{title}\n{table(df.limit(rows), rows)}"
