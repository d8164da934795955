"""How many rows a cleaning action affects, from a profile alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import Cleaning


def impact(profile: dict, column: str, action: Cleaning | str) -> tuple[int, float]:
    """Rows affected, and as a fraction of all rows: the column's nulls if rows are dropped, all rows if the column
    is, and none for any other action. Unknown columns have no nulls; the fraction of no rows is 0."""
    action, total = Cleaning(action), profile.get("n_rows") or 0
    affected = profile["stats"].get(
        f"{column}_nulls", 0
    ) if action is Cleaning.DROP_ROWS else total if action is Cleaning.DROP_COLUMN else 0
    return affected, affected / total if total else 0.0


def impacts(profiled: DataFrame) -> DataFrame:
    """``column, action, rows_affected, rows_affected_pct`` of every action on every column of a long profile."""
    actions = F.array(*[F.lit(a.value) for a in Cleaning])
    rows = profiled.select("column", F.explode(actions).alias("action"), "nulls", "n_rows")
    affected = F.when(F.col("action") == Cleaning.DROP_ROWS.value, F.col("nulls")).when(
        F.col("action") == Cleaning.DROP_COLUMN.value, F.col("n_rows")
    ).otherwise(F.lit(0)).cast("long")
    return rows.select(
        "column",
        "action",
        affected.alias("rows_affected"),
        F.when(F.col("n_rows") > 0, affected / F.col("n_rows")).otherwise(F.lit(0.0)).alias("rows_affected_pct"),
    )
