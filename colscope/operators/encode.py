"""Encodings of a categorical column.

What is encoded is either the whole column or a preview, its first rows in the order of a key; frequencies, codes and
ranks then describe these rows only. Rows have no order of their own in Spark, so labels and previews need the key.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import require_categorical, require_column
from ..sources.shared import shared_dir


class Encoding(str, Enum):
    LABEL = "label"
    ORDINAL = "ordinal"
    FREQUENCY = "frequency"
    ONE_HOT = "one_hot"

    @classmethod
    def _missing_(cls, value: object) -> Encoding | None:
        """Names may end in ``_encoding``."""
        return next((k for k in cls if value == f"{k.value}_encoding"), None)


class TooManyValues(ValueError):
    """One column for each value would be too many columns."""


def head(df: DataFrame, order_key: str, length: int = 20) -> DataFrame:
    """The first rows by ``order_key``, which should be unique."""
    require_column(df, order_key)
    return df.orderBy(order_key).limit(length)


def _looked_up(df: DataFrame, column: str, codes: DataFrame, result: Column) -> DataFrame:
    """``df`` with the code of each value; null matches null. Spark broadcasts the codes if they are small."""
    renamed = codes.withColumnRenamed("value", "__value")
    return df.join(
        renamed, df[column].eqNullSafe(renamed["__value"]), "left"
    ).withColumn(f"{column}_encoded", result).drop(*renamed.columns)


def encode_frequency(df: DataFrame, column: str) -> DataFrame:
    """Share of all rows that have the row's value; null is a value."""
    require_categorical(df, column)
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("__count"))
    shares = counts.crossJoin(F.broadcast(counts.agg(F.sum("__count").alias("__n"))))
    return _looked_up(df, column, shares, F.col("__count") / F.col("__n"))


def _numbered(values: DataFrame, order: str) -> DataFrame:
    """``value, __code``: places from 0 in ``order``, which has no ties. Values are dealt by range, written, and numbered
    within each range; ranges, of which there are as many as tasks, are offset by what lies before them."""
    shared_dir(values.sparkSession)
    ranged = values.repartitionByRange(order).withColumn("__range", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")
    offsets = sizes.select("__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return ranged.withColumn("__within", within).join(F.broadcast(offsets), "__range").select(
        "value", (F.col("__before") + F.col("__within")).alias("__code")
    )


def encode_label(df: DataFrame, column: str, order_key: str) -> DataFrame:
    """Codes (bigint) from 0 in order of first appearance by ``order_key``; null stays null."""
    require_categorical(df, column)
    require_column(df, order_key)
    known = df.filter(F.col(column).isNotNull())
    first = known.groupBy(F.col(column).alias("value")).agg(F.min(order_key).alias("__first"))
    return _looked_up(df, column, _numbered(first, "__first"), F.col("__code"))


def encode_ordinal(df: DataFrame, column: str) -> DataFrame:
    """Ranks (bigint) from 0 among the distinct values in order; null stays null."""
    require_categorical(df, column)
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return _looked_up(df, column, _numbered(values, "value"), F.col("__code"))


def encode_one_hot(df: DataFrame, column: str, values: list[str | None] | None = None, most: int = 1000) -> DataFrame:
    """A 0/1 column ``column_value`` for each value (null: ``column_null``) in place of the column.

    Columns must be known before the plan is, so values not given are read: ``most`` and one at most reach the driver,
    and ``TooManyValues`` says if there are more than ``most``.
    """
    require_categorical(df, column)
    if values is None:
        values = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
        if len(values) > most:
            raise TooManyValues(f"{column!r} has more than {most} values")
    ordered = sorted((v for v in values if v is not None)) + [None] * (None in values)
    hot = [
        F.col(column).eqNullSafe(F.lit(v)).cast("int").alias(f"{column}_{'null' if v is None else v}")
        for v in ordered
    ]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *hot)


def encode(
    df: DataFrame,
    column: str,
    kind: Encoding | str,
    order_key: str | None = None,
    scope: str = "full",
    length: int = 20,
) -> DataFrame:
    """The table with the column encoded; ``scope`` is ``full`` or ``preview``."""
    kind = Encoding(kind)
    if scope not in ("full", "preview"):
        raise ValueError(f"unknown scope {scope!r}")
    if (scope == "preview" or kind is Encoding.LABEL) and order_key is None:
        raise ValueError("previews and labels need an order key")
    rows = head(df, order_key, length) if scope == "preview" else df
    if kind is Encoding.LABEL:
        return encode_label(rows, column, order_key)
    return {
        Encoding.ORDINAL: encode_ordinal, Encoding.FREQUENCY: encode_frequency, Encoding.ONE_HOT: encode_one_hot
    }[kind](rows, column)
