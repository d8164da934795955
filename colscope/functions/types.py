"""Which columns count as numbers and which as categories, and the types that casts may name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Decimals, booleans, dates, times and nested types are neither.
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
CATEGORICAL = (T.StringType,)

#: Cast targets by name, and Spark's type for each. Spark has no unsigned types, so those widen.
CAST_TYPES = {
    "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint",
    "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)",
    "Float32": "float", "Float64": "double", "String": "string", "Utf8": "string",
    "Categorical": "string", "Boolean": "boolean", "Date": "date", "Datetime": "timestamp", "Binary": "binary",
}


class ColumnMissing(ValueError):
    """The table has no such column."""


class WrongType(TypeError):
    """The column is of a type that the operator does not take."""


def _field(df: DataFrame, column: str) -> T.StructField:
    if column not in df.columns:
        raise ColumnMissing(f"no column {column!r}; there are {', '.join(df.columns)}")
    return df.schema[column]


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(_field(df, column).dataType, NUMERIC)


def is_categorical(df: DataFrame, column: str) -> bool:
    return isinstance(_field(df, column).dataType, CATEGORICAL)


def require_column(df: DataFrame, column: str) -> str:
    return _field(df, column).name


def require_numeric(df: DataFrame, column: str) -> str:
    if not is_numeric(df, column):
        raise WrongType(f"{column!r} is {_field(df, column).dataType.simpleString()}, not a number")
    return column


def require_categorical(df: DataFrame, column: str) -> str:
    if not is_categorical(df, column):
        raise WrongType(f"{column!r} is {_field(df, column).dataType.simpleString()}, not a category")
    return column


def cast_type(name: str) -> str:
    """Spark's type for a cast target; ``ValueError`` for names that are not known."""
    if name not in CAST_TYPES:
        raise ValueError(f"unknown type {name!r}; known: {', '.join(sorted(CAST_TYPES))}")
    return CAST_TYPES[name]
