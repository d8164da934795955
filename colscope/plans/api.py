"""One object for a file: look at it, explore columns, and carry out actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import binning, charts, clean, encode, report, univariate
from ..operators.profile import profile, profile_record
from ..sources.files import extract_columns, scan, sink
from .actions import CleaningAction, EngineeringAction

Confirm = Callable[[CleaningAction | EngineeringAction], bool]


class Dataset:
    """A table and where it came from. Nothing runs until rows are asked for."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def open(cls, spark: SparkSession, path: str, file_format: str, schema=None) -> Dataset:
        return cls(scan(spark, path, file_format, schema))

    @staticmethod
    def columns(spark: SparkSession, path: str, file_format: str) -> list[str]:
        return extract_columns(spark, path, file_format)

    def profile(self, approximate: bool = False) -> DataFrame:
        return profile(self.df, approximate)

    def profile_record(self) -> dict:
        return profile_record(self.df)

    def numeric(self, column: str, interpolation: str = "nearest") -> DataFrame:
        return univariate.univariate_numeric(self.df, column, interpolation)

    def categorical(self, column: str) -> DataFrame:
        return univariate.univariate_categorical(self.df, column)

    def report(self, column: str) -> str:
        from ..functions.types import is_categorical

        return report.categorical_report(
            self.df, column
        ) if is_categorical(self.df, column) else report.numeric_report(self.df, column)

    def chart(self, *columns: str, fraction: float | None = None) -> tuple[str, DataFrame]:
        return charts.chart_data(self.df, columns, fraction)

    def encode(
        self, column: str, kind: str, order_key: str | None = None, scope: str = "full", length: int = 20
    ) -> DataFrame:
        return encode.encode(self.df, column, kind, order_key, scope, length)

    def bin(
        self,
        column: str,
        kind: str,
        n_bin: int = 10,
        order_key: str | None = None,
        scope: str = "full",
        length: int = 20,
    ) -> DataFrame:
        return binning.transform(self.df, column, kind, n_bin, order_key, scope, length)


def carry_out(
    spark: SparkSession,
    action: CleaningAction | EngineeringAction,
    confirm: Confirm | None = None,
    mode: str = "errorifexists",
) -> DataFrame | None:
    """Apply the action to its file and write the result as CSV to its output path. None, and nothing is written, if
    ``confirm`` says no; without ``confirm`` nobody is asked."""
    if confirm is not None and not confirm(action):
        return None
    df = scan(spark, action.file_path, action.file_format)
    if isinstance(action, CleaningAction):
        out = clean.clean(df, action.column, action.action, action.target_dtype)
    elif isinstance(action.action, encode.Encoding):
        out = encode.encode(df, action.column, action.action, action.order_key)
    else:
        if action.action is binning.Binning.STANDARDIZE:
            binning.spread(df, action.column)
        out = binning.transform(df, action.column, action.action, action.n_bin)
    sink(out, action.output_path, "csv", mode)
    return out
