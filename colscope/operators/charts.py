"""The data of charts, aggregated before anything could be drawn.

The kind follows from the columns' types: counts of one category, a histogram of one number, boxes of a number by a
category, points of two or three numbers, and of two numbers by a category. Rows with a null in any of the columns
take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import meet_groups, quantiles
from ..functions.types import is_categorical, is_numeric, require_categorical, require_numeric
from ..sources.shared import shared_dir


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).dropna("any")


def chart_kind(df: DataFrame, columns: Sequence[str]) -> str:
    """``count, hist, scatter, box, scatter_hue`` or ``bubble``; ``ValueError`` if no chart fits the columns."""
    numbers = [c for c in columns if is_numeric(df, c)]
    categories = [c for c in columns if is_categorical(df, c)]
    kinds = {
        (0, 1): "count", (1, 0): "hist", (2, 0): "scatter", (1, 1): "box", (2, 1): "scatter_hue", (3, 0): "bubble"
    }
    if len(numbers) + len(categories) != len(columns) or (len(numbers), len(categories)) not in kinds:
        raise ValueError(
            f"no chart for {', '.join(f'{c} {df.schema[c].dataType.simpleString()}' for c in columns) or 'no columns'}"
        )
    return kinds[len(numbers), len(categories)]


def count_chart(df: DataFrame, column: str) -> DataFrame:
    """``value, count``."""
    require_categorical(df, column)
    return _complete(df, [column]).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def _bin_width(whole: bool) -> Column:
    """The smaller of the Freedman-Diaconis width (at least half the square-root width) and Sturges' width; whole
    numbers have bins of one at least; 0 if all values are equal."""
    span, n = F.col("high") - F.col("low"), F.col("n")
    fd = 2 * (F.col("q3") - F.col("q1")) * F.pow(n, F.lit(-1 / 3))
    width = F.least(F.greatest(fd, span / F.sqrt(n) / 2), span / (F.log2(n) + 1))
    return F.when(span <= 0, F.lit(0.0)).otherwise(F.greatest(width, F.lit(1.0)) if whole else width)


def histogram_bins(df: DataFrame, column: str) -> DataFrame:
    """One row: ``n, low, high, bins`` and the ``width`` of each."""
    require_numeric(df, column)
    x = F.col(column).cast("double")
    rows = df.filter(F.col(column).isNotNull())
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
    found = ends.crossJoin(F.broadcast(quantiles(rows, column, [("q1", 0.25, "linear"), ("q3", 0.75, "linear")])))
    whole = not isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))
    sized = found.filter("n > 0").withColumn("w", _bin_width(whole)).withColumn(
        "bins",
        F.when(F.col("w") > 0, F.ceil((F.col("high") - F.col("low")) / F.col("w"))).otherwise(F.lit(1)).cast("long"),
    )
    return sized.select("n", "low", "high", "bins", ((F.col("high") - F.col("low")) / F.col("bins")).alias("width"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """``bin, lower, upper, count`` for all bins, empty ones too; the highest value is in the last."""
    bins = histogram_bins(df, column)
    x = F.col(column).cast("double")
    at = F.when(
        F.col("width") > 0, F.least(F.floor((F.col("x") - F.col("low")) / F.col("width")), F.col("bins") - 1)
    ).otherwise(F.lit(0)).cast("long")
    counts = df.select(x.alias("x")).dropna().crossJoin(F.broadcast(bins)).groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    every = bins.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"), "low", "width")
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def density(df: DataFrame, column: str, points: int = 200, cells: int = 2048, cut: float = 3.0) -> DataFrame:
    """``x, density``: a Gaussian kernel estimate with Scott's bandwidth on a grid ``cut`` bandwidths beyond the values.

    Values are first counted in ``cells`` cells of equal width, so that no more than ``points`` times ``cells``
    kernels are added up. A constant column has no estimate.
    """
    require_numeric(df, column)
    rows = df.select(F.col(column).cast("double").alias("v")).dropna()
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("s")
    ).filter("s > 0").withColumn("h", F.col("s") * F.pow("n", F.lit(-0.2)))
    wide = (F.col("high") - F.col("low")) / F.lit(cells)
    cell = F.least(F.floor((F.col("v") - F.col("low")) / wide), F.lit(cells - 1))
    binned = rows.crossJoin(F.broadcast(one)).groupBy(
        "n", "low", "high", "h", cell.alias("cell")
    ).agg(F.count(F.lit(1)).alias("c"))
    start, length = F.col("low") - cut * F.col("h"), F.col("high") - F.col("low") + 2 * cut * F.col("h")
    grid = binned.select(
        "n",
        "h",
        "c",
        (F.col("low") + (F.col("cell") + 0.5) * wide).alias("centre"),
        start.alias("start"),
        length.alias("length"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"),
    )
    x = F.col("start") + F.col("length") * F.col("i") / F.lit(points - 1)
    kernel = F.col("c") * F.exp(-F.pow((x - F.col("centre")) / F.col("h"), F.lit(2)) / 2) / (
        F.col("n") * F.col("h") * F.sqrt(F.lit(2 * 3.141592653589793))
    )
    return grid.groupBy("i").agg(F.max(x).alias("x"), F.sum(kernel).alias("density")).drop("i")


def histogram_curve(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """``x, count``: the density that goes with a histogram, from the lowest value to the highest, in counts of its bins."""
    bins = histogram_bins(df, column).select(F.col("n").cast("double") * F.col("width"))
    return density(df, column, points, cut=0.0).crossJoin(F.broadcast(bins.toDF("area"))).select(
        "x", (F.col("density") * F.col("area")).alias("count")
    )


def points(df: DataFrame, columns: Sequence[str], fraction: float | None = None, seed: int = 0) -> DataFrame:
    """The points of a scatter or bubble chart. ``fraction`` samples them, for tables of more than can be drawn."""
    rows = _complete(df, columns)
    return rows if fraction is None else rows.sample(fraction, seed)


def boxes(df: DataFrame, category: str, number: str) -> DataFrame:
    """By category ``n, q1, median, q3, whisker_low, whisker_high, fliers``: quartiles interpolate, whiskers are the
    outermost values within 1.5 interquartile ranges of the box, and fliers count what lies beyond."""
    require_categorical(df, category)
    require_numeric(df, number)
    rows = _complete(df, [category, number]).select(
        F.col(category).alias("category"), F.col(number).cast("double").alias("x")
    )
    box = quantiles(
        rows, "x", [("q1", 0.25, "linear"), ("median", 0.5, "linear"), ("q3", 0.75, "linear")], ["category"]
    )
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("x") >= F.col("q1") - spread) & (F.col("x") <= F.col("q3") + spread)
    shared_dir(df.sparkSession)
    seen = meet_groups(rows, box.checkpoint(), ["category"])
    return seen.groupBy("category", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"),
    )


def chart_data(df: DataFrame, columns: Sequence[str], fraction: float | None = None) -> tuple[str, DataFrame]:
    """The kind of chart that fits the columns, and its data."""
    kind = chart_kind(df, columns)
    numbers = [c for c in columns if is_numeric(df, c)]
    categories = [c for c in columns if c not in numbers]
    if kind == "count":
        return kind, count_chart(df, categories[0])
    if kind == "hist":
        return kind, histogram(df, numbers[0])
    if kind == "box":
        return kind, boxes(df, categories[0], numbers[0])
    return kind, points(df, [*numbers, *categories], fraction)
