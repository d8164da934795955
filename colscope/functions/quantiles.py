"""Exact quantiles without sorting a table in one place.

A first pass sketches, for each group and probability, two values around the quantile; its result is small and held. A
second one counts the rows below the lower of them and keeps the few rows between the two; their distinct values are put
in order, by group and cell of the bracket, and the wanted ranks are read off. Both aggregate before they shuffle, so no
task holds a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: The sketch's ranks are off by one in ACCURACY of a group's rows at most; the bracket allows for several times that.
#: A group of under SMALL rows, where single ranks count, is all in the bracket.
ACCURACY, SLACK, SMALL = 10_000, 0.0008, 10_000
#: What is in a bracket is put in order in so many cells of equal width, each by itself.
CELLS = 512
#: Groups up to so many, and up to so many bytes of their names, are broadcast; beyond, rows meet them in SALTS parts.
GROUPS, GROUP_BYTES, SALTS = 10_000, 32 << 20, 16


def nearest_rank(n: Column, q: float) -> tuple[Column, Column, Column]:
    """Ranks (from 0) on either side of the quantile and the weight of the upper one: the nearest row."""
    at = F.floor((n - 1) * F.lit(q) + F.lit(0.5))
    return at, at, F.lit(0.0)


def linear_rank(n: Column, q: float) -> tuple[Column, Column, Column]:
    """As ``nearest_rank``, with linear interpolation between two rows."""
    exact = (n - 1) * F.lit(q)
    low = F.floor(exact)
    return low, F.ceil(exact), exact - low


RULES = {"nearest": nearest_rank, "linear": linear_rank}


def sketch_columns(value: Column, wanted: Sequence[tuple[str, float, str]]) -> list[Column]:
    """Aggregates ``n`` and ``b``: how many values there are, and two around each quantile."""
    ends = [p for _, q, _ in wanted for p in (max(0.0, q - SLACK), min(1.0, q + SLACK))]
    around = F.percentile_approx(value, F.array(*[F.lit(p) for p in ends]), F.lit(ACCURACY))
    whole = F.array(*[F.min(value), F.max(value)] * len(wanted))
    return [F.count(value).alias("n"), F.when(F.count(value) < SMALL, whole).otherwise(around).alias("b")]


def constants(df: DataFrame, found: Row) -> dict[str, Column]:
    """The columns of a row that the driver has read, as constants of their types."""

    def constant(v, kind: str) -> Column:
        return (F.array(*[F.lit(e) for e in v]) if isinstance(v, list) else F.lit(v)).cast(kind)

    return {name: constant(found[name], kind).alias(name) for name, kind in df.dtypes}


def one_row(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A table of one row of constants."""
    return df.sparkSession.range(1).select(*columns.values())


def meet_groups(rows: DataFrame, groups: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows with what the table ``groups``, which is held and has one row a group, says of theirs; null keys match.
    No task gets all rows of a group that many rows have."""
    names = [F.octet_length(F.col(k).cast("string")) for k in on]
    n, size = groups.agg(F.count(F.lit(1)), F.sum(sum((F.coalesce(x, F.lit(0)) for x in names), F.lit(0)))).first()
    renamed = groups.withColumnsRenamed({k: f"{k}r" for k in on})
    same = reduce(and_, [rows[k].eqNullSafe(renamed[f"{k}r"]) for k in on])
    if n <= GROUPS and (size or 0) <= GROUP_BYTES:
        return rows.join(F.broadcast(renamed), same).drop(*[f"{k}r" for k in on])
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    many = renamed.withColumn("__saltr", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = salted.join(many, same & (F.col("__salt") == F.col("__saltr")))
    return found.drop("__salt", "__saltr", *[f"{k}r" for k in on])


def quantiles(
    df: DataFrame,
    column: str,
    wanted: Sequence[tuple[str, float, str]],
    by: Sequence[str] = (),
    sketch: dict[str, Column] | None = None,
) -> DataFrame:
    """One row a group with ``name`` for each ``(name, probability, rule)``; without ``by`` one row in all.

    Nulls take no part; a group without other values, and an empty table, have nulls. Values come as doubles; null
    is a group like any other. The first pass runs when this is called: without ``by`` its single row is read by the
    driver (or given as ``sketch``, its constants ``n`` and ``b``), with it the table of groups is checkpointed.
    """
    value = F.col(column).cast("double")
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], value.alias("x"))
    valued = rows.filter("x IS NOT NULL")
    sketched = rows.groupBy(*keys).agg(*sketch_columns(F.col("x"), wanted))
    if keys:
        shared_dir(df.sparkSession)
        sketch = sketched.checkpoint()
        seen = meet_groups(valued, sketch, keys)
    else:
        known = constants(sketched, sketched.first()) if sketch is None else sketch
        sketch, seen = one_row(df, known), valued.withColumns(known)

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """A join in which null keys match, of single rows where there are no keys."""
        if not on:
            return left.crossJoin(F.broadcast(right))
        renamed = right.withColumnsRenamed({k: f"{k}r" for k in on})
        same = reduce(and_, [left[k].eqNullSafe(renamed[f"{k}r"]) for k in on])
        return left.join(renamed, same, "left").drop(*[f"{k}r" for k in on])

    x, numbers = F.col("x"), range(len(wanted))
    low = [F.col("b")[2 * i] for i in numbers]
    high = [F.col("b")[2 * i + 1] for i in numbers]
    # Each row counts once by how many lower ends are above it (as i = -1), and in every bracket that it is in.
    above = sum(((x < low[i]).cast("int") for i in numbers), F.lit(0))
    inside = [F.when((x >= low[i]) & (x <= high[i]), F.lit(i)).otherwise(F.lit(-2)) for i in numbers]
    places = F.array_remove(F.array(F.lit(-1), *inside), -2)  # in generated code, as a filter would not be
    low_i, high_i = F.col("b")[2 * F.col("i")], F.col("b")[2 * F.col("i") + 1]
    cell = (
        F.when(F.isnan("x"), F.lit(CELLS).cast("long"))
        .when(low_i < high_i, F.floor((x - low_i) / (high_i - low_i) * (CELLS - 1)))
        .otherwise(F.lit(0).cast("long"))
    )
    slot = [*keys, "i", "cell"]
    counted = (
        seen.select(*keys, "x", "b", above.alias("above"), F.explode(places).alias("i"))
        .groupBy(
            *keys,
            "i",
            F.when(F.col("i") < 0, F.col("above").cast("long")).otherwise(cell).alias("cell"),
            F.when(F.col("i") >= 0, F.col("x")).alias("x"),
        )
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # A row is below the lower end of i if it has as many above it as there are that are no lower.
    rank = [sum(((low[k] >= low[i]).cast("int") for k in numbers), F.lit(0)) for i in numbers]
    # All that follows takes all of this table, so that it is made once.
    tallied = met(counted.select(*keys, "i", "cell", "c"), sketch, keys)
    counts = [F.sum(F.when((F.col("i") < 0) & (F.col("cell") >= rank[i]), F.col("c")).otherwise(F.lit(0))).alias(f"c{i}") for i in numbers]
    below = tallied.groupBy(*keys).agg(*counts)
    cells = counted.groupBy(*slot).agg(F.sum("c").alias("s"))
    earlier = F.sum("s").over(Window.partitionBy(*keys, "i").orderBy("cell")) - F.col("s")
    upto = F.sum("c").over(Window.partitionBy(*slot).orderBy("x"))
    ranked = met(counted.withColumn("upto", upto), cells.select(*slot, earlier.alias("earlier")), slot)
    ranked = met(met(ranked, below, keys), sketch.select(*keys, "n"), keys)
    missed = F.get(F.array(*[f"c{i}" for i in numbers]), F.col("i"))
    ranked = ranked.withColumn("upto", F.col("upto") + F.col("earlier") + missed)
    parts = []
    for i, (_, q, rule) in enumerate(wanted):
        for name, rank in zip((f"l{i}", f"h{i}"), RULES[rule](F.col("n"), q), strict=False):
            holds = (F.col("i") == i) & (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
            parts.append(F.max(F.when(holds, x)).alias(name))
    found = ranked.groupBy(*keys).agg(*parts) if keys else ranked.agg(*parts)
    out = met(sketch, found, keys) if keys else sketch.crossJoin(F.broadcast(found))
    results = []
    for i, (name, q, rule) in enumerate(wanted):
        weight = RULES[rule](F.col("n"), q)[2]
        lower, upper = F.col(f"l{i}"), F.col(f"h{i}")
        exact = F.when(lower == upper, lower).otherwise(lower + (upper - lower) * weight)
        checked = F.when(F.col("n") == 0, F.lit(None).cast("double")).when(
            lower.isNull() | upper.isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        ).otherwise(exact)
        results.append(checked.alias(name))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *results)
