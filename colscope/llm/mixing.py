"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent is found by
bisection (in sections of sixteen, so that one aggregate over the sources tries many): the smallest at which no
source is repeated more often than allowed, or the largest at which the weights reach a target entropy. Weights
times the token budget give each source a number of blocks. A block is a permutation of all of the source's rows
by a hash, and the last one ends where its budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_lookup, named, number, numbered, words, written

SECTIONS, ROUNDS = 16, 12
#: Rows in a range of the permutation, on average, when the end of a source's last block is sought.
RANGE_ROWS = 5_000


def order_key(key: Column, block: Column, seed: int) -> Column:
    """A row's place in a block's permutation: 60 bits of a digest."""
    text = F.concat_ws("/", F.lit(str(seed)), block.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_totals(rows: DataFrame) -> DataFrame:
    """``source, rows, tokens, share`` from ``rows (key, source, tokens)``; empty sources have a null share."""
    totals = written(
        rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens"))
    )
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    return totals.withColumn("share", F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(float(max(whole, 1)))))


def exponent(sources: DataFrame, max_repeats: float | None, target_entropy: float | None) -> float:
    """The exponent between 0 (all sources alike) and 1 (as they come) that meets the limit or the entropy.

    ``max_repeats`` holds for the smallest budget at which every source has one whole block: repeats are then the
    ratio of a source's weight per token to the least such ratio.
    """
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")
    if max_repeats is not None and max_repeats < 1:
        raise ValueError("max_repeats is 1 at least")

    def met(points: list[float]) -> list[bool]:
        """Whether the goal is met; with the limit for all exponents from some point on, with the entropy up to one."""
        p = F.col("share")
        if max_repeats is not None:
            columns = [F.max(F.pow(p, F.lit(a - 1))) / F.min(F.pow(p, F.lit(a - 1))) for a in points]
            row = sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
            return [v is None or v <= max_repeats for v in row]
        columns = [c for a in points for c in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
        row = sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        found = zip(points, row[::2], row[1::2], strict=True)
        return [z is None or math.log(z) - a * s / z >= target_entropy for a, z, s in found]

    low, high = 0.0, 1.0
    if max_repeats is not None and met([low])[0]:
        return low
    if target_entropy is not None and (met([high])[0] or not met([low])[0]):
        return high if met([high])[0] else low
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
        good = met(points)
        wanted = max_repeats is not None
        cut = next((i for i, g in enumerate(good) if g == wanted), len(points))
        ends = [low, *points, high]
        low, high = ends[cut], ends[cut + 1]
    return high if max_repeats is not None else low


def plan(
    rows: DataFrame,
    max_repeats: float | None = 2.0,
    target_entropy: float | None = None,
    budget: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """For each source of ``rows (key, source, tokens)`` its ``weight, epochs, blocks`` (whole ones) and ``until``, the
    last order key of the block after them (null: none).

    Without ``budget`` it is the smallest that gives every source one whole block, so no row is left out. Sources
    without tokens have weight 0 and one block.
    """
    sources = source_totals(rows)
    a = exponent(sources, max_repeats, target_entropy)
    power = F.pow(F.col("share"), F.lit(a))
    figures = sources.agg(
        F.sum(power), F.min(power / F.col("share")), F.sum("tokens"), F.max("rows")
    ).first()
    z, least, tokens, most_rows = figures[0] or 1.0, figures[1] or 1.0, figures[2] or 0, figures[3] or 0
    per_token = 1 / least if budget is None else budget / max(tokens, 1) / z
    epochs = F.coalesce(power / F.col("share") * F.lit(per_token), F.lit(1.0))
    # A millionth of a block, such as rounding may leave, is none.
    planned = sources.withColumn(
        "weight", F.coalesce(power / F.lit(z), F.lit(0.0))
    ).withColumn("epochs", epochs).withColumn(
        "blocks", F.floor(F.col("epochs") + F.lit(1e-6)).cast("long")
    )
    planned = written(
        planned.withColumn(
            "part",
            F.greatest(F.round((F.col("epochs") - F.col("blocks")) * F.col("tokens"), 0), F.lit(0.0)).cast("long"),
        )
    )
    bits = min(max(math.ceil(math.log2(max(most_rows, 1) / RANGE_ROWS)), 4), 20) if most_rows > RANGE_ROWS else 4
    partial = planned.filter("part > 0").select("source", "blocks", "part")
    keyed = join_lookup(rows, partial, "source").filter(F.col("part").isNotNull()).withColumn(
        "order_key", order_key(F.col("key"), F.col("blocks"), seed)
    )
    keyed = written(
        keyed.withColumn("range", F.shiftright("order_key", 60 - bits)).select(
            "source", "part", "range", "order_key", "tokens"
        )
    )
    ranges = keyed.groupBy("source", "part", "range").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("range")) - F.col("tokens")
    crossing = written(
        ranges.withColumn("before", before).filter(F.col("before") < F.col("part")).groupBy("source").agg(
            F.max_by(F.struct("range", "before"), "range").alias("last")
        ).select("source", F.col("last.range").alias("last"), "last.before")
    )
    inside = join_lookup(keyed, crossing, "source").filter(F.col("range") == F.col("last"))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("order_key")) - F.col("tokens")
    ends = inside.withColumn(
        "at", F.col("before") + running
    ).filter(F.col("at") < F.col("part")).groupBy("source").agg(
        F.max("order_key").alias("until")
    )
    return written(planned.join(ends, "source", "left").select("source", "weight", "epochs", "blocks", "until"))


def narrow(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key, source, tokens`` of every row; tokens are words, a null source is the empty one."""
    return written(
        df.select(
            F.col(key).alias("key"),
            F.coalesce(F.col(source), F.lit("")).alias("source"),
            F.size(words(F.col(text))).cast("long").alias("tokens"),
        )
    )


def _blocks(rows: DataFrame, sources: DataFrame, key: str, seed: int) -> DataFrame:
    """Each row once for every block that has it. Columns that are added have ``__`` in front."""
    planned = sources.select(*[F.col(c).alias(f"__{c}") for c in sources.columns])
    found = join_lookup(rows, planned, "__source")
    last = F.col("__until").isNotNull() & (order_key(F.col(key), F.col("__blocks"), seed) <= F.col("__until"))
    upto = F.col("__blocks") - F.when(last, F.lit(0)).otherwise(F.lit(1))
    numbers = F.when(upto >= 0, F.sequence(F.lit(0).cast("long"), upto)).otherwise(F.array().cast("array<long>"))
    return found.withColumn("__block", F.explode(numbers)).withColumn(
        "__order_key", order_key(F.col(key), F.col("__block"), seed)
    )


def mixture(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_repeats: float | None = 2.0,
    target_entropy: float | None = None,
    budget: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """One row for each time that a row of ``df`` is in the mixture: ``key, source, n_tokens, weight, epochs, block,
    order_key``. Read source by source in order of ``block, order_key``, it is a sequence of block permutations.

    Null texts have no tokens, null sources are the empty one, null keys are placed alike, repeated rows each count
    and keep together in a permutation. An empty table gives no rows; extra columns are ignored.
    """
    rows = narrow(df, key, text, source)
    sources = plan(rows, max_repeats, target_entropy, budget, seed)
    out = _blocks(rows.withColumnRenamed("source", "__source"), sources, "key", seed)
    return out.select(
        F.col("key").alias(key),
        F.col("__source").alias("source"),
        F.col("tokens").alias("n_tokens"),
        F.col("__weight").alias("weight"),
        F.col("__epochs").alias("epochs"),
        F.col("__block").alias("block"),
        F.col("__order_key").alias("order_key"),
    )


def mixed_rows(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_repeats: float | None = 2.0,
    target_entropy: float | None = None,
    budget: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """The mixture itself: the rows of ``df``, with its columns, whatever their names, as often as they are in it.

    Nulls, ties, repeated rows and empty tables are as in ``mixture``; null and empty texts, which have no tokens, stay.
    """
    rows, key, text, source = numbered(df), *(number(df, c) for c in (key, text, source))
    sources = plan(narrow(rows, key, text, source), max_repeats, target_entropy, budget, seed)
    return named(_blocks(rows.withColumn("__source", F.coalesce(F.col(source), F.lit(""))), sources, key, seed), df)
