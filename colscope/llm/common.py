"""Pieces shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Words are maximal runs of anything but U+0020 and U+0009..U+000D.
SPACE_CLASS = "[ \\t-\\r]+"

#: Lookup tables up to this size, as measured, are broadcast.
BROADCAST_BYTES = 32 << 20

#: Rows that a key may have, and the share of all rows (one in so many), before joins deal it to many tasks.
HOT_ROWS, HOT_SHARE = 1000, 2000

#: Arrow batches hold whole texts, in the engine and in Python, so they are limited by bytes.
BATCH_LIMIT, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), str(4 << 20)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch from its default; another limit that was set stays."""
    if str(spark.conf.get(BATCH_LIMIT)).rstrip("b") == BATCH_DEFAULT:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body's lambdas use it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders, wherever the session's file systems have them."""
    for path in paths:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``written`` makes within the block are deleted at its end, also if it fails; others are not touched."""
    paths: list[str] = []
    outer = _tables.set(paths)
    try:
        yield paths
    finally:
        _tables.reset(outer)
        delete(spark, *paths)


def written(df: DataFrame, label: str = "rows") -> DataFrame:
    """A table written once as Parquet in the shared folder and read back, which cuts its lineage: nothing before it is
    planned or computed again, and what reads it takes the columns it needs. It stays, unless written within a
    ``scratch`` block."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if (tables := _tables.get()) is not None:
        tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """The table with columns ``c0``, ``c1`` and so on, so that columns an operator adds can't clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def number(df: DataFrame, column: str) -> str:
    """What ``numbered`` calls a column."""
    return f"c{df.columns.index(column)}"


def named(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, out of what became of ``numbered(like)``."""
    return df.select(*[f"c{i}" for i in range(len(like.columns))]).toDF(*like.columns)


def hot_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The values of ``key`` that more than ``rows`` rows and one row in ``HOT_SHARE`` have, so ``HOT_SHARE`` at most."""
    counts = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") > max(rows, total // HOT_SHARE)).select(key)


def join_hot(df: DataFrame, lookup: DataFrame, key: str, hot: DataFrame | None = None, salts: int = 32) -> DataFrame:
    """Left join of a table with one that is unique by ``key`` and may be as large, without a task that gets all rows
    of a hot key: those are dealt by the order in which they are read as well, and met by copies of their one match.
    ``hot`` has the keys, at most some thousand; without it they are counted. ``df`` should be a table that is read from
    files, as rows then keep their order if a task is run again."""
    hot = F.broadcast((hot_keys(df, key, HOT_ROWS) if hot is None else hot).withColumn("__hot", F.lit(True)))
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    left = df.withColumn("__turn", turn).join(hot, key, "left")
    left = left.withColumn("__salt", F.when(F.col("__hot"), F.col("__turn")).otherwise(F.lit(0)))
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(hot, key, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(right, [key, "__salt"], "left").drop("__salt", "__turn", "__hot")


def join_lookup(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of a large, possibly skewed table with a lookup table unique by ``key``, which is measured first: up to
    ``BROADCAST_BYTES`` it is broadcast, beyond that ``join_hot`` joins them. Null keys match no row."""
    texts = [F.octet_length(c) for c, kind in lookup.dtypes if kind == "string"]
    size = F.lit(64) + sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(0))
    if (lookup.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(lookup), key, "left")
    return join_hot(df, lookup, key)
