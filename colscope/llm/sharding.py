"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into equal cells. Every shard owns the arcs before its virtual nodes; a row's cell is a hash of
its key. A shard takes its own rows clockwise up to its capacity, and the rows beyond continue clockwise to the
next shard with room. Only the number of rows in each cell (a fixed number of cells) reaches the driver, which
works out which ranks of a cell go where. Rows that are alike are counted before they are dealt, ranked together and
given out in pieces, and a cell is ranked in ``PARTS`` parts by checksum, so no key and no group of copies fills a task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Parts of a cell that are ranked by themselves, and like rows that a task gives out at once.
PARTS, PIECE = 64, 10_000


def ring_owners(n_shards: int, vnodes: int, cells: int) -> list[int]:
    """The shard that owns each cell: that of the first virtual node at or after it, clockwise."""
    nodes: dict[int, tuple[bytes, int]] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"{shard}/{v}".encode()).digest()
            at = int.from_bytes(digest[:8]) % cells
            if at not in nodes or digest < nodes[at][0]:  # of nodes in one cell the smaller digest holds it
                nodes[at] = digest, shard
    owner = nodes[min(nodes)][1]
    owners = [0] * cells
    for at in reversed(range(cells)):
        owner = nodes[at][1] if at in nodes else owner
        owners[at] = owner
    return owners


def place(
    counts: list[int], owners: list[int], n_shards: int, epsilon: float
) -> list[tuple[int, int, int, int, int]]:
    """Segments ``(cell, from rank, to rank, shard, slot of the first)`` that respect every capacity.

    With ``epsilon`` 0 the capacities add up to the number of rows and differ by one at most, so all shards are
    full and their counts are at most one apart; else each is ``ceil((1 + epsilon) * rows / shards)``.
    """
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    if epsilon > 0:
        room = [max(r, -int(-(1 + epsilon) * total // n_shards)) for r in room]
    used = [0] * n_shards
    segments, over = [], []

    def put(cell: int, rank: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n > 0:
            segments.append((cell, rank, rank + n, shard, used[shard]))
            used[shard] += n
        return max(n, 0)

    for cell, n in enumerate(counts):
        done = put(cell, 0, n, owners[cell])
        if done < n:
            over.append((cell, done, n - done))
    for cell, rank, n in over:
        at = cell
        while n:
            at = (at + 1) % len(owners)
            done = put(cell, rank, n, owners[at])
            rank, n = rank + done, n - done
            if at == cell and n:  # no virtual node leads to a shard that has room
                for shard in range(n_shards):
                    done = put(cell, rank, n, shard)
                    rank, n = rank + done, n - done
    return segments


def shard_bounded(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n_shards: int = 16,
    vnodes: int = 64,
    cells: int = 4096,
    epsilon: float = 0.0,
) -> DataFrame:
    """Give every row a shard and a gapless slot in it: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 length of the text plus 1 and ``text_crc32`` its CRC-32 (null texts count as empty).
    ``law`` is ``rows``: with ``epsilon`` 0 the counts of any two shards differ by one at most; ``grown_shard``
    is null, as loads depend on all rows. Rows with a null key are placed by their text; rows that are equal in key,
    size and checksum are interchangeable, so ties and repeated rows, which all stay, never change the table that results.
    An empty table gives no rows. Extra columns are ignored.
    """
    owners = ring_owners(n_shards, vnodes, cells)
    content = F.coalesce(F.col(text), F.lit(""))
    # Rows without a key would all have one place, so theirs follows from the text.
    name = F.coalesce(F.concat(F.lit("key/"), F.col(key).cast("string")), F.concat(F.lit("text/"), content))
    rows = written(
        df.select(
            F.col(key).alias("key"),
            (F.octet_length(content).cast("long") + 1).alias("size"),
            F.crc32(content).cast("long").alias("text_crc32"),
            F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("position"),
        )
        .withColumn("cell", F.pmod("position", F.lit(cells)).cast("int"))
        .withColumn("part", F.pmod("text_crc32", F.lit(PARTS)).cast("int"))
    )
    sizes = written(rows.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")))  # a bounded number of rows
    found = {r["cell"]: r["n"] for r in sizes.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    segments = place([found.get(c, 0) for c in range(cells)], owners, n_shards, epsilon)
    # About as many rows as there are cells and shards.
    plan = df.sparkSession.createDataFrame(segments, "cell int, first long, until long, shard int, base long")
    earlier = F.sum("n").over(Window.partitionBy("cell").orderBy("part")) - F.col("n")
    offsets = sizes.select("cell", "part", earlier.alias("earlier"))
    order = ["position", "key", "size", "text_crc32"]
    alike = rows.groupBy("cell", "part", *order).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(
        Window.partitionBy("cell", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = alike.withColumn("upto", upto).join(F.broadcast(offsets), ["cell", "part"])
    runs = ranked.withColumn("end", F.col("earlier") + F.col("upto")).withColumn("begin", F.col("end") - F.col("n"))
    placed = runs.join(
        F.broadcast(plan.withColumnRenamed("cell", "in_cell")),
        (F.col("cell") == F.col("in_cell")) & (F.col("begin") < F.col("until")) & (F.col("end") > F.col("first")),
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    taken = placed.select(
        "key",
        "size",
        "text_crc32",
        "shard",
        (F.col("base") + F.greatest("begin", "first") - F.col("first")).alias("slot"),
        (F.least("end", "until") - F.greatest("begin", "first")).alias("n"),
    )
    pieces = taken.filter(F.col("n") > PIECE).withColumn(
        "skip", F.explode(F.sequence(zero, F.col("n") - 1, F.lit(PIECE).cast("long")))
    )
    dealt = pieces.select(
        "key",
        "size",
        "text_crc32",
        "shard",
        (F.col("slot") + F.col("skip")).alias("slot"),
        F.least(F.col("n") - F.col("skip"), F.lit(PIECE)).alias("n"),
    ).repartition("shard", "slot")
    every = taken.filter(F.col("n") <= PIECE).unionByName(dealt)
    return every.withColumn("step", F.explode(F.sequence(zero, F.col("n") - one))).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot") + F.col("step")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
