"""SimHash near-dedup by anchor-point covering.

A table is a choice of bits of the fingerprint. Its anchors are a covering code on these bits: the perfect Hamming code
of length 15 times all values of the others, covering radius 1. A fingerprint's home is its nearest anchor, and it is
sent to every anchor within covering radius plus threshold 1 (a word's distance from the anchor counts in the Hamming
bits beyond the radius). So the home of either of two fingerprints that differ in one of the table's bits has both;
and two that differ in two of them have, between them, a word that differs in one bit from either, and both are sent
to its home. At each anchor those that share it are compared on all bits. Of the links that a task finds it emits a
spanning forest.

Which tables there are depends on how many bits may differ and on how many fingerprints there are:

- Four of 64 bits leave one of three thirds with a difference of one at most, so three tables find all links, comparing
  those at home with all. From ``MANY`` fingerprints on, where anchors of a third would be crowded, six tables have two
  of four quarters each; the best two differ in two bits at most, and all at an anchor are compared.
- For a similarity of shingles (Jaccard) fingerprints have 128 bits, of which a share follows from the angle between
  the shingle sets. Tables are cut from random orders of the bits, with more bits the more fingerprints there are, and
  there are as many as find a pair of just that similarity with probability ``RECALL``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, join_hot, join_lookup, named, number, numbered, small_batches, written
from .components import components
from .vector_text import U64, mixed, read_words, slices, xxh64

#: Words in a shingle and bits that may differ, where no similarity is given.
SHINGLE, DISTANCE = 4, 4
HAMMING = 15
#: Fingerprints from which thirds are too few bits, and the probability that tables find a pair of the least similarity.
MANY, RECALL = 16_000_000, 0.95
#: Pairs that are compared at once in memory, and copies that are sent to a place: at least, and at most.
PAIRS, COPIES, MOST_COPIES = 1 << 18, 400_000, 3_200_000


class Scheme(NamedTuple):
    """64-bit ``words`` of a fingerprint, how many bits may differ, the bits of each table, and whether all at an anchor
    are compared, not only those at home with all."""

    words: int
    most: int
    tables: tuple[tuple[int, ...], ...]
    all_pairs: bool


def by_distance(n: int) -> Scheme:
    """Finds all links of ``n`` fingerprints of 64 bits at ``DISTANCE``."""
    if n < MANY:
        return Scheme(1, DISTANCE, tuple(tuple(range(a, z)) for a, z in ((0, 22), (22, 43), (43, 64))), False)
    quarters = [tuple(range(a, a + 16)) for a in range(0, 64, 16)]
    return Scheme(1, DISTANCE, tuple(a + b for a, b in combinations(quarters, 2)), True)


def by_similarity(n: int, similarity: float) -> Scheme:
    """Finds links of ``n`` fingerprints of 128 bits that differ in no more than sets of this similarity do on average."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(max(math.ceil(math.log2(max(n, 1))) + 1, 18), 32)
    found = sum(math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(3))
    rng, tables = random.Random(0), []
    while 1 - (1 - found) ** len(tables) < RECALL:
        order = rng.sample(range(128), 128)
        tables += [tuple(order[a : a + bits]) for a in range(0, 128 - bits + 1, bits)]
    while 1 - (1 - found) ** (len(tables) - 1) >= RECALL:
        tables.pop()
    return Scheme(2, int(128 * differ), tuple(tables), True)


def fingerprints(texts: list[str | None], k: int = SHINGLE, words: int = 1) -> np.ndarray:
    """A bit is set if it is in over half the hashes of the k-word shingles, repeats included; without words, 0. One row
    a text, of so many 64-bit ``words``; those after the first are made from mixed hashes."""
    w = read_words(texts, lower=True)
    counts = np.diff(w.first)
    out = np.zeros((len(texts), words), U64)
    text_of = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(w.start)) - w.first[text_of]
    heads = np.flatnonzero((number + k <= counts[text_of]) | (number == 0))
    if not len(heads):
        return out
    last = np.minimum(heads + k, w.first[text_of[heads] + 1]) - 1
    h = xxh64(w.buffer, w.start[heads], w.end[last])
    owner = text_of[heads]
    texts_with = np.flatnonzero(counts)
    n = np.maximum(counts[texts_with] - k + 1, 1)
    begins = np.cumsum(n) - n
    # Byte lanes hold at most 255, so lanes are summed over runs of that many hashes first.
    runs = -(-n // 255)
    run_of = np.repeat(np.arange(len(texts_with)), runs)
    run_no = np.arange(len(run_of)) - np.repeat(np.cumsum(runs) - runs, runs)
    run_starts = begins[run_of] + 255 * run_no
    firsts = np.cumsum(runs) - runs
    assert len(owner) == int(n.sum())
    for word in range(words):
        hashes = mixed(h, word) if word else h
        result = np.zeros(len(texts_with), U64)
        for bit in range(8):
            lanes = np.add.reduceat((hashes >> U64(bit)) & U64(0x0101010101010101), run_starts)
            sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), firsts)
            for byte in range(8):
                result |= (2 * sums[:, byte] > n).astype(U64) << U64(8 * byte + bit)
        out[texts_with, word] = result
    return out


def numbers(fp: np.ndarray) -> np.ndarray:
    """A 64-bit number for each fingerprint: itself, or a hash of its words if it has several."""
    out = fp[:, 0]
    for word in range(1, fp.shape[1]):
        out = mixed(out, 11) ^ fp[:, word]
    return out


def fingerprint_table(df: DataFrame, key: str, text: str, k: int = SHINGLE, words: int = 1) -> DataFrame:
    """``key, fp, bits`` of every row, its number and all its words; texts are read whole, in slices of bounded size, and
    never shuffled."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            fp = fingerprints(b.column(1).to_pylist(), k, words)
            bits = pa.array([x.tobytes() for x in fp] if words > 1 else [None] * len(fp), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(numbers(fp).view(np.int64)), bits], names=["key", "fp", "bits"]
            )

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {df.schema[key].dataType.simpleString()}, fp long, bits binary"
    )


@cache
def _hamming_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word its nearest codeword, and the codewords within distance 2, the nearest first, then -1."""
    words = np.arange(1 << HAMMING)
    syndrome = np.zeros_like(words)
    for p in range(1, HAMMING + 1):
        syndrome ^= np.where(words >> (p - 1) & 1, p, 0)
    home = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    near = np.full((1 << HAMMING, 8), -1)
    near[:, 0] = home
    # Two flips lead to a codeword if their positions add up to the syndrome.
    for s in range(1, HAMMING + 1):
        pairs = [(a, a ^ s) for a in range(1, HAMMING + 1) if a < a ^ s <= HAMMING]
        at = np.flatnonzero(syndrome == s)
        for i, (a, b) in enumerate(pairs):
            near[at, 1 + i] = at ^ (1 << (a - 1)) ^ (1 << (b - 1))
    return home, near


def anchors(fp: np.ndarray, table: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """``anchor, which fingerprint, is it home`` for every copy that is sent for a table."""
    home, near = _hamming_tables()
    every = np.arange(len(fp))
    bits = np.zeros(len(fp), np.int64)
    for i, bit in enumerate(table):
        bits |= ((fp[:, bit // 64] >> U64(bit % 64)) & U64(1)).astype(np.int64) << i
    word, rest = bits & ((1 << HAMMING) - 1), bits >> HAMMING << HAMMING
    yield home[word] | rest, every, True
    for j in range(1, near.shape[1]):
        ok = np.flatnonzero(near[word, j] >= 0)
        yield near[word[ok], j] | rest[ok], ok, False
    for bit in range(HAMMING, len(table)):
        yield home[word] | (rest ^ (1 << bit)), every, False


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node but the smallest of a component to that one."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != (up := label[label])).any():
            label = up
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def linked(
    anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int = DISTANCE, all_pairs: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links, between ``numbers``, among fingerprints that share an anchor, as forests.

    Those at home, or all of them, are compared with all there, ``PAIRS`` at a time. Where an anchor has so many that
    this would take more than a few rounds, the reachable ones are searched breadth-first: a fingerprint that is reached
    is compared once with those not yet reached, so a dense group costs little more than its size.
    """
    order = np.argsort(anchor, kind="stable")
    anchor, fp, home = anchor[order], fp[order], home[order]
    node = numbers(fp)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]])
    sizes = np.diff(bounds)
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(anchor))
    if all_pairs:
        begins, small = place + 1, sizes * sizes <= 32 * PAIRS
        at = np.flatnonzero(small[group])
    else:
        begins, small = bounds[group], sizes * np.add.reduceat(home.astype(np.int64), bounds[:-1]) <= 16 * PAIRS
        at = np.flatnonzero(home & small[group])
    count = bounds[group + 1] - begins
    upto = np.cumsum(count[at])
    begin = 0
    while begin < len(at):
        base = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
        mine = at[begin:end]
        n = count[mine]
        left = np.repeat(mine, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[mine], n)
        hit = (distances(fp[left], fp[right]) <= most) & (node[left] != node[right])
        if hit.any():
            yield forest(node[left[hit]], node[right[hit]])
        begin = end
    for g in np.flatnonzero(~small):
        rest, first = np.unique(node[bounds[g] : bounds[g + 1]], return_index=True)
        bits = fp[bounds[g] : bounds[g + 1]][first]
        while len(rest):
            root, queue, rest, bits = rest[0], [bits[0]], rest[1:], bits[1:]
            found = []
            while queue and len(rest):
                close = distances(bits, queue.pop()) <= most
                if close.any():
                    queue += list(bits[close])
                    found.append(rest[close])
                    rest, bits = rest[~close], bits[~close]
            if found:
                reached = np.concatenate(found)
                yield reached, np.full(len(reached), root, U64)


def link_edges(unique: DataFrame, n_unique: int, scheme: Scheme) -> DataFrame:
    """``u, v``: forests over the unique fingerprints ``fp, bits`` that have the same components as all links."""
    tables = len(scheme.tables)
    copies = n_unique * sum(len(t) - 7 for t in scheme.tables)  # a word has about seven anchors but for its free bits
    places = max(16, copies // min(max(COPIES, copies // 6000), MOST_COPIES))  # copies are packed by place
    buckets = -(-places // tables)
    kind = np.dtype([("a", "<u4"), ("f", "<u8", (scheme.words,)), ("h", "?")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            if scheme.words == 1:
                fp = b.column(0).to_numpy().view(U64)[:, None]
            else:
                fp = np.frombuffer(b"".join(b.column(1).to_pylist()), U64).reshape(-1, scheme.words)
            parts = []
            for i, table in enumerate(scheme.tables):
                for anchor, which, is_home in anchors(fp, table):
                    rows = np.empty(len(which), kind)
                    rows["a"], rows["f"], rows["h"] = anchor, fp[which], is_home
                    bucket = mixed(anchor.astype(U64) + U64(i << 32), 1) % U64(buckets)
                    parts.append((bucket.astype(np.int64) * tables + i, rows))
            place, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(place, kind="stable")
            place, rows = place[order], rows[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place[cuts[:-1]]),
                    pa.array([rows[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ],
                names=["place", "sent"],
            )

    def compare(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("sent").to_pylist()), kind)
        found = list(linked(rows["a"], rows["f"], rows["h"], scheme.most, scheme.all_pairs))
        u = np.concatenate([x for x, _ in found]) if found else np.empty(0, U64)
        v = np.concatenate([x for _, x in found]) if found else np.empty(0, U64)
        if len(found) > 1:
            u, v = forest(u, v)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return unique.select("fp", "bits").mapInArrow(
        send, "place long, sent binary"
    ).groupBy("place").applyInArrow(compare, "u long, v long")


def _classes(
    df: DataFrame, key: str, text: str, shingle: int, similarity: float | None
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``key, fp`` of every row; ``fp, least, n, root`` of every fingerprint: its smallest key, its rows, and the root
    of its component, if it has links; ``root, component`` of those: the smallest key; and how many rows there are."""
    rows = written(fingerprint_table(df, key, text, shingle, 1 if similarity is None else 2))
    unique = written(
        rows.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.min("bits").alias("bits"))
    )
    n, total = unique.agg(F.count(F.lit(1)), F.sum("n")).first()
    scheme = by_distance(n) if similarity is None else by_similarity(n, similarity)
    roots = components(link_edges(unique, n, scheme))
    rooted = written(unique.drop("bits").join(roots.withColumnRenamed("node", "fp"), "fp", "left"))
    smallest = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component"))
    return rows.drop("bits"), rooted, written(smallest), total or 0


def simhash_components(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float | None = None,
) -> DataFrame:
    """``key, fp, component``: the number of every row's fingerprint and the smallest key its component has.

    Without ``similarity`` fingerprints have 64 bits and link at ``DISTANCE``, and no link is missed; with it, they have
    128 bits and link where these say that the shingle sets are as similar or more, which errs by chance.

    Texts that are null or have no words have fingerprint 0 and link like others; texts of any length are read whole.
    Rows with a null key link too; a component of such rows alone has a null ``component``. Repeated rows stay. Nothing
    depends on the order of rows. An empty table gives no rows. Extra columns are ignored.
    """
    rows, rooted, smallest, total = _classes(df, key, text, shingle, similarity)
    linked_ones = rooted.filter("root IS NOT NULL")
    single = rooted.filter("root IS NULL").select("fp", F.col("least").alias("component"))
    classes = written(join_lookup(linked_ones, smallest, "root").select("fp", "component").unionByName(single))
    hot = rooted.filter(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select("fp")
    return join_hot(rows, classes, "fp", hot).select(F.col("key").alias(key), "fp", "component")


def keep_one(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float | None = None,
) -> DataFrame:
    """One row of each component, with its own columns, whatever their names: that with the smallest key, null keys last,
    and of rows that share it the one with the smallest hash of all columns but maps. Of rows that are equal in these one
    stays. Null, empty and long texts are as in ``simhash_components``; an empty table stays empty."""
    inner, key, text = numbered(df), number(df, key), number(df, text)
    hashed = F.xxhash64(F.col(key).isNull(), *[F.col(c) for c, kind in inner.dtypes if "map" not in kind])
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), hashed.alias("hash"))
    # With fields that may be null, as the components have it: else the join casts and deals the texts once more.
    kind = f"struct<none:boolean,key:{inner.schema[key].dataType.simpleString()},hash:bigint>"
    marked = inner.withColumn("__row", row.cast(kind))
    _, rooted, smallest, _ = _classes(marked, "__row", text, shingle, similarity)
    kept = smallest.select(F.col("component").alias("__row")).unionByName(
        rooted.filter("root IS NULL").select(F.col("least").alias("__row"))
    )
    # Equal rows combine before they are dealt.
    return named(marked.dropDuplicates(["__row"]).join(kept, "__row", "left_semi"), df)
