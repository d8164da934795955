"""Substring dedup with difference-cover anchors.

A window of 13 words repeats if its words also start in a document with a smaller key. Two equal windows, at
whatever offsets, share an anchor: 7 words whose position in either document is 0, 1 or 3 modulo 7, as the
differences of 0, 1 and 3 cover all residues of 7. So only anchors are hashed and sent at first. Anchors that are
found in two documents or more return to where they came from, every window that holds such an anchor is extended
to its full 13 words, and these windows alone are sent with the smallest key that has them.

Words are hashed by XXH64 and windows told apart by 96 bits of two hashes over their words; anchors, where a false match
only costs a look, by 32 bits within a range.

Documents are dealt into blocks by a hash of key and text, so that no key fills a block; a block fits in a task. What
is sent is packed by block and hash range, each hash at most twice (anchors) or once (windows) a block, so a passage
that a third of all documents share arrives once from every block and never as one large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, number, numbered, small_batches
from .vector_text import U64, Words, mixed, read_words, release, xxh64

WINDOW, PERIOD, COVER, ANCHOR = 13, 7, (0, 1, 3), 7
#: Bytes of text in a block, and hashes in a range, on average: at least, and at most. Both grow with the input in
#: between, as there is a piece for each block and range.
BLOCK_BYTES, MOST_BLOCK_BYTES, RANGE_HASHES, MOST_RANGE_HASHES = 2 << 20, 32 << 20, 1 << 20, 8 << 20
BLOCKS, RANGES = 4096, 1365
#: Words that are hashed at once.
RUN_WORDS = 1 << 16
LAST = np.iinfo(np.int64).max


class Block(NamedTuple):
    """A block's words: ``key`` of each text (null: last), ``text_of`` and ``number`` (within its text) of each word."""

    words: Words
    key: np.ndarray
    text_of: np.ndarray
    number: np.ndarray
    left: np.ndarray
    word_hash: np.ndarray


def _word_hashes(w: Words) -> np.ndarray:
    """XXH64 of each word, ``RUN_WORDS`` at a time, so that little more than the words takes memory."""
    parts = [slice(a, a + RUN_WORDS) for a in range(0, len(w.start), RUN_WORDS)]
    return np.concatenate([np.empty(0, U64), *[xxh64(w.buffer, w.start[p], w.end[p]) for p in parts]])


def read_block(keys: list, texts: list[str | None]) -> Block:
    w = read_words(texts)
    counts = np.diff(w.first)
    text_of = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(w.start)) - w.first[text_of]
    return Block(
        w,
        np.array([LAST if k is None else k for k in keys], np.int64),
        text_of,
        number,
        counts[text_of] - number,
        _word_hashes(w),
    )


def runs(b: Block, at: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Hashes of the ``length`` words from each of ``at`` on; each ``salt`` is a hash function of its own."""
    odd = mixed(np.array([salt], U64), 99)[0] | U64(1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), U64)
        for k in range(length):
            h = h * odd + b.word_hash[at + k]
        return mixed(h, salt)


def anchor_places(b: Block) -> np.ndarray:
    """The words at which an anchor starts, in texts of a window at least."""
    long = np.diff(b.words.first)[b.text_of] >= WINDOW
    return np.flatnonzero(long & (b.left >= ANCHOR) & np.isin(b.number % PERIOD, COVER))


def range_and_hash(h: np.ndarray, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's range, and 32 other bits of its hash; as ranges hold few, hardly any two are taken for one."""
    return (h >> U64(32)) % U64(n_ranges), h.astype(np.uint32)


def block_anchors(b: Block, n_ranges: int) -> Iterator[tuple[int, bytes]]:
    """By range the block's anchors: once, or twice if two of its documents have one."""
    at = anchor_places(b)
    place, low = range_and_hash(runs(b, at, ANCHOR, 1), n_ranges)
    whole = place << U64(32) | low
    order = np.lexsort((b.key[b.text_of[at]], whole))
    whole, key = whole[order], b.key[b.text_of[at]][order]
    head = np.ones(len(whole), bool)
    head[1:] = whole[1:] != whole[:-1]
    firsts = np.flatnonzero(head)
    lasts = np.concatenate([firsts[1:], [len(whole)]])[: len(firsts)] - 1
    once = whole[firsts]
    twice = once[key[lasts] != key[firsts]] if len(firsts) else once
    both = np.sort(np.concatenate([once, twice]))
    yield from _packed(both >> U64(32), both.astype(np.uint32))


def _packed(place: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """``place`` is sorted; the bytes of what has each."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if z > a:
            yield int(place[a]), values[a:z].tobytes()


def shared_anchors(sent: list[bytes]) -> Iterator[bytes]:
    """Of each block's anchors those that two documents have."""
    every = np.sort(np.concatenate([np.frombuffer(s, np.uint32) for s in sent]))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    for s in sent:
        own = np.unique(np.frombuffer(s, np.uint32))
        yield own[np.isin(own, shared, assume_unique=True)].tobytes()


#: A window as a block sends it, with the smallest of its keys there and whether it has others; and as it returns:
#: whether all of the block's are later than another block's, or only those with other keys than the smallest.
WINDOW_KIND = np.dtype([("h", "<u8"), ("g", "<u4"), ("key", "<i8"), ("more", "?")])
LATER_KIND = np.dtype([("h", "<u8"), ("g", "<u4"), ("all", "?")])


def window_hashes(b: Block, at: np.ndarray) -> np.ndarray:
    return runs(b, at, WINDOW, 2)


def second_hashes(b: Block, at: np.ndarray) -> np.ndarray:
    return (runs(b, at, WINDOW, 3) >> U64(32)).astype(np.uint32)


def _grouped(h: np.ndarray, g: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by window and key, and in it where each window begins."""
    order = np.lexsort((key, g, h))
    h, g = h[order], g[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return order, head


def block_windows(
    b: Block, shared: dict[int, bytes], n_anchor_ranges: int, n_ranges: int
) -> Iterator[tuple[int, bytes]]:
    """By range the windows that hold a shared anchor, each with the block's smallest key that has it."""
    if not shared:
        return
    at = anchor_places(b)
    place, low = range_and_hash(runs(b, at, ANCHOR, 1), n_anchor_ranges)
    known = np.sort(
        np.concatenate([np.frombuffer(v, np.uint32).astype(U64) | U64(k << 32) for k, v in shared.items()])
    )
    whole = place << U64(32) | low
    hit = at[known[np.minimum(np.searchsorted(known, whole), len(known) - 1)] == whole]
    # A window that starts at s has the anchors that start at s to s + 6.
    steps = np.zeros(len(b.left) + 1, np.int64)
    np.add.at(steps, np.maximum(hit - (WINDOW - ANCHOR), hit - b.number[hit]), 1)
    np.add.at(steps, hit + 1, -1)
    start = np.flatnonzero((np.cumsum(steps[:-1]) > 0) & (b.left >= WINDOW))
    h, g, key = window_hashes(b, start), second_hashes(b, start), b.key[b.text_of[start]]
    order, head = _grouped(h, g, key)
    firsts = np.flatnonzero(head)
    lasts = np.concatenate([firsts[1:], [len(head)]])[: len(firsts)] - 1
    rows = np.empty(len(firsts), WINDOW_KIND)
    for name, values in (("h", h), ("g", g), ("key", key)):
        rows[name] = values[order[firsts]]
    rows["more"] = key[order[lasts]] != rows["key"]
    place = (mixed(rows["h"], 7) >> U64(32)) % U64(n_ranges)
    order = np.argsort(place, kind="stable")
    yield from _packed(place[order], rows[order])


def later_windows(sent: list[bytes]) -> Iterator[bytes]:
    """Of each block's windows those that a smaller key has, of another block or of its own."""
    rows = [np.frombuffer(s, WINDOW_KIND) for s in sent]
    every = np.concatenate(rows)
    order, head = _grouped(every["h"], every["g"], every["key"])
    least = np.empty(len(every), np.int64)
    least[order] = every["key"][order][np.flatnonzero(head)][np.cumsum(head) - 1]
    out = np.empty(len(every), LATER_KIND)
    out["h"], out["g"], out["all"] = every["h"], every["g"], least < every["key"]
    wanted = out["all"] | every["more"]
    at = np.cumsum([len(r) for r in rows])[:-1]
    for mine, chosen in zip(np.split(out, at), np.split(wanted, at), strict=True):
        yield mine[chosen].tobytes()


def removed_words(b: Block, later: list[bytes]) -> np.ndarray:
    """For each word whether a window covers it that starts in a document with a smaller key."""
    known = np.concatenate([np.empty(0, LATER_KIND), *[np.frombuffer(x, LATER_KIND) for x in later]])
    if not len(known):
        return np.zeros(len(b.left), bool)
    known = known[np.argsort(known["h"], kind="stable")]
    at = np.flatnonzero(b.left >= WINDOW)
    h = window_hashes(b, at)
    found = np.searchsorted(known["h"], h)
    hit = known["h"][np.minimum(found, len(known) - 1)] == h
    at, h, found = at[hit], h[hit], found[hit]
    g = second_hashes(b, at)
    gone, own = np.zeros(len(at), bool), np.zeros(len(at), bool)
    while True:  # more than once only if windows that differ have one first hash
        here = np.minimum(found, len(known) - 1)
        same = (found < len(known)) & (known["h"][here] == h)
        if not same.any():
            break
        equal = same & (known["g"][here] == g)
        gone |= equal & known["all"][here]
        own |= equal & ~known["all"][here]
        found = found + 1
    local = np.flatnonzero(own)
    key = b.key[b.text_of[at[local]]]
    order, head = _grouped(h[local], g[local], key)
    if len(local):
        gone[local[order]] |= key[order][np.flatnonzero(head)][np.cumsum(head) - 1] < key[order]
    steps = np.zeros(len(b.left) + 1, np.int64)
    np.add.at(steps, at[gone], 1)
    np.add.at(steps, at[gone] + WINDOW, -1)
    return np.cumsum(steps[:-1]) > 0


def kept_texts(b: Block, removed: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Of each text the number of words, of removed words, and the kept words joined by one space."""
    total = np.concatenate([[0], np.cumsum(removed)])
    data = b.words.buffer
    first, start, end = b.words.first, b.words.start, b.words.end
    for i in range(len(b.key)):
        a, z = int(first[i]), int(first[i + 1])
        gone = int(total[z] - total[a])
        if a == z or gone == z - a:
            yield z - a, gone, b""
        elif not gone:
            yield z - a, 0, data[start[a] : end[z - 1]].tobytes()
        else:
            keep = a + np.flatnonzero(~removed[a:z])
            cuts = np.flatnonzero(np.diff(keep) > 1)
            heads = keep[np.concatenate([[0], cuts + 1])]
            tails = keep[np.concatenate([cuts, [len(keep) - 1]])]
            yield z - a, gone, b" ".join(
                data[start[x] : end[y]].tobytes() for x, y in zip(heads.tolist(), tails.tolist(), strict=True)
            )


def dedup_substrings(
    df: DataFrame,
    finish: Callable[[pa.Table, list[tuple[int, int, bytes]]], pa.Table],
    schema: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Apply ``finish`` to the rows of every block and what ``kept_texts`` says of them, row by row.

    Keys are integers. Null keys come after all others, and equal keys are one document's, so that neither these nor
    repeated rows remove each other's words. Null and empty texts have no words, and texts of any length are read whole;
    one text must fit in a task. Windows are judged on the input. An empty table gives no rows.
    """
    small_batches(df.sparkSession)
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    block_bytes = min(max(BLOCK_BYTES, size // BLOCKS), MOST_BLOCK_BYTES)
    hashes = size // 12  # of twelve bytes of text about one is sent
    range_hashes = min(max(RANGE_HASHES, hashes // RANGES), MOST_RANGE_HASHES)
    n_blocks = max(int(size // block_bytes) + 1, 2 * df.sparkSession.sparkContext.defaultParallelism)
    n_ranges = max(8, int(hashes // range_hashes) + 1)
    rows = df.withColumn("__block", F.pmod(F.xxhash64(key, text), F.lit(n_blocks)).cast("int"))
    blocks = rows.repartition("__block")

    def block_of(t: pa.Table) -> Block:
        release()  # what the block before took
        return read_block(t.column(key).to_pylist(), t.column(text).to_pylist())

    def sent(pairs: Iterator[tuple[int, bytes]], block: int) -> pa.Table:
        pairs = list(pairs)
        return pa.table(
            {
                "range": pa.array([p for p, _ in pairs], pa.int32()),
                "block": pa.array([block] * len(pairs), pa.int32()),
                "hashes": pa.array([x for _, x in pairs], pa.binary()),
            }
        )

    def returned(pick: Callable[[list[bytes]], Iterator[bytes]]) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            ranges, blocks, hashes = (t.column(c).to_pylist() for c in ("range", "block", "hashes"))
            found = [(r, b, x) for r, b, x in zip(ranges, blocks, pick(hashes), strict=True) if x]
            return pa.table(
                {
                    "range": pa.array([r for r, _, _ in found], pa.int32()),
                    "__block": pa.array([b for _, b, _ in found], pa.int32()),
                    "hashes": pa.array([x for _, _, x in found], pa.binary()),
                }
            )

        return run

    def send_anchors(k: tuple, t: pa.Table) -> pa.Table:
        return sent(block_anchors(block_of(t), n_ranges), k[0].as_py())

    def send_windows(k: tuple, t: pa.Table, shared: pa.Table) -> pa.Table:
        return sent(
            block_windows(
                block_of(t),
                dict(zip(shared.column("range").to_pylist(), shared.column("hashes").to_pylist(), strict=True)),
                n_ranges,
                n_ranges,
            ) if len(t) else iter(()),
            k[0].as_py(),
        )

    def conclude(t: pa.Table, later: pa.Table) -> pa.Table:
        b = block_of(t)
        return finish(
            t.drop_columns(["__block"]), list(kept_texts(b, removed_words(b, later.column("hashes").to_pylist())))
        )

    packed, back = "range int, block int, hashes binary", "range int, __block int, hashes binary"
    shared = blocks.groupBy("__block").applyInArrow(send_anchors, packed).groupBy("range").applyInArrow(
        returned(shared_anchors), back
    )
    later = blocks.groupBy("__block").cogroup(
        shared.groupBy("__block")
    ).applyInArrow(send_windows, packed).groupBy("range").applyInArrow(
        returned(later_windows), back
    )
    return blocks.groupBy("__block").cogroup(later.groupBy("__block")).applyInArrow(conclude, schema)


def substring_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every row; extra columns are ignored. Nulls, ties, repeated rows and
    empty tables are as in ``dedup_substrings``."""

    def finish(t: pa.Table, kept: list[tuple[int, int, bytes]]) -> pa.Table:
        return pa.table(
            {
                key: t.column(key),
                "n_words": pa.array([n for n, _, _ in kept], pa.int64()),
                "n_removed": pa.array([n for _, n, _ in kept], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for _, _, x in kept], pa.string()),
            }
        )

    kind = df.schema[key].dataType.simpleString()
    return dedup_substrings(
        df.select(key, text), finish, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string", key, text
    )


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars"
) -> DataFrame:
    """All rows and columns, whatever their names; texts that lose words become the kept words joined by one space, and
    ``length``, if there is such a column, their code points. Other texts stay as they are, also null ones. Nulls, ties,
    repeated rows and empty tables are as in ``dedup_substrings``."""
    rows, text = numbered(df), number(df, text)
    length = number(df, length) if length in df.columns else None

    def finish(t: pa.Table, kept: list[tuple[int, int, bytes]]) -> pa.Table:
        texts = [
            x.decode() if gone else old for (_, gone, x), old in zip(kept, t.column(text).to_pylist(), strict=True)
        ]
        t = t.set_column(t.column_names.index(text), text, pa.array(texts, t.schema.field(text).type))
        if length:
            field = t.schema.field(length)
            known = t.column(length).to_pylist()
            sizes = [len(x) if gone else n for x, (_, gone, _), n in zip(texts, kept, known, strict=True)]
            t = t.set_column(t.column_names.index(length), length, pa.array(sizes, field.type))
        return t

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return named(dedup_substrings(rows, finish, schema, number(df, key), text), df)
