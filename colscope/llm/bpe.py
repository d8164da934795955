"""Byte-pair encoding and decoding, with tree concatenation of long texts.

Texts of ordinary length are encoded where they lie. A long text is cut in halves until the pieces are short, the
pieces are encoded in parallel, and neighbours are joined pairwise up the tree: a window around the join is encoded
again and grows until, on either side, it agrees with what that side already has. The result equals the encoding of
the whole text. Why agreement is enough: words are found from left to right and depend on what follows by a few
characters only, so a boundary that window and side share at a distance from any cut is a boundary of the whole
text; and inside a word, tokens are the word's encoding if every two neighbours are, which the shared pair of
tokens around the boundary carries over from either encoding.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, small_batches, written
from .vector_text import slices

#: Characters above which a text is cut, and of a piece at most.
LONG, PIECE = 1 << 16, 1 << 15
#: Characters on which the finding of words may depend beyond a word, with room to spare: special tokens have 13.
MARGIN = 16
#: Encoded words that a worker remembers at most.
REMEMBERED = 300_000

# The word pattern of byte-level BPE, for characters whose classes all versions of Unicode share.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \\t\\n\\r"
PLAIN = re.compile("[\\t\\n\\r -~¡-¬®-ɏ]*")
WORD = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


class Encoded(NamedTuple):
    """A text with its tokens: ids, the character each starts at, and whether it starts a word."""

    text: str
    ids: np.ndarray
    start: np.ndarray
    opens: np.ndarray


class Codec:
    """A tokenizer as the library loads it, without truncation and padding, and the words it has met."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        import json

        read = json.loads(definition)
        pre = read.get("pre_tokenizer") or {}
        self.by_word = read.get(
            "normalizer"
        ) is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get(
            "add_prefix_space"
        )
        self.ids: dict[str, str] = {}
        self.changed: dict[str, str] = {}  # words that decode to something else
        self.unseen = 0

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def encoded(self, text: str) -> Encoded:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        return Encoded(
            text,
            np.array(e.ids, np.int64),
            np.array([a for a, _ in e.offsets], np.int64),
            np.diff(word, prepend=-2) != 0,
        )

    def written(self, text: str) -> tuple[str, str]:
        """Decimal ids with a comma after each, and what they decode to.

        Words recur, so where the text's words are sure to be the library's, each different word is encoded and
        decoded once; other texts are encoded and decoded whole.
        """
        if not (self.by_word and PLAIN.fullmatch(text)) or any(s in text for s in self.special):
            ids = self.encode(text)
            return "".join([f"{i}," for i in ids]), self.decode(ids)
        words = WORD.findall(text)
        ids = self.ids
        if new := [w for w in set(words) if w not in ids]:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            decoded = self.tokenizer.decode_batch(found, skip_special_tokens=False)
            self.changed.update((w, d) for w, d in zip(new, decoded, strict=True) if w != d)
            if len(ids) + len(new) > REMEMBERED:
                ids = {w: ids[w] for w in words if w in ids}
                self.unseen += len(new)
                if self.unseen > REMEMBERED:  # the words have changed
                    self.unseen, self.ids = 0, {}
            ids.update(zip(new, ["".join([f"{i}," for i in x]) for x in found], strict=True))
        return "".join(map(ids.__getitem__, words)), "".join(
            [self.changed.get(w, w) for w in words] if self.changed else words
        )


_codecs: dict[int, Codec] = {}


def codec(definition: str) -> Codec:
    """One for each worker and definition."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    at = hash(definition)
    if at not in _codecs:
        _codecs.clear()
        _codecs[at] = Codec(definition)
    return _codecs[at]


def pieces(text: str, most: int = PIECE) -> list[str]:
    """The text's halves, halved until none is longer than ``most``."""
    if len(text) <= most:
        return [text]
    half = len(text) // 2
    return pieces(text[:half], most) + pieces(text[half:], most)


def _agreed(x: Encoded, shift_x: int, y: Encoded, shift_y: int, least: int, most: int) -> list[int]:
    """Places (common to both after shifting) from ``least`` to ``most`` where both have the same boundary between
    the same two tokens."""
    found = []
    here = np.intersect1d(x.start + shift_x, y.start + shift_y)
    for p in here[(here >= least) & (here <= most)].tolist():
        i, j = int(np.searchsorted(x.start, p - shift_x)), int(np.searchsorted(y.start, p - shift_y))
        if not (i and j and x.opens[i] == y.opens[j] and x.ids[i] == y.ids[j]):
            continue
        if x.ids[i - 1] == y.ids[j - 1] and x.start[i - 1] + shift_x == y.start[j - 1] + shift_y:
            found.append(p)
    return found


def joined(a: Encoded, b: Encoded, encoded) -> Encoded:
    """The encoding of both texts together; ``encoded`` encodes a window of them."""
    if not a.text or not b.text:
        return a if a.text else b
    cut, size = len(a.text), 4 * MARGIN
    while True:
        i = max(int(np.searchsorted(a.start, cut - size, "right")) - 1, 0)
        i = int(np.searchsorted(a.start, a.start[i]))  # not inside a character
        j = int(np.searchsorted(b.start, size))
        begin, end = int(a.start[i]), int(b.start[j]) if j < len(b.start) else len(b.text)
        w = encoded(a.text[begin:] + b.text[:end])
        left = [0] if begin == 0 else _agreed(a, 0, w, begin, begin + MARGIN, cut - MARGIN)
        right = [cut + len(b.text)] if end == len(b.text) else _agreed(w, begin, b, cut, cut + 1, cut + end - MARGIN)
        if left and right:
            p, q = left[-1], right[0]
            head, tail = a.start < p, b.start >= q - cut
            body = (w.start >= p - begin) & (w.start < q - begin)
            return Encoded(
                a.text + b.text,
                *(
                    np.concatenate(x)
                    for x in (
                        (a.ids[head], w.ids[body], b.ids[tail]),
                        (a.start[head], w.start[body] + begin, b.start[tail] + cut),
                        (a.opens[head], w.opens[body], b.opens[tail]),
                    )
                ),
            )
        size *= 4


def tree(parts: list[Encoded], encoded) -> Encoded:
    """Neighbours joined pairwise until one is left."""
    while len(parts) > 1:
        parts = [
            joined(*pair, encoded)
            if len(pair) == 2
            else pair[0]
            for pair in (parts[i : i + 2] for i in range(0, len(parts), 2))
        ]
    return parts[0]


def _digests(ids: str, text: str) -> tuple[int, str, str]:
    return ids.count(","), hashlib.sha256(ids[:-1].encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _encoded_long(rows: DataFrame, definition, finish, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """``finish(codec, tokens)`` for the texts of ``rows (key, text)``. Each different text is encoded once, and copies
    get what became of it by its digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out = [
                (h, i, x)
                for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for i, x in enumerate(pieces(text))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))],
                names=["h", "piece", "text"],
            )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(definition.value)
        for b in slices(batches, 2):
            found = [c.encoded(t) for t in b.column(2).to_pylist()]
            kind = np.uint16 if c.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    *[
                        pa.array([f(x).tobytes() for x in found], pa.binary())
                        for f in (
                            lambda x: x.ids.astype(kind),
                            lambda x: x.start.astype(np.uint16),
                            lambda x: np.packbits(x.opens),
                        )
                    ],
                ],
                names=["h", "piece", "text", "ids", "start", "opens"],
            )

    def join(t: pa.Table) -> pa.Table:
        c = codec(definition.value)
        kind = np.uint16 if c.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        t = t.sort_by("piece")
        parts = []
        for text, ids, start, opens in zip(
            *(t.column(n).to_pylist() for n in ("text", "ids", "start", "opens")), strict=True
        ):
            at = np.frombuffer(ids, kind).astype(np.int64)
            parts.append(
                Encoded(
                    text,
                    at,
                    np.frombuffer(start, np.uint16).astype(np.int64),
                    np.unpackbits(np.frombuffer(opens, np.uint8), count=len(at)).astype(bool),
                )
            )
        values = finish(c, tree(parts, c.encoded).ids.tolist())
        columns = [pa.array([v], t) for v, t in zip(values, types[1:], strict=True)]
        return pa.table([pa.array([t.column("h")[0].as_py()], pa.string()), *columns], names=["h", *names[1:]])

    digested = rows.withColumn("h", F.sha2("text", 256))
    keys = written(digested.select("key", "h"))
    cut_up = digested.groupBy("h").agg(F.any_value("text").alias("text")).mapInArrow(
        cut, "h string, piece int, text string"
    )
    leaves = cut_up.repartition("h", "piece").mapInArrow(
        encode, "h string, piece int, text string, ids binary, start binary, opens binary"
    )
    found = leaves.groupBy("h").applyInArrow(join, f"h string, {schema}")
    return join_hot(keys, found, "h").select(*names)


def _run(df: DataFrame, path: str, key: str, text: str, short, finish, columns: str, long: int) -> DataFrame:
    """``finish(codec, ids)`` or, for what is not long, ``short(codec, text)`` of every row. The tokenizer's file, of
    constant size, is read by the driver and broadcast."""
    small_batches(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType.simpleString()
    names = ["key", *[c.split()[0] for c in columns.split(", ")]]
    arrow = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    types = [None, *[arrow[c.split()[1]] for c in columns.split(", ")]]
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(definition.value)
        for b in slices(batches, 1):
            found = list(zip(*[short(c, t) for t in b.column(1).to_pylist()], strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(x, t) for x, t in zip(found, types[1:], strict=True)]], names=names
            )

    out = rows.filter(F.char_length("text") <= long).mapInArrow(whole, f"key {kind}, {columns}")
    many = _encoded_long(rows.filter(F.char_length("text") > long), definition, finish, columns, names, types)
    return out.unionByName(many).withColumnRenamed("key", key)


def encode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """``key, ids`` of every row, ids as the library encodes the whole text, however long; null texts are empty and have
    none. Keys may be null or tie, repeated rows stay, extra columns are ignored, an empty table gives no rows. ``path``
    is the tokenizer's file as the driver sees it."""
    return _run(df, path, key, text, lambda c, t: (c.encode(t),), lambda c, ids: (ids,), "ids array<int>", long)


def decode_ids(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` of every row's ids, as the library decodes them whole; null and empty ids decode to the empty text.
    Keys may be null or tie, repeated rows stay, extra columns are ignored, an empty table gives no rows."""
    with open(path, encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(definition.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())],
                names=["key", "text"],
            )

    return df.select(F.col(key).alias("key"), ids).mapInArrow(
        run, f"key {df.schema[key].dataType.simpleString()}, text string"
    ).withColumnRenamed("key", key)


def token_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row: what ``encode_texts`` and ``decode_ids`` give,
    digested where it is made, so that no ids are moved. Nulls, ties, repeated rows and empty tables are as there."""

    def finish(c: Codec, ids: list[int]) -> tuple[int, str, str]:
        return _digests("".join([f"{i}," for i in ids]), c.decode(ids))

    return _run(
        df,
        path,
        key,
        text,
        lambda c, t: _digests(*c.written(t)),
        finish,
        "n_tokens long, ids_sha256 string, decoded_sha256 string",
        long,
    )
