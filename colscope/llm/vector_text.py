"""Words and hashes of many texts at once, on NumPy arrays over their joined bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

# The primes of XXH64.
P1, P2, P3, P4, P5 = U64(
    11400714785074694791
), U64(14029467366897019727), U64(1609587929392839161), U64(9650029242287828579), U64(2870177450012600261)


class Words(NamedTuple):
    """``buffer``: texts with words one space apart, a line feed after each, then padding; ``start``, ``end``: of each
    word in it; ``first``: the number of the first word of each text, and at last the number of words."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def release() -> None:
    """Give freed memory back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each have about ``most`` bytes, or are one text."""
    for batch in batches:
        column = batch.column(text)
        if not len(batch):
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        part = np.cumsum(lengths) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            yield batch.slice(a, b - a)
    release()


def read_words(texts: Sequence[str | None], lower: bool = False) -> Words:
    """Words are runs of bytes but 0x20 and 0x09 to 0x0D; ``lower`` lower-cases A to Z. Null: none."""
    spaced = [b" ".join((t.encode().lower() if lower else t.encode()).split()) if t else b"" for t in texts]
    buffer = np.frombuffer(b"\n".join([*spaced, b"\0" * 40]), np.uint8)
    n = len(buffer) - 40
    breaks = np.flatnonzero((buffer[:n] == 32) | (buffer[:n] == 10))
    start = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
    real = breaks > start
    ends_text = buffer[breaks] == 10
    first = np.concatenate([[0], np.cumsum(real)[ends_text]])
    return Words(buffer, start[real], breaks[real], first)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buffer[start:end]`` for each pair. 8 bytes at least must follow the last end."""
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    four = np.ndarray((len(buffer) - 3,), "<u4", buffer, strides=(1,))
    s = U64(seed)
    with np.errstate(over="ignore"):
        size = (end - start).astype(U64)
        at = start.astype(np.int64)
        h = np.full(len(start), s + P5, U64)
        big = np.flatnonzero(end - start >= 32)
        if len(big):
            acc = [np.full(len(big), v, U64) for v in (s + P1 + P2, s + P2, s, s - P1)]
            left = (end - start)[big] // 32
            p = at[big]
            live = np.arange(len(big))
            while len(live):
                for k in range(4):
                    acc[k][live] = _rotl(acc[k][live] + eight[p[live] + 8 * k] * P2, 31) * P1
                p[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _rotl(a * P2, 31) * P1) * P1 + P4
            h[big] = x
            at[big] = p
        h += size
        for _ in range(3):
            m = np.flatnonzero(end - at >= 8)
            if not len(m):
                break
            h[m] = _rotl(h[m] ^ _rotl(eight[at[m]] * P2, 31) * P1, 27) * P1 + P4
            at[m] += 8
        m = np.flatnonzero(end - at >= 4)
        h[m] = _rotl(h[m] ^ four[at[m]].astype(U64) * P1, 23) * P2 + P3
        at[m] += 4
        for _ in range(3):
            m = np.flatnonzero(end > at)
            if not len(m):
                break
            h[m] = _rotl(h[m] ^ buffer[at[m]].astype(U64) * P5, 11) * P1
            at[m] += 1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        return h ^ (h >> U64(32))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + U64(salt)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))
