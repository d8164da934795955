"""Exact top-k by inner product, with multi-resolution segment statistics.

A vector's segments are summed up by mean and deviation, at 4, 16 and 32 segments. For two vectors these give a
lower bound of their squared distance, the sum over segments of w (m1 - m2)^2 + (s1 - s2)^2 (w: segment length, s:
root of the summed squared deviations), and with the norms an upper bound of their inner product. Queries and
candidates meet in blocks; in a block, pairs go whose bound can't reach the query's k-th best score so far, level by
level, and only survivors get exact integer products. What a query's k-th best reaches at least is known beforehand
from a sample of ``SAMPLE`` rows, so that no block starts from nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

SCALE = 64.0
LEVELS = (4, 16, 32)
#: Most queries and candidates in a block, candidates that are bounded at once, share of survivors from which one
#: product of whole matrices is cheaper than single ones, and share that a level must drop to be tried again in a block.
QUERIES, CANDIDATES, STRIDE, DENSE, USEFUL = 4096, 16384, 1024, 0.05, 0.02
#: Rows of the sample that gives first thresholds, and its bytes: at most.
SAMPLE, SAMPLE_BYTES = 2048, 8 << 20


def scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``floor(64 x)`` of a list column, zeros beyond a shorter vector's end, and which rows stay finite."""
    offsets = np.asarray(column.offsets, np.int64)
    flat = np.asarray(column.values, np.float64)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    with np.errstate(over="ignore", invalid="ignore"):
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(flat * SCALE)
    return out, np.isfinite(out).all(axis=1)


def same_width(*tables: np.ndarray) -> list[np.ndarray]:
    """With zeros beyond the end of the narrower ones."""
    width = max(t.shape[1] for t in tables)
    return [np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in tables]


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose plain inner product bounds that of the vectors: means times the root of w, and deviations."""
    width = max(1, -(-x.shape[1] // segments))
    parts = np.pad(x, ((0, 0), (0, width * segments - x.shape[1]))).reshape(len(x), segments, width)
    means = parts.mean(axis=2)
    spread = np.sqrt(np.maximum(((parts - means[:, :, None]) ** 2).sum(axis=2), 0))
    return np.concatenate([means * np.sqrt(width), spread], axis=1)


def exact(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Integer inner products of all rows, or of the given pairs; beyond 64 bits the nearest such number."""
    limit = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if limit < 2.0**53:
        if pairs is None:
            return a @ b.T
        return np.einsum("ij,ij->i", a[pairs[0]], b[pairs[1]])
    rows, cols = pairs if pairs is not None else np.indices((len(a), len(b))).reshape(2, -1)
    products = (
        sum(int(p) * int(q) for p, q in zip(a[i], b[j], strict=True)) for i, j in zip(rows, cols, strict=True)
    )
    out = np.array([max(-(2**63), min(2**63 - 1, s)) for s in products], dtype=object)
    return out if pairs is not None else out.reshape(len(a), len(b))


def reached(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> np.ndarray:
    """A score for each query that its k-th best is above, as k of these rows show; minus infinity if they can't."""
    out = np.full(len(queries), -np.inf)
    for a in range(0, len(queries) if len(ids) >= k else 0, STRIDE):
        product = exact(queries[a : a + STRIDE], vectors)
        if product.dtype == object:
            return np.full(len(queries), -np.inf)
        product[query_ids[a : a + STRIDE, None] == ids] = -np.inf
        out[a : a + STRIDE] = np.partition(product, len(ids) - k, axis=1)[:, len(ids) - k] - 1
    return out


def best(
    queries: np.ndarray,
    query_ids: np.ndarray,
    vectors: np.ndarray,
    ids: np.ndarray,
    k: int,
    least: np.ndarray | None = None,
    tally: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``which query, id, score`` of each query's k best, ties to smaller ids; a query's own id takes no part.

    ``least`` are scores that only candidates above them matter for. ``tally`` counts the pairs, those dropped by each
    level, and those that got exact products.
    """
    order = np.argsort(ids, kind="stable")  # in this order a later tie never wins
    vectors, ids = vectors[order], ids[order]
    levels = [[features(x, n) for x in (queries, vectors)] for n in LEVELS]
    useful = [True] * len(LEVELS)
    slack = 1e-9 * (
        np.linalg.norm(queries, axis=1).max(initial=0) * np.linalg.norm(vectors, axis=1).max(initial=0)
    ) + 1e-6
    at, found, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    least = np.full(len(queries), -np.inf) if least is None else least.copy()
    tally = np.zeros(len(LEVELS) + 2, np.int64) if tally is None else tally
    for a in range(0, len(ids), STRIDE):
        part = slice(a, min(a + STRIDE, len(ids)))
        mask = query_ids[:, None] != ids[part]  # any number of a row may be the query's own
        left = int(mask.sum())
        tally[0] += left
        pairs = None
        for level, (fq, fc) in enumerate(levels):
            if not useful[level] or not left:
                continue
            if pairs is None:
                mask &= fq @ fc[part].T + slack > least[:, None]
                now = int(mask.sum())
                pairs = np.nonzero(mask) if now < DENSE * mask.size else None
            else:
                q, c = pairs
                ok = np.einsum("ij,ij->i", fq[q], fc[part][c]) + slack > least[q]
                pairs = q[ok], c[ok]
                now = len(pairs[0])
            tally[1 + level] += left - now
            useful[level] = left - now >= USEFUL * left or not np.isfinite(least).all()
            left = now
        tally[-1] += left
        if pairs is not None:
            q, c = pairs
            s = exact(queries, vectors[part], (q, c))
        else:
            live = np.flatnonzero(mask.any(axis=1))
            mask = mask[live]
            product = exact(queries[live], vectors[part])
            mask &= product > least[live, None]
            if product.shape[1] > k and product.dtype != object and mask.mean() > DENSE:
                product[query_ids[live, None] == ids[part]] = -np.inf
                mask &= product >= np.partition(product, product.shape[1] - k, axis=1)[:, -k, None]
            q, c = np.nonzero(mask)
            s, q = product[q, c], live[q]
        ok = s > least[q]
        at, found, score = np.concatenate([at, q[ok]]), np.concatenate(
            [found, ids[part][c[ok]]]
        ), np.concatenate([score, s[ok]])
        rank = np.lexsort((found, -score, at)) if score.dtype != object else np.array(
            sorted(range(len(at)), key=lambda i: (at[i], -score[i], found[i])), np.int64
        )
        at, found, score = at[rank], found[rank], score[rank]
        first = np.searchsorted(at, np.arange(len(queries) + 1))
        keep = np.arange(len(at)) - first[at] < k
        at, found, score = at[keep], found[keep], score[keep]
        first = np.searchsorted(at, np.arange(len(queries) + 1))
        full = np.flatnonzero(np.diff(first) == k)
        least[full] = score[first[full + 1] - 1].astype(float)
    return at, found, score


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """The k best of all other rows for each row whose key is divisible by ``every``: ``query_id, rank, vec_id, score``.

    Rows take no part if key or vector is null or a component is null, infinite or no number. A shorter vector, also an
    empty one, counts as if zeros followed; vectors may be long, but a block of rows must fit in a task. A row's own are
    all rows with its key; a query that is repeated exactly counts once, repeated candidates count each; ties go to
    smaller keys. A table without queries, or an empty one, gives no rows. Extra columns are ignored.
    """
    small_batches(df.sparkSession)
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = df.filter(F.col(key).isNotNull() & v.isNotNull()).filter(finite).select(
        F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v")
    )
    queries = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = rows.select(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0), F.max(F.size("v"))).first()
    sample_rows = max(min(SAMPLE, SAMPLE_BYTES // (8 * max(n[2] or 0, 1))), 1)
    sampled = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).collect() if n[0] else []
    sample = df.sparkSession.sparkContext.broadcast(
        (np.array([r.id for r in sampled], np.int64), pa.array([r.v for r in sampled], pa.list_(pa.float64())))
    )
    c_blocks = max(-(-n[0] // CANDIDATES), min(2 * cores, -(-n[0] // 512)), 1)
    q_blocks = max(-(-n[1] // QUERIES), 1)

    def thresholds(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        sample_ids, column = sample.value
        y, ok = scaled(column)
        x, y = same_width(x, y)
        return reached(x, ids, y[ok], sample_ids[ok], k)

    def packed(side: str, blocks: int, others: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, ok = scaled(b.column(1))
                ids, sign = (np.asarray(b.column(i), np.int64) for i in (0, 2))
                dealt = sign.view(np.uint64) % np.uint64(blocks)
                kind = np.float32 if np.abs(x[ok]).max(initial=0) < 2**24 else np.float64
                rows = [(g, np.flatnonzero(ok & (dealt == g))) for g in np.unique(dealt).tolist()]
                rows = [(g, r) for g, r in rows if len(r)]
                cells = [[g * others + o if side == "c" else o * blocks + g for o in range(others)] for g, _ in rows]
                columns = [
                    pa.array(cells, pa.list_(pa.int64())), pa.array([kind().itemsize for _ in rows], pa.int32())
                ]
                start = np.full(len(ids), -np.inf)
                if side == "q":
                    start[ok] = thresholds(x[ok], ids[ok])
                columns += [
                    pa.array([f(r).tobytes() for _, r in rows], pa.binary())
                    for f in (
                        lambda r: ids[r],
                        lambda r: sign[r],
                        lambda r: x[r].astype(kind),
                        lambda r: start[r] if side == "q" else start[:0],
                    )
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["cells", "width", "ids", "signs", "x", "start"])

        return run

    def sent(table: DataFrame, side: str, blocks: int, others: int) -> DataFrame:
        signed = table.withColumn("sign", F.xxhash64("id", "v"))
        return signed.mapInArrow(
            packed(side, blocks, others), "cells array<long>, width int, ids binary, signs binary, x binary, start binary"
        ).select(F.explode("cells").alias("cell"), "width", "ids", "signs", "x", "start")

    def unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, signs, starts, xs = [], [], [], []
        names = ("width", "ids", "signs", "x", "start")
        for width, i, s, x, start in zip(*(t.column(c).to_pylist() for c in names), strict=True):
            ids.append(np.frombuffer(i, np.int64))
            signs.append(np.frombuffer(s, np.int64))
            starts.append(np.frombuffer(start, np.float64))
            read = np.frombuffer(x, np.float32 if width == 4 else np.float64)
            xs.append(read.astype(np.float64).reshape(len(ids[-1]), -1))
        whole = np.concatenate(same_width(*xs)) if xs else np.empty((0, 0))
        none = np.empty(0, np.int64)
        return np.concatenate([none, *ids]), np.concatenate([none, *signs]), whole, np.concatenate([none, *starts])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, _, x, _ = unpack(left)
        query_ids, signs, y, start = unpack(right)
        x, y = same_width(x, y)
        at, found, score = (
            best(y, query_ids, x, ids, k, start) if len(x) and len(y) else (np.empty(0, np.int64),) * 3
        )
        return pa.table(
            {"query_id": query_ids[at], "sign": signs[at], "vec_id": found, "score": score.astype(np.int64)}
        )

    cells = sent(rows, "c", c_blocks, q_blocks).groupBy("cell").cogroup(
        sent(queries, "q", q_blocks, c_blocks).groupBy("cell")
    )
    tops = cells.applyInArrow(compare, "query_id long, sign long, vec_id long, score long")
    order = Window.partitionBy("query_id", "sign").orderBy(F.col("score").desc(), "vec_id")
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
