"""Shared parts of the two vector searches: usable rows, batches as matrices, best results so far."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HELD = 1 << 21
PAIRS = 1 << 15
SCALE = 256
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(table: DataFrame, vec_id: str, vec: str, nonzero: bool, **also: Column) -> DataFrame:
    """(id, h, vec) of the rows that take part, and the columns ``also``: no null or non-finite component, not empty, not zero if ``nonzero``.

    ``h`` is a hash of the vector (and ``also``): id and ``h`` tell rows apart. Rows that repeat whole are taken out here, before any
    search cuts to its k best.
    """
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    keep = F.col(vec_id).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & finite
    if nonzero:
        keep = keep & F.exists(vec, lambda x: x != 0)
    rows = table.filter(keep).select(F.col(vec_id).cast("long").alias("id"), F.xxhash64(vec, *also.values()).alias("h"), F.col(vec).alias("vec"),
                                     *[c.alias(name) for name, c in also.items()])
    return rows.dropDuplicates(["id", "h"])


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def whole(rows: np.ndarray) -> np.ndarray:
    """floor(256 x) of every component, cut to the range of a double."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows * SCALE), np.finfo(float).min, np.finfo(float).max)


def dot_exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, each row of ``left`` with each of ``right``, as longs (cut to their range).

    A matrix product of doubles is exact while no sum can reach 2^53; the rest is summed in Python's integers.
    """
    height, width = np.abs(right).max(1, initial=0.0), left.shape[1]
    with np.errstate(over="ignore"):
        if height.max(initial=0.0) * np.abs(left).max(initial=0.0) * width < EXACT:
            return (left @ right.T).astype(np.int64)
        found = np.empty((len(left), len(right)), np.int64)
        for i, own in enumerate(left):
            fits = height * np.abs(own).max(initial=0.0) * width < EXACT
            found[i, fits] = right[fits] @ own
            exact = [int(x) for x in own]
            for j in np.flatnonzero(~fits):
                found[i, j] = min(max(sum(int(a) * b for a, b in zip(right[j], exact, strict=True)), LONG[0]), LONG[1])
    return found


def products(left: np.ndarray, right: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Inner products of the given pairs of rows, summed in component order: the same bits whatever else is scored."""
    blocks = range(0, len(row), PAIRS)
    found = [np.cumsum(left[row[a:a + PAIRS]] * right[column[a:a + PAIRS]], axis=1)[:, -1] for a in blocks]
    return np.concatenate([np.empty(0), *found])


def units(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of one unit after another; rows come sorted by unit, whose columns are the first ``width``."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
            own = tuple(int(c[a]) for c in columns)
            if own != key:
                if parts:
                    yield key, pa.Table.from_batches(parts)
                key, parts = own, []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, pa.Table.from_batches(parts)


class Best:
    """The ``k`` best results of every query seen so far; ties go to the smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.rows = k, [], 0

    def add(self, queries: np.ndarray, query_hashes: np.ndarray, ids: np.ndarray, hashes: np.ndarray, scores: np.ndarray,
            out: np.ndarray) -> None:
        """Results of a block: a row of ``scores`` for each query; those marked in ``out`` don't count."""
        keep = ~out
        if not keep.any():
            return
        if len(ids) > self.k:
            lowest = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
            scores = np.where(out, lowest, scores)
            keep &= scores >= np.partition(scores, len(ids) - self.k, axis=1)[:, [len(ids) - self.k]]
            for r in np.flatnonzero(keep.sum(1) > self.k):
                near = np.flatnonzero(keep[r])
                keep[r, near[np.lexsort((hashes[near], ids[near], -scores[r, near]))[self.k:]]] = False
        row, column = np.nonzero(keep)
        self.parts.append((queries[row], query_hashes[row], ids[column], hashes[column], scores[row, column]))
        self.rows += len(row)
        if self.rows > HELD:
            self.parts = [self.all()]
            self.rows = len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, ...]:
        q, qh, i, h, s = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((-s, h, i, qh, q))
        q, qh, i, h, s = (c[order] for c in (q, qh, i, h, s))
        again = np.r_[False, (q[1:] == q[:-1]) & (qh[1:] == qh[:-1]) & (i[1:] == i[:-1]) & (h[1:] == h[:-1])]
        q, qh, i, h, s = (c[~again] for c in (q, qh, i, h, s))
        order = np.lexsort((h, i, -s, qh, q))
        q, qh, i, h, s = (c[order] for c in (q, qh, i, h, s))
        first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (qh[1:] != qh[:-1])])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        return tuple(c[rank < self.k] for c in (q, qh, i, h, s))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.all()], names=["query_id", "qh", "vec_id", "h", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the best of what the tasks found, each pair once."""
    best = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id", "h")
    pairs = found.groupBy("query_id", "qh", "vec_id", "h").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def every(n: int) -> Column:
    """Query rows: those whose id is divisible by ``n``."""
    return F.col("id") % n == 0
