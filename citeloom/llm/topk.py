"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

A vector's components become floor(256 x). Candidates are dealt into chunks; inside a chunk every dimension has a
list of the candidates sorted by their component. A query reads all lists in parallel from the end that its
own component favours, scores every candidate it meets, and stops when the best score that an unseen candidate could
still have (the sum of the query's components times the list entries at the depth reached) is below its
kth score. The depth grows by the factor ``GROWTH``. The k best of each chunk are then ranked together.

Query chunks meet candidate chunks as units of bounded size, one matrix each; nothing is broadcast. Every query
meets every candidate chunk: that is the stated query set against all rows, in blocks.

Defined results: vectors null, empty, or with null or non-finite components take no part; neither do null ids. Rows
that repeat whole count once; rows with one id and different vectors are different rows, and a query with such an
id gets results for each. Vectors of different lengths have no inner product and never meet. Ties go to the smaller
id. Components that leave the range of a double by the factor 256 are cut to it, scores that do not fit a
long to its range. No candidates, no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import stage
from citeloom.llm.vectors import EXACT, LONG, Best, matrix, ranked, units, usable, whole

CHUNK = 16_384
QUERY_CHUNK = 1_024
GROWTH = 4


class Lists:
    """Candidates of one chunk with a sorted list for each dimension."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(rows.T, self.order, 1)
        self.high = np.abs(rows).max()

    def _scores(self, which: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.high * np.abs(query).max() * len(query) < EXACT:
            return (self.rows[which] @ query).astype(np.int64)
        own = [int(x) for x in query]
        found = [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in self.rows[which]]
        return np.array([min(max(s, LONG[0]), LONG[1]) for s in found], np.int64)

    @np.errstate(over="ignore", invalid="ignore")
    def best(self, query: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and scores of the candidates seen until the bound fell below the kth score."""
        n = len(self.rows)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = own.copy()
        which, scores, depth = [np.empty(0, np.int64)], [np.empty(0, np.int64)], k
        while True:
            depth = min(depth, n)
            met = np.zeros(n, bool)
            met[self.order[up, n - depth:].ravel()] = True
            met[self.order[down, :depth].ravel()] = True
            if depth == n:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            which.append(new)
            scores.append(self._scores(new, query))
            got = np.concatenate(scores)
            if depth == n or seen.all():
                break
            bound = float(query[up] @ self.sorted[up, n - depth] + query[down] @ self.sorted[down, depth - 1])
            if len(got) >= k and np.partition(got, len(got) - k)[len(got) - k] > bound * (1 + 1e-12 * np.sign(bound)):
                break
            depth *= GROWTH
        return np.concatenate(which), got


def _search(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for _, rows in units(batches, 3):
            asks = rows["ask"].to_numpy()
            ids, hashes = rows["id"].to_numpy(), rows["h"].to_numpy()
            scaled = whole(matrix(rows["vec"].combine_chunks()))
            there = ~asks
            if not there.any() or not asks.any():
                continue
            lists, c_ids, c_hashes = Lists(scaled[there]), ids[there], hashes[there]
            for i in np.flatnonzero(asks):
                which, scores = lists.best(scaled[i], (c_ids == ids[i]) & (c_hashes == hashes[i]), k)
                best.add(ids[[i]], hashes[[i]], c_ids[which], c_hashes[which], scores[None], np.zeros((1, len(which)), bool))
        yield from best.batches()

    return run


def search(table: DataFrame, queries: Column, k: int, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of every row for which ``queries`` (over ``id``) holds."""
    rows = stage(usable(table, vec_id, vec, nonzero=False).withColumn("size", F.size("vec")), "vectors")
    counted = rows.agg(F.count(F.lit(1)), F.count_if(queries)).first()
    chunks, asked = (max(1, -(-n // size)) for n, size in zip(counted, (CHUNK, QUERY_CHUNK), strict=True))
    dealt = F.xxhash64("id", "h")

    def spread(own: DataFrame, mine: str, of: int, other: str, others: int, ask: bool) -> DataFrame:
        met = own.withColumn(mine, F.pmod(dealt, F.lit(of))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return met.select("size", F.col("c").cast("long").alias("c"), F.col("q").cast("long").alias("q"), F.lit(ask).alias("ask"), "id", "h", "vec")

    both = spread(rows, "c", chunks, "q", asked, False).unionByName(spread(rows.filter(queries), "q", asked, "c", chunks, True))
    met = both.repartition("size", "c", "q").sortWithinPartitions("size", "c", "q")
    found = met.mapInArrow(_search(k), "query_id long, qh long, vec_id long, h long, score long")
    return ranked(found, k)
