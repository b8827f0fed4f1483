"""Hard negatives by segment summaries.

A vector's components become floor(256 x). For every anchor the best rows of its own label are its positives; for every positive
the negatives are the best rows of other labels whose score lies between a share of the positive's score and that score.

Each vector is cut into segments, of which mean and deviation (length of what is left without the mean) are kept. The inner
product of two segments is their length times the product of the means, give or take the product of the deviations, so the sum
over segments bounds the score from both sides. A pair starts with one segment; while its bounds allow a result, the
segments are cut in four (``REFINE``), down to ``SHORTEST`` components. Pairs left after that are scored exactly.

Candidate chunks meet anchor chunks as units bounded by bytes, once for positives and once for negatives: that is the stated
anchor set against all rows, in blocks. Each task hands on its best of each anchor (and positive). Nothing is broadcast.

Defined results: rows with a null id, null label, null or empty vector, or a null or non-finite component take no part. Rows that repeat whole
count once; rows with one id and different vectors or labels are different rows, and an anchor with such an id gets results for each. Vectors of
different lengths never meet. Ties go to the smaller id, then to a hash of vector and label. A negative score of a positive leaves no
room for negatives. Components and scores that leave the range of a double or a long are cut to it. No anchors, no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import stage
from citeloom.llm.vectors import Best, dot_exact, matrix, units, usable, whole

CANDIDATE_BYTES = 4 << 20
ANCHOR_BYTES = 16 << 20
ANCHORS_AT_ONCE = 128
REFINE = 4
SHORTEST = 4
SLACK = 1e-9  # widens the bounds against rounding, as a share of the product of lengths


class Summaries:
    """Mean and deviation of each segment of some vectors, from one segment down to the shortest ones."""

    @np.errstate(over="ignore", invalid="ignore")
    def __init__(self, rows: np.ndarray) -> None:
        length = rows.shape[1]
        self.levels, parts = [], 1
        while parts == 1 or length // parts >= SHORTEST:
            edges = np.arange(parts + 1) * length // parts
            mean = np.stack([rows[:, a:b].mean(1) for a, b in zip(edges[:-1], edges[1:], strict=True)], 1)
            off = np.stack([np.linalg.norm(rows[:, a:b] - mean[:, [i]], axis=1) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], 1)
            self.levels.append((np.diff(edges), mean, off))
            parts *= REFINE
        self.norms = np.linalg.norm(rows, axis=1)

    @np.errstate(over="ignore", invalid="ignore")
    def bounds(self, level: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each of the rows ``left`` can have with each of the rows ``right``."""
        size, mean, off = self.levels[level]
        middle = (mean[left] * size) @ mean[right].T
        reach = off[left] @ off[right].T + SLACK * np.outer(self.norms[left], self.norms[right])
        return middle - reach, middle + reach


def narrowed(summaries: Summaries, left: np.ndarray, right: np.ndarray, open_: np.ndarray, allows: Callable) -> np.ndarray:
    """The pairs of ``open_`` (a row for each of ``left``) that the bounds leave after the last level."""
    for level in range(len(summaries.levels)):
        column = np.flatnonzero(open_.any(0))
        if not len(column):
            break
        low, high = summaries.bounds(level, left, right[column])
        some = open_[:, column]
        open_[:, column] = some & allows(low, high, some)
    return open_


def kth(values: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """The kth largest value of each row under the mask; minus infinity if there are fewer."""
    held = np.where(mask, values, -np.inf)
    return np.full((len(held), 1), -np.inf) if held.shape[1] < k else np.partition(held, held.shape[1] - k, axis=1)[:, [held.shape[1] - k]]


def best_allow(k: int) -> Callable:
    """Pairs that may be among the ``k`` best: not below the kth of the least values."""
    return lambda low, high, some: ~(high < kth(low, some, k))


def window_allow(positive: np.ndarray, share: tuple[int, int], k: int) -> Callable:
    """Pairs that may be among the ``k`` best of the window under any of the anchor's positive scores."""

    def allows(low: np.ndarray, high: np.ndarray, some: np.ndarray) -> np.ndarray:
        found = np.zeros(low.shape, bool)
        for top in positive.T[:, :, None]:
            floor = top * (share[0] / share[1]) - 1
            inside = some & (low >= floor) & (high <= top)
            found |= (top >= 0) & ~(high < np.maximum(floor, kth(low, inside, k))) & ~(low > top)
        return found

    return allows


def _exact(rows: np.ndarray, left: np.ndarray, right: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns that still have a pair, and the scores there."""
    column = np.flatnonzero(open_.any(0))
    return column, dot_exact(rows[left], rows[right[column]])


def _unit(rows: pa.Table) -> tuple[np.ndarray, ...]:
    label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    return rows["ask"].to_numpy(), rows["id"].to_numpy(), rows["h"].to_numpy(), label, whole(matrix(rows["vec"].combine_chunks()))


def _positives(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for _, rows in units(batches, 3):
            asks, ids, hashes, label, vec = _unit(rows)
            if asks.all() or not asks.any():
                continue
            summaries = Summaries(vec)
            for own in np.unique(label[asks]):
                right = np.flatnonzero(~asks & (label == own))
                all_left = np.flatnonzero(asks & (label == own))
                for left in np.array_split(all_left, -(-len(all_left) // ANCHORS_AT_ONCE)):
                    others = ~((ids[left][:, None] == ids[right]) & (hashes[left][:, None] == hashes[right]))
                    open_ = narrowed(summaries, left, right, others, best_allow(k))
                    column, scores = _exact(vec, left, right, open_)
                    best.add(ids[left], hashes[left], ids[right[column]], hashes[right[column]], scores, ~open_[:, column])
        yield from best.batches()

    return run


def _negatives(positives: int, k: int, share: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in range(positives)]
        for _, rows in units(batches, 3):
            asks, ids, hashes, label, vec = _unit(rows)
            if asks.all() or not asks.any():
                continue
            summaries, right, all_left = Summaries(vec), np.flatnonzero(~asks), np.flatnonzero(asks)
            tops = np.array([[*own, *[-1] * (positives - len(own))] for own in rows.filter(rows["ask"])["scores"].to_pylist()], np.int64)
            for some in np.array_split(np.arange(len(all_left)), -(-len(all_left) // ANCHORS_AT_ONCE)):
                left = all_left[some]
                open_ = narrowed(summaries, left, right, label[left][:, None] != label[right], window_allow(tops[some].astype(float), share, k))
                column, scores = _exact(vec, left, right, open_)
                if not len(column):
                    continue
                # doubles of the shares would round, longs would overflow on very large scores
                wide = max(np.abs(scores.astype(float)).max(), np.abs(tops[some].astype(float)).max()) > 2**53
                exact = scores.astype(object) if wide else scores
                for j in range(positives):
                    top = tops[some, j][:, None].astype(exact.dtype)
                    inside = open_[:, column] & (top >= 0) & (share[0] * top <= share[1] * exact) & (exact <= top)
                    best[j].add(ids[left], hashes[left], ids[right[column]], hashes[right[column]], scores, ~inside.astype(bool))
        for j, own in enumerate(best):
            for batch in own.batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, j + 1, np.int32))], names=[*batch.schema.names, "at"])

    return run


def _meet(rows: DataFrame, asked: DataFrame, n: int, m: int, width: int) -> DataFrame:
    """Candidates and anchors by unit: ``n`` rows and ``m`` anchors in chunks bounded by bytes, every chunk with every other."""
    chunks = max(1, -(-n // max(1, CANDIDATE_BYTES // (8 * width))))
    parts = max(1, -(-m // max(1, ANCHOR_BYTES // (8 * width))))
    dealt = F.xxhash64("id", "h")

    def spread(own: DataFrame, mine: str, of: int, other: str, others: int, ask: bool) -> DataFrame:
        met = own.withColumn(mine, F.pmod(dealt, F.lit(of))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return met.select("size", F.col("c").cast("long").alias("c"), F.col("q").cast("long").alias("q"), F.lit(ask).alias("ask"),
                          "id", "h", "label", "vec", "scores")

    none = F.lit(None).cast("array<long>")
    both = spread(rows.withColumn("scores", none), "c", chunks, "q", parts, False).unionByName(spread(asked, "q", parts, "c", chunks, True))
    return both.repartition("size", "c", "q").sortWithinPartitions("size", "c", "q")


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    best = Window.partitionBy("query_id", "qh", *keys).orderBy(F.desc("score"), "vec_id", "h")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(table: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), vec_id: str = "vec_id",
         vec: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchors`` (over ``id``) holds.

    A negative's score s and its positive's score p satisfy share[0] p <= share[1] s <= share[1] p.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = usable(table.filter(label.isNotNull()), vec_id, vec, nonzero=False, label=label.cast("string"))
    rows = stage(rows.withColumn("size", F.size("vec").cast("long")), "vectors")
    n, m, width = rows.agg(F.count(F.lit(1)), F.count_if(anchors), F.coalesce(F.max("size"), F.lit(1))).first()
    asked = rows.filter(anchors)
    near = _meet(rows, asked.withColumn("scores", F.lit(None).cast("array<long>")), n, m, width)
    schema = "query_id long, qh long, vec_id long, h long, score long"
    near = stage(_ranked(near.mapInArrow(_positives(positives), schema), positives), "positives")
    tops = near.groupBy(F.col("query_id").alias("id"), F.col("qh").alias("h")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    far = _meet(rows, asked.join(tops, ["id", "h"]), n, m, width).mapInArrow(_negatives(positives, negatives, share), f"{schema}, at int")
    far = _ranked(far, negatives, "at").select("query_id", "qh", "at", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("query_id", "qh", F.col("rank").alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(near, ["query_id", "qh", "at"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
