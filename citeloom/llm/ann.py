"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe and exact reranking.

Candidates are filed by bands of norm whose bounds are ``RATIO`` apart. In a band they are scaled by its upper bound
and get one more component that makes them unit vectors; a query is scaled to a unit vector and gets a zero there, so
that in each band the largest inner product is the nearest direction, whatever the norms in other bands. Each of
``TABLES`` tables turns them by a fast pseudo-rotation (random signs, then a Hadamard transform, three times) and files
them under the nearest signed axis. A query looks up in every band the signed axes that are nearest over all
tables, until the buckets looked up hold ``SHARE`` of the band's rows and ``FACTOR`` x k rows (a row counts in each
table, so this is the mean over the tables), or all axes are used: a band of up to ``FACTOR`` x k rows is searched
whole. Whatever lies there is scored exactly on the original
vectors, in double precision and in component order, so that a pair met in several buckets has one score.

Every row is indexed; nothing is fitted. A bucket above ``CHUNK`` rows is cut into chunks, each
of which the bucket's queries meet, so a bucket of any size is searched whole and by many tasks. A task keeps the k
best of each query, so results do not grow with the buckets.

Defined results: vectors null, empty, zero, or with null or non-finite components take no part; neither do null
ids. Rows that repeat whole count once; rows with one id and different vectors are different rows. Vectors of
different lengths never meet. Ties go to the smaller id. No candidates, no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ordered import join_null_safe
from citeloom.llm.common import stage
from citeloom.llm.vectors import Best, matrix, products, ranked, units, usable

TABLES = 4
RATIO = 1.1
SHARE = 0.25
FACTOR = 10
CHUNK = 16_384
QUERY_CHUNK = 1_024
ROUNDS = 3
SEED = 11


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Hadamard transform of every row (a power of two long), scaled to keep lengths."""
    n, wide = rows.shape
    step = 1
    while step < wide:
        pairs = rows.reshape(n, wide // (2 * step), 2, step)
        rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(n, wide)
        step *= 2
    return rows / np.sqrt(wide)


def in_bands(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row scaled by the upper bound of its band, and the band: the logarithm of the norm to the base ``RATIO``, rounded."""
    peak = np.abs(rows).max(1)
    part = rows / peak[:, None]
    band = np.rint((np.log(peak) + np.log((part**2).sum(1)) / 2) / np.log(RATIO))
    return part * np.exp(np.log(peak) - (band + 0.5) * np.log(RATIO))[:, None], band.astype(np.int64)


def directions(rows: np.ndarray) -> np.ndarray:
    """Each row scaled to a unit vector."""
    part = rows / np.abs(rows).max(1)[:, None]
    return part / np.linalg.norm(part, axis=1)[:, None]


def rotations(scaled: np.ndarray, query: bool, tables: int) -> np.ndarray:
    """Unit vectors turned by each table's rotation: (rows, tables, width)."""
    n, length = scaled.shape
    wide = 1 << length.bit_length()
    unit = np.zeros((n, wide))
    unit[:, :length] = scaled
    if not query:
        unit[:, length] = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(1)))
    random = np.random.default_rng(SEED)
    turned = np.empty((n, tables, wide))
    for t in range(tables):
        own = unit
        for _ in range(ROUNDS):
            own = hadamard(own * random.choice((-1.0, 1.0), wide))
        turned[:, t] = own
    return turned


def buckets(turned: np.ndarray) -> np.ndarray:
    """Nearest signed axis in each table, as one number over all tables."""
    n, tables, wide = turned.shape
    axis = np.abs(turned).argmax(2)
    negative = np.take_along_axis(turned, axis[:, :, None], 2)[:, :, 0] < 0
    return np.arange(tables) * 2 * wide + axis + wide * negative


def probes(turned: np.ndarray, counts: np.ndarray, tables: int, share: float, least: int) -> list[np.ndarray]:
    """The signed axes nearest to each row over all tables, numbered as in ``buckets``, down to where their buckets hold
    ``share`` of the rows and ``least`` rows of each table on average, or all rows; buckets without rows are left out."""
    both = np.concatenate((turned, -turned), 2).reshape(len(turned), -1)
    order = np.argsort(-both, axis=1, kind="stable")
    enough = min(max(share * counts.sum(), tables * least), counts.sum())
    used = (counts[order].cumsum(1) < enough).sum(1) + 1
    return [own[:n][counts[own[:n]] > 0] for own, n in zip(order, used, strict=True)]


def _filed(tables: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            bands, found = np.zeros(len(sizes), np.int64), np.zeros((len(sizes), tables), np.int64)
            for size in np.unique(sizes):
                for own in np.array_split(at := np.flatnonzero(sizes == size), -(-len(at) // 1024)):
                    scaled, bands[own] = in_bands(matrix(batch.column(2).take(pa.array(own))))
                    found[own] = buckets(rotations(scaled, False, tables))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bands), pa.array(list(found), pa.list_(pa.int64()))],
                                             names=["id", "h", "vec", "size", "band", "buckets"])

    return run


def _probed(tables: int, share: float, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (size, band, _), rows in units(batches, 3):
            asks = rows["ask"].to_numpy()
            asking, cut = rows.filter(pa.array(asks)).combine_chunks(), rows.filter(pa.array(~asks))
            counts = np.zeros(tables * 2 * (1 << size.bit_length()), np.int64)
            counts[cut["bucket"].to_numpy()] = cut["n"].to_numpy()
            for a in range(0, len(asking), 256):
                own = asking.slice(a, 256).combine_chunks()
                found = probes(rotations(directions(matrix(own["vec"].combine_chunks())), True, tables), counts, tables, share, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), size)), pa.array(np.full(len(own), band)), *(own[c].combine_chunks() for c in ("id", "h", "vec")),
                     pa.array(found, pa.list_(pa.int64()))], names=["size", "band", "id", "h", "vec", "buckets"])

    return run


def may_be_best(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Pairs that may be among a query's ``k`` best: a matrix product's score is within its rounding error of the kth.

    The last bits of a matrix product depend on the shapes of its matrices, so it only selects and never is the score.
    """
    if len(rows) <= k:
        return np.ones(own.shape, bool)
    about = np.where(own, -np.inf, queries @ rows.T)
    error = 4 * queries.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()
    kth = np.partition(about, len(rows) - k, axis=1)[:, len(rows) - k]
    return ~(about < (kth - error)[:, None])


def _search(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for _, rows in units(batches, 4):
            asks = rows["ask"].to_numpy()
            if asks.all() or not asks.any():
                continue
            ids, hashes, all_rows = rows["id"].to_numpy(), rows["h"].to_numpy(), matrix(rows["vec"].combine_chunks())
            c_ids, c_hashes, c_rows = ids[~asks], hashes[~asks], all_rows[~asks]
            asking = np.flatnonzero(asks)
            for some in np.array_split(asking, -(-len(asking) // 256)):
                own = (ids[some][:, None] == c_ids) & (hashes[some][:, None] == c_hashes)
                keep = ~own & may_be_best(all_rows[some], c_rows, own, k)
                row, column = np.nonzero(keep)
                scores = np.full(keep.shape, -np.inf)
                scores[row, column] = products(all_rows[some], c_rows, row, column)
                best.add(ids[some], hashes[some], c_ids, c_hashes, scores, ~keep)
        yield from best.batches()

    return run


def search(table: DataFrame, queries: Column, k: int, vec_id: str = "vec_id", vec: str = "embedding",
           tables: int = TABLES, share: float = SHARE, factor: int = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``queries`` (over ``id``) holds."""
    rows = stage(usable(table, vec_id, vec, nonzero=True).withColumn("size", F.size("vec").cast("long")), "vectors")
    kind = dict(rows.dtypes)["vec"]
    filed = rows.mapInArrow(_filed(tables), f"id long, h long, vec {kind}, size long, band long, buckets array<long>")
    filed = stage(filed.withColumn("bucket", F.explode("buckets")).drop("buckets"), "buckets")
    # One row for each bucket: tables x twice the padded length in each band, whatever the number of vectors.
    cut = stage(filed.groupBy("size", "band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")), "cut")
    parts = max(1, -(-rows.filter(queries).count() // QUERY_CHUNK))

    # Queries meet the bucket counts of each band of their length in units of bounded size.
    asked = join_null_safe(rows.filter(queries), cut.select("size", "band").distinct(), ["size"]).select(
        "size", "band", F.pmod(F.xxhash64("id", "h"), F.lit(parts)).cast("long").alias("part"), F.lit(True).alias("ask"), "id", "h", "vec",
        F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("n"))
    counted = cut.select(
        "size", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(False).alias("ask"),
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("h"), F.lit(None).cast(kind).alias("vec"), "bucket", "n")
    asked = asked.unionByName(counted).repartition("size", "band", "part").sortWithinPartitions("size", "band", "part")
    asked = asked.mapInArrow(_probed(tables, share, factor * k), f"size long, band long, id long, h long, vec {kind}, buckets array<long>")
    asked = asked.withColumn("bucket", F.explode("buckets")).drop("buckets")

    def unit(own: DataFrame, chunk: Column, ask: bool) -> DataFrame:
        met = join_null_safe(own, cut.drop("n"), ["size", "band", "bucket"]).withColumn("chunk", chunk)
        return met.select("size", "band", "bucket", F.col("chunk").cast("long").alias("chunk"), F.lit(ask).alias("ask"), "id", "h", "vec")

    both = unit(filed, F.pmod(F.xxhash64("id", "h"), "chunks"), False).unionByName(
        unit(asked, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)), True))
    met = both.repartition("size", "band", "bucket", "chunk").sortWithinPartitions("size", "band", "bucket", "chunk")
    found = met.mapInArrow(_search(k), "query_id long, qh long, vec_id long, h long, score double")
    return ranked(found, k)
