"""Running totals and positions that stay balanced when one key holds most rows.

A plain ``over (partition by key order by pos)`` sends a whole key to one task. The helpers here
split every key into blocks of the order column, run the window inside a block, and carry the
block totals forward: only the block table, one row per range split and key, is windowed per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.runtime import materialise


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join that also matches null keys; keeps the left key columns only."""
    renamed = right
    condition: Column = F.lit(True)
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with ``__blk``: their range split by (keys, order), written once.

    The splits are sampled from the rows, so that there are as many as shuffle partitions, however sparse the order
    column is, and a hot key spreads over many of them.
    """
    split = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return materialise(split.withColumn("__blk", F.spark_partition_id()))


def _running(df: DataFrame, keys: Sequence[str], pos: str, values: dict[str, Column], combine: Callable[[Column], Column],
             merge: Callable[[Column, Column], Column], inclusive: bool) -> DataFrame:
    """``values`` combined over the rows of the same keys up to each row: inside its block, then with what blocks before hold."""
    cells = _blocks(df, keys, [F.col(pos)])
    group = [*keys, "__blk"]
    names = {out: (f"__in{i}", f"__all{i}") for i, out in enumerate(values)}
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy(*group).agg(*[combine(values[out]).alias(whole) for out, (_, whole) in names.items()])
    carried = totals.select(*group, *[combine(F.col(whole)).over(before).alias(whole) for _, whole in names.values()])
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*group).orderBy(pos).rowsBetween(Window.unboundedPreceding, end)
    local = cells.withColumns({own: combine(values[out]).over(inside) for out, (own, _) in names.items()})
    joined = join_null_safe(local, carried, group)
    found = joined.withColumns({out: merge(F.col(own), F.col(whole)) for out, (own, whole) in names.items()})
    return found.drop("__blk", *[n for pair in names.values() for n in pair])


def prefix_sums(df: DataFrame, keys: Sequence[str], pos: str, values: dict[str, Column], *, inclusive: bool = False) -> DataFrame:
    """Each name of ``values`` = sum of its column over the rows of the same keys that come before by ``pos``.

    ``pos`` must be unique inside a key.
    """
    return _running(df, keys, pos, values, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), inclusive)


def prefix_sum(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, *, inclusive: bool = False) -> DataFrame:
    """One column of :func:`prefix_sums`."""
    return prefix_sums(df, keys, pos, {out: value}, inclusive=inclusive)


def prefix_xors(df: DataFrame, keys: Sequence[str], pos: str, values: dict[str, Column], *, inclusive: bool = False) -> DataFrame:
    """As :func:`prefix_sums`, with exclusive-or in place of the sum."""
    return _running(df, keys, pos, values, F.bit_xor, lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0))), inclusive)


def running_max(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, *, inclusive: bool = True) -> DataFrame:
    """``out`` = greatest ``value`` seen so far by ``pos``; nulls are skipped.

    With a struct ``(pos, x)`` as value this is "the last non-null x so far".
    """
    return _running(df, keys, pos, {out: value}, F.max, lambda a, b: F.when(a.isNull() | (b > a), b).otherwise(a), inclusive)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Exact 0-based position by an arbitrary total order inside ``keys``.

    Rows are range-partitioned by (keys, order), so a hot key is spread over many partitions; each
    partition sorts and numbers its own rows and adds the row counts of the partitions before it.
    """
    names = [f"__o{i}" for i in range(len(order))]
    staged = df
    sort_cols: list[Column] = []
    for name, column in zip(names, order, strict=True):
        staged = staged.withColumn(name, column)
        sort_cols.append(F.col(name).asc_nulls_first())
    # a row's id is its partition and its place there, so that rows are not dealt again to be counted
    sorted_ = staged.repartitionByRange(*[F.col(k) for k in keys], *sort_cols).sortWithinPartitions(*[F.col(k) for k in keys], *sort_cols)
    ranged = materialise(sorted_.withColumn("__id", F.monotonically_increasing_id())).withColumn("__blk", F.shiftright("__id", 33))
    group = [*keys, "__blk"]
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranged.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    # written, so that its size is known: it is broadcast where keys are few
    offsets = materialise(spans.select(*group, (F.col("__first") - F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__off")))
    return (
        join_null_safe(ranged, offsets, group)
        .withColumn(out, (F.col("__id") - F.col("__off")).cast("long"))
        .drop("__blk", "__id", "__off", *names)
    )
