"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved.

Every old shard consists of blocks. The flow problem has one supply for each old shard (its bytes), one demand for
each new shard (its capacity) and the cost 1 for each byte that changes shards; its solution says how many bytes go
from each old shard to each new one. Blocks are then taken in order until each transfer is met; only blocks that
change shards have to be rewritten.

A block is a hash of the text, so equal texts lie in one block and move together. A block above ``1 / SPLIT`` of
a new shard's capacity is divided by document, as a group of copies may be larger than a shard. The number of
blocks is bounded (``BLOCKS`` for each old shard, and ``PARTS`` for each of the divided ones, of which there are
at most ``SPLIT`` for each new shard), whatever the number of documents; the flow has a node for each shard only.

Law: ``bytes``. The shards' sizes come within about one block of equal. Within a shard, documents have gapless slots.

Defined results: a null text has no bytes but its fixed overhead. Rows that repeat are rows of their own, each with
its slot. Null ids come first. An empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.ordered import join_null_safe
from citeloom.llm.common import stage
from citeloom.runtime import fresh_dir

OVERHEAD = 8
BLOCKS = 2_048
PARTS = 256
SPLIT = 16
FINE = 1_024


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units sent from each source to each sink at the least cost; as much is sent as both sides allow.

    Successive shortest paths with potentials on the graph start, sources, sinks, end.
    """
    m, n = len(supply), len(demand)
    start, end, nodes = m + n, m + n + 1, m + n + 2
    to: list[int] = []
    left: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(a: int, b: int, room: int, c: int) -> None:
        for u, v, r, p in ((a, b, room, c), (b, a, 0, -c)):
            out[u].append(len(to))
            to.append(v)
            left.append(r)
            price.append(p)

    total = min(sum(supply), sum(demand))
    for i in range(m):
        for j in range(n):
            edge(i, m + j, total, cost[i][j])
    for i, s in enumerate(supply):
        edge(start, i, s, 0)
    for j, d in enumerate(demand):
        edge(m + j, end, d, 0)
    potential = [0] * nodes
    while True:
        best, by = [None] * nodes, [-1] * nodes
        best[start], queue = 0, [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > best[u]:
                continue
            for e in out[u]:
                v = to[e]
                reach = d + price[e] + potential[u] - potential[v]
                if left[e] > 0 and (best[v] is None or reach < best[v]):
                    best[v], by[v] = reach, e
                    heapq.heappush(queue, (reach, v))
        if best[end] is None:
            break
        potential = [p + b if b is not None else p for p, b in zip(potential, best, strict=True)]
        path, v = [], end
        while v != start:
            path.append(by[v])
            v = to[by[v] ^ 1]
        room = min(left[e] for e in path)
        for e in path:
            left[e] -= room
            left[e ^ 1] += room
    return [[left[2 * (i * n + j) + 1] for j in range(n)] for i in range(m)]


def capacities(total: int, shards: int) -> list[int]:
    """``total`` bytes in near equal parts."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, content): what the plan needs of every row, as a stage table."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return stage(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
                             F.crc32(data).alias("text_crc32"), F.xxhash64(F.col(text)).alias("content")), "sizes")


def reshard(rows: DataFrame, old: Column, old_shards: int, sizes: list[int] | None = None, shards: int = 24) -> DataFrame:
    """``rows`` (as from ``measured``) with ``old_shard``, ``shard``, ``slot``.

    ``old``: the shard a row is in, 0 to ``old_shards`` - 1. ``sizes``: what each new shard may hold, in bytes, together at
    least what there is; equal shares if not given.
    """
    placed = rows.withColumn("old_shard", old.cast("int")).withColumn("block", F.pmod("content", F.lit(BLOCKS)).cast("int"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    room = sizes or capacities(total, shards)
    limit = max(1, max(room) // SPLIT)
    coarse = placed.groupBy("old_shard", "block").agg((F.sum("size") > limit).alias("divided"))
    # At most BLOCKS rows for each old shard, whatever the data.
    cells = placed.join(F.broadcast(coarse), ["old_shard", "block"]).withColumn(
        "part", F.when(F.col("divided"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).otherwise(0)).drop("divided")
    blocks = stage(cells.groupBy("old_shard", "block", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "blocks")
    held = {r[0]: r[1] for r in blocks.groupBy("old_shard").agg(F.sum("bytes")).collect()}  # one row for each old shard
    supply = [held.get(i, 0) for i in range(old_shards)]
    flow = min_cost_flow(supply, room, [[int(i != j) for j in range(len(room))] for i in range(old_shards)])
    transfers = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):  # what stays comes first
            if row[j]:
                transfers.append((i, at, at + row[j], j))
                at += row[j]
    spans = rows.sparkSession.createDataFrame(transfers, "old_shard int, low long, high long, shard int")
    # Large blocks first, by size: a transfer then ends among the small ones, and so near its figure.
    large = F.when(F.col("bytes") > max(room) // FINE, -F.col("bytes")).otherwise(F.lit(0))
    before = Window.partitionBy("old_shard").orderBy(large, F.xxhash64("block", "part")).rowsBetween(Window.unboundedPreceding, -1)
    middle = blocks.withColumn("mid", F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.floor((F.col("bytes") - 1) / 2))
    on = [middle["old_shard"] == spans["old_shard"], F.col("mid") >= F.col("low"), F.col("mid") < F.col("high")]
    goes = middle.join(F.broadcast(spans), on).select(middle["old_shard"], "block", "part", "shard", "rows")
    first = Window.partitionBy("shard").orderBy("old_shard", "block", "part").rowsBetween(Window.unboundedPreceding, -1)
    goes = goes.withColumn("first", F.coalesce(F.sum("rows").over(first), F.lit(0))).drop("rows")
    within = Window.partitionBy("old_shard", "block", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = cells.withColumn("at", F.row_number().over(within))
    # Bounded as the blocks are.
    return numbered.join(F.broadcast(goes), ["old_shard", "block", "part"]).withColumn(
        "slot", (F.col("first") + F.col("at") - 1).cast("long")).drop("first", "at", "block", "part")


def moves(plan: DataFrame) -> DataFrame:
    """(old_shard, shard, rows, bytes) of what changes shards."""
    return plan.filter("old_shard <> shard").groupBy("old_shard", "shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def rewrite(path: str, plan: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rewrite the files of a table of shards (``path/shard=N``) that lose or gain rows.

    Unaffected shards stay where they are and are not read; the others are written anew to a folder next to
    them. Returns (shard, path): where each shard is now. ``plan`` comes from ``reshard``.
    """
    spark = plan.sparkSession
    moved = plan.filter("old_shard <> shard")
    lost = {r[0] for r in moved.select("old_shard").distinct().collect()}  # shard numbers only
    touched = lost | {r[0] for r in moved.select("shard").distinct().collect()}
    stored = spark.read.parquet(path)
    old = stored.filter(F.col("shard").isin(*sorted(touched))) if touched else stored.limit(0)
    target = plan.select(F.col("doc_id").alias(doc_id), "content", F.col("old_shard").alias("__old"), F.col("shard").alias("__new")).distinct()
    keyed = old.withColumn("content", F.xxhash64(text)).withColumnRenamed("shard", "__old")
    out = fresh_dir(spark, "shards")
    if touched:
        join_null_safe(keyed, target, [doc_id, "content", "__old"]).drop("content", "__old").withColumnRenamed("__new", "shard").write.partitionBy("shard").parquet(out)
    every = {r[0] for r in plan.select("shard").distinct().collect()}
    return spark.createDataFrame([(s, f"{out if s in touched else path}/shard={s}") for s in sorted(every)], "shard int, path string")
