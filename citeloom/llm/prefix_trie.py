"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt into shards of ``1 << SHARD`` neighbouring ids (``conv_id >> SHARD``) and cut every ``SEGMENT`` turns. A task holds one
such unit: an index from (position, turn) to the bitset of the shard's conversations that have this turn there, and for each
position the bitset of those that end. From the conversations that share all turns before the unit it goes depth
first: the members of a node not yet assigned to a child name a posting by their lowest bit, the intersection of the node's
bitset with that posting is a child, its population count the child's members. There are as many intersections as nodes.
Nodes of all units are then summed by their key, and the ends of a node, listed by shard, are read in order of shard.

A node's key is its depth and two 64-bit sums (exclusive or) of hashes of (position, SHA-256 of role and text), so the
key before each segment comes from sums over segments, and a conversation with a third of all turns is many units.

Values of whole subtrees need no walk by levels. Nodes with one ``conv_id`` form a path downwards; a path hangs on a node
of a path with a smaller ``conv_id``. Totals of the paths below are added up by doubling (a round adds what lies 2, 4, 8...
paths below), then values run up along each path.

Defined results: turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own; null role or
text is empty; rows without a conv_id take no part; other columns are ignored. No rows, no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ordered import join_null_safe, prefix_sums, prefix_xors, with_position
from citeloom.llm.common import stage
from citeloom.llm.vectors import units

SHARD = 10
SEGMENT = 64
HOT = 256
NO_ENDS = hashlib.sha256(b"").hexdigest()
FOUND = "depth long, k1 long, k2 long, p1 long, p2 long, n_convs long, conv_id long, bytes long, ends string, shard long"


def turns(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, bytes): the turns of each conversation in order, from 0, without their texts."""
    said = table.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    said = said.withColumn("digest", digest)
    rows = stage(said.select("conv_id", "turn", "digest", F.octet_length("text").cast("long").alias("bytes")), "turns")
    # Texts are read again only where one turn number has several contents.
    unlike = rows.groupBy("conv_id", "turn").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi")
    unlike = stage(unlike.select("conv_id", "turn"), "unlike")
    order = [F.col("turn")]
    if not unlike.isEmpty():
        tied = join_null_safe(said, unlike, ["conv_id", "turn"]).dropDuplicates(["conv_id", "turn", "digest"])
        tied = with_position(tied, ["conv_id", "turn"], [F.col("role"), F.col("text")], "tie").select("conv_id", "turn", "digest", "tie")
        rows = join_null_safe(rows, tied, ["conv_id", "turn", "digest"], "left")
        order.append(F.col("tie"))
    return stage(with_position(rows, ["conv_id"], order, "pos").select("conv_id", "pos", "digest", "bytes"), "positions")


def lengths(rows: DataFrame) -> DataFrame:
    """(conv_id, n): number of turns of each conversation."""
    return rows.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))


def grafted(rows: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths when each conversation begins with the first ``heads`` turns (up to ``most``) of conversation ``base``, then
    has its own turns after its first ``heads``. Both are expressions over ``conv_id``."""
    counted = stage(lengths(rows), "lengths")
    whose = counted.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    plan = counted.withColumns({"base": base.cast("long"), "h": heads.cast("long")}).join(whose, "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    plan = stage(plan.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n")), "plan")
    first = rows.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lent = first.join(plan.select("conv_id", "base", "taken"), "base").filter(F.col("pos") < F.col("taken"))
    own = _looked_up(rows, plan.select("conv_id", "h", "taken"), ["conv_id"]).filter(F.col("pos") >= F.col("h"))
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "pos", "digest", "bytes"]
    return lent.select(columns).unionByName(own.select(columns)), plan.select("conv_id", "n")


def _units_of(rows: DataFrame, counted: DataFrame, shard: int, segment: int) -> DataFrame:
    """Turns, and one row where each conversation ends, by unit, with the key of all turns before the unit."""
    key = [F.xxhash64(F.lit(k), "pos", "digest").alias(f"k{k}") for k in (1, 2)]
    ends = counted.select("conv_id", F.col("n").alias("pos"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
                          F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("end"))
    placed = rows.select("conv_id", "pos", *key, "bytes", F.lit(False).alias("end")).unionByName(ends)
    placed = stage(placed.withColumns({"shard": F.shiftright("conv_id", shard), "segment": F.floor(F.col("pos") / segment).cast("long")}), "placed")
    # Only conversations of more than one segment have turns before a unit.
    sums = placed.groupBy("conv_id", "segment").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"))
    long = sums.filter("segment > 0").select("conv_id").distinct()
    before = prefix_xors(sums.join(long, "conv_id"), ["conv_id"], "segment", {"p1": F.col("k1"), "p2": F.col("k2")}).select(
        "conv_id", "segment", "p1", "p2")
    nothing = F.lit(0).cast("long")
    head = placed.filter(F.col("segment") == 0).withColumns({"p1": nothing, "p2": nothing})
    tail = placed.filter(F.col("segment") > 0).join(before, ["conv_id", "segment"])
    rows = head.unionByName(tail).select("shard", "segment", "conv_id", "pos", "k1", "k2", "bytes", "end", "p1", "p2")
    return rows.repartition("shard", "segment").sortWithinPartitions("shard", "segment")


def bitset(bits: np.ndarray) -> int:
    """Integer with the given bits set."""
    if len(bits) == 1:
        return 1 << int(bits[0])
    flags = np.zeros(int(bits.max()) + 1, bool)
    flags[bits] = True
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def members(bits: int) -> list[int]:
    """The bits set, ascending."""
    flags = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(flags, bitorder="little")).tolist()


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of the keys, and where each run of equal keys starts (with the end)."""
    order = np.lexsort(keys[::-1])
    new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.r_[0, np.flatnonzero(new) + 1, len(order)] if len(order) else np.zeros(1, int)


def grow(lowest: int, first: int, stop: int, unit: dict[str, np.ndarray]) -> list[tuple]:
    """Nodes of one unit, depth first, as rows of ``FOUND`` without the shard: conversations from ``lowest`` on, turns ``first`` to ``stop``."""
    local = unit["conv_id"] - lowest
    pos, k1, k2 = unit["pos"], unit["k1"], unit["k2"]
    postings, at, ending = [], {}, {}
    turn = np.flatnonzero(~unit["end"])
    order, cuts = _groups(pos[turn], k1[turn], k2[turn])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = turn[order[a:b]]
        depth = int(pos[own[0]])
        for bit in local[own].tolist():
            at[depth, bit] = len(postings)
        postings.append((bitset(local[own]), int(k1[own[0]]), int(k2[own[0]]), int(unit["bytes"][own[0]])))
    over = np.flatnonzero(unit["end"])
    order, cuts = _groups(pos[over])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = over[order[a:b]]
        ending[int(pos[own[0]])] = bitset(local[own])

    found, stack = [], []
    order, cuts = _groups(unit["p1"], unit["p2"])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        bits, one, two = bitset(local[own]), int(unit["p1"][own[0]]), int(unit["p2"][own[0]])
        stack.append((bits, first, one, two))
        if first == 0:
            found.append((0, one, two, None, None, bits.bit_count(), lowest + (bits & -bits).bit_length() - 1, 0, None))
    while stack:
        bits, depth, one, two = stack.pop()
        if depth == stop:
            continue  # goes on in the next segment
        ends = bits & ending.get(depth, 0)
        if ends:
            found.append((depth, one, two, None, None, 0, None, None, ",".join(str(lowest + b) for b in members(ends))))
        rest = bits ^ ends
        while rest:
            low = (rest & -rest).bit_length() - 1
            posting, a, b, size = postings[at[depth, low]]
            child = rest & posting
            rest ^= child
            found.append((depth + 1, one ^ a, two ^ b, one, two, child.bit_count(), lowest + low, size, None))
            stack.append((child, depth + 1, one ^ a, two ^ b))
    return found


def _grown(bits: int, length: int) -> Callable:
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, segment), rows in units(batches, 2):
            unit = {c: rows[c].to_numpy() for c in ("conv_id", "pos", "k1", "k2", "bytes", "end", "p1", "p2")}
            found = grow(shard << bits, segment * length, (segment + 1) * length, unit)
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds[:-1], strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(found), shard))], names=names)

    return run


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node from its lists, which come in order of shard and are never held together."""
    key, digest, done = None, hashlib.sha256(), []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                                          names=["depth", "k1", "k2", "ends_sha256"])

    for batch in batches:
        for *own, listed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if own == key:
                digest.update(b",")
            else:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
            digest.update(listed.encode())
        if done:
            yield out()
            done.clear()
    if key:
        done.append((*key, digest.hexdigest()))
        yield out()


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once. A key of more than 1/``HOT`` of the rows (there are fewer than ``HOT`` such
    keys, whatever the data) is looked up in every task, so that its rows stay where they are; the others are joined."""
    total = rows.count()
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") * HOT > total).drop("__n")
    hot = F.broadcast(stage(table.join(many, keys), "hot"))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(table, keys))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with the ``parent_conv_id`` of each."""
    named = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return top.unionByName(_looked_up(nodes.filter("depth > 0"), named, ["depth", "p1", "p2"]).select(top.columns))


def _path_totals(tree: DataFrame) -> DataFrame:
    """(conv_id, up, at, leaves, saved): each path's totals with all paths below; it hangs on node (``up``, ``at``)."""
    top = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))
    paths = stage(tree.groupBy("conv_id").agg(
        F.max(F.when(top, F.col("parent_conv_id"))).alias("up"), F.max(F.when(top, F.col("depth") - 1)).alias("at"),
        F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved")), "paths")
    jump = stage(paths.select("conv_id", F.col("up").alias("far"), "leaves", "saved"), "sums")
    while not (moving := jump.filter("far is not null")).isEmpty():
        below = moving.groupBy(F.col("far").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        onward = jump.select(F.col("conv_id").alias("far"), F.col("far").alias("next"))
        moved = _looked_up(moving, onward, ["far"]).withColumn("far", F.col("next")).drop("next")
        both = jump.filter("far is null").unionByName(moved).join(below, "conv_id", "left")
        jump = stage(both.select("conv_id", "far", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                                 (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "sums")
    return paths.select("conv_id", "up", "at").join(jump.drop("far"), "conv_id")


def trie(rows: DataFrame, counted: DataFrame, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``rows(conv_id, pos, digest, bytes)`` are turns, ``counted(conv_id, n)`` all conversations with their number of turns.
    """
    found = stage(_units_of(rows, counted, shard, segment).mapInArrow(_grown(shard, segment), FOUND), "found")
    key = ["depth", "k1", "k2"]
    nodes = found.filter(F.col("conv_id").isNotNull()).groupBy(*key).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"))
    tree = stage(_with_parents(stage(nodes, "nodes")), "tree")
    kids = tree.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    tree = tree.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    tree = stage(tree.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("bytes")}), "weighed")
    hung = _path_totals(tree).filter("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    valued = tree.join(hung, ["conv_id", "depth"], "left").withColumn("__up", -F.col("depth"))
    valued = prefix_sums(valued, ["conv_id"], "__up", {"n_leaves": F.col("leaf") + F.coalesce("l", F.lit(0)),
                                                       "saved_tokens": F.col("saving") + F.coalesce("s", F.lit(0))}, inclusive=True)
    lists = found.filter(F.col("ends").isNotNull()).select(*key, "shard", "ends")
    digests = lists.repartition(*key).sortWithinPartitions(*key, "shard").mapInArrow(_digested, "depth long, k1 long, k2 long, ends_sha256 string")
    return valued.join(digests, key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_trie(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """The trie of the conversations as they are; ``shard`` is the binary logarithm of the conversations in a unit."""
    rows = turns(table, conv_id, turn, role, text)
    return trie(rows, lengths(rows), shard, segment)
