"""Near duplicates: Jaccard similarity join on word shingles by MinHash bands of one length for all texts.

This is the last level of an LSH forest, not a forest: prefixes of the ``TREES`` signatures are cut at one length, the first one, going down
from ``DEPTH``, that meets the target recall; no trie is built and no prefix is shortened by what the data holds.

A text is the set of its shingles of ``SHINGLE`` words (words are runs without ASCII white space; a text with fewer
words is one shingle). Texts with the same set are one copy class, and a class is compared once. Each class has
``TREES`` signatures of MinHash values; two classes are candidates if they share the prefix of any. Its length is the
longest of up to ``DEPTH`` values with which a pair at the wanted similarity is met with
probability ``RECALL``. Candidates whose sketches agree too little (``SLACK`` below the wanted similarity,
4.5 standard deviations) are left out; the rest form small components, inside which every pair is verified
on the exact shingle sets.

Nothing is gathered by key without a bound: a trie node or a component above ``BLOCK`` classes is cut into blocks,
and each pair of blocks is a unit of its own. A unit returns a row for each class (how many links, and one
class it is connected to), never pairs. Blocks of a component are cut by set size, so that blocks whose sizes
exclude the similarity never meet.

Defined results: null, empty and blank texts have no shingles: each is a class of its own, without links. Repeated
rows and equal texts share their class. Ids may be of any orderable type and may repeat; a class is named by its
smallest id. An empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ordered import join_null_safe, with_position
from citeloom.llm.common import stage
from citeloom.operators.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.9995
SLACK = 0.18
BLOCK = 512

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SLICE = 512


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix at which a pair of that similarity shares one in some trie with probability ``recall``."""
    for k in range(depth, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the whole text."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = mixed * _STEP + hashed[k:len(words) - width + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def sketch(found: np.ndarray, values: int) -> np.ndarray:
    """``values`` MinHash values of a set of hashes."""
    random = np.random.default_rng(7)
    factor = random.integers(0, 1 << 63, values, np.uint64) * np.uint64(2) + np.uint64(1)
    offset = random.integers(0, 1 << 63, values, np.uint64)
    least = np.full(values, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _SLICE):
        np.minimum(least, (found[at:at + _SLICE, None] * factor + offset).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def prefixes(values: np.ndarray, trees: int) -> np.ndarray:
    """One hash for each trie: that of its prefix."""
    own = values.reshape(trees, -1).astype(np.uint64)
    mixed = np.arange(1, trees + 1, dtype=np.uint64)
    for k in range(own.shape[1]):
        mixed = (mixed ^ own[:, k]) * _STEP
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def copy_key(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _sketches(trees: int, values: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, sizes, sketched, keys = [], [], [], []
            for t in batch.column(2):
                found = shingles(t.as_py())
                copies.append(copy_key(found))
                sizes.append(len(found))
                own = sketch(found, values) if len(found) else None
                sketched.append(None if own is None else own.tobytes())
                keys.append(None if own is None else prefixes(own, trees))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(copies, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketched, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "copy", "n", "sketch", "keys"])

    return run


def _units(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows of one unit after another; rows come sorted by unit, whose columns are the first ``width``."""
    unit: tuple | None = None
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != unit:
                if rows:
                    yield rows
                unit, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield rows


def _roots(near: np.ndarray) -> np.ndarray:
    """Smallest index reached from each index of a symmetric boolean matrix."""
    root = np.arange(len(near))
    while True:
        least = np.where(near, root, len(near)).min(1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _alike(least: float) -> Callable:
    """Connections between the sketches of one unit: (a, b), b the first class that a is connected to."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for rows in _units(batches, 3):
            rows = list({r[0]: r for r in rows}.values())
            if len(rows) > 1:
                values = np.frombuffer(b"".join(r[1] for r in rows), np.uint32).reshape(len(rows), -1)
                near = np.stack([(values == v).mean(1) for v in values]) >= least
                found += [(rows[i][0], rows[j][0]) for i, j in enumerate(_roots(near)) if i != j]
            if len(found) >= 10_000:
                yield _out(found, schema)
                found = []
        if found:
            yield _out(found, schema)

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.r_[True, every[1:] != every[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.unique(column, return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float64)
    wide = 2048
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + wide, wide))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        held = np.zeros((len(sets), wide), np.float32)
        held[owner[a:b], column[a:b] - k * wide] = 1
        total += held @ held.T
    return total


def _verified(similarity: float) -> Callable:
    """Links of each class inside one unit: (copy, links, root)."""
    schema = pa.schema([("copy", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for rows in _units(batches, 3):
            own: dict[bytes, tuple[int, np.ndarray]] = {}
            for copy, block, text in rows:  # an id that repeats with another text brings rows of other classes
                if copy not in own and copy_key(s := shingles(text)) == copy:
                    own[copy] = block, s
            keys, sets = list(own), [s for _, s in own.values()]
            if not keys:
                continue
            block, sizes = np.array([b for b, _ in own.values()]), np.array([len(s) for s in sets])
            common = overlaps(sets)
            near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            np.fill_diagonal(near, False)
            if block.min() != block.max():  # pairs within a block are another unit's
                near &= block[:, None] != block[None, :]
            found += [(keys[i], int(n), keys[j]) for i, (n, j) in enumerate(zip(near.sum(1), _roots(near), strict=True))]
            if len(found) >= 10_000:
                yield _out(found, schema)
                found = []
        if found:
            yield _out(found, schema)

    return run


def _block_pairs(blocks: str):
    """All (i, j), i <= j, that hold block ``b`` of ``blocks`` blocks."""
    return F.expr(f"transform(sequence(0L, {blocks} - 1), o -> named_struct('i', least(b, o), 'j', greatest(b, o)))")


def sketches(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, copy, n, sketch, keys) for every row, as a stage table. ``h`` tells the rows of one id apart."""
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    id_type = own.schema["doc_id"].dataType.simpleString()
    values = TREES * prefix_length(similarity)
    return stage(own.mapInArrow(_sketches(TREES, values), f"doc_id {id_type}, h long, copy binary, n int, sketch binary, keys array<long>"),
                 "sketches")


def _candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): connections between classes that share a prefix and whose sketches are close."""
    keyed = classes.select("copy", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    there = stage(keyed.join(shared, "key").select("key", "size", "copy"), "nodes")
    with_sketch = there.join(classes.select("copy", "sketch"), "copy")
    blocked = with_sketch.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("b", F.pmod(F.xxhash64("copy"), "blocks"))
    units = blocked.withColumn("u", F.explode(_block_pairs("blocks"))).select("key", "u.i", "u.j", "copy", "sketch")
    dealt = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_alike(similarity - SLACK), "a binary, b binary").distinct()


def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(copy, component) by distributed contraction."""
    one = F.lit("")
    found = connected_components(nodes.select(one.alias("job_id"), F.col("copy").alias("pos")),
                                 edges.select(one.alias("job_id"), "a", "b"))
    return found.select(F.col("pos").alias("copy"), "component")


def classes_of(rows: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, class_id, copy_id, n_links) for every row of ``rows``, the sketches of ``docs``."""
    classes = stage(rows.filter(F.col("copy").isNotNull()).groupBy("copy").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "classes")
    edges = stage(_candidates(classes, similarity), "candidates")
    ends = edges.select(F.col("a").alias("copy")).union(edges.select(F.col("b").alias("copy"))).distinct()
    members = _components(edges, ends).join(classes.select("copy", "rep", "n"), "copy")
    placed = with_position(members, ["component"], [F.col("n"), F.col("copy")], "at").withColumn("b", F.floor(F.col("at") / BLOCK))
    placed = stage(placed.select("component", "copy", "rep", "n", "b"), "members")
    blocks = placed.groupBy("component", "b").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.select("component", F.col("b").alias("o"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    met = blocks.join(other, "component").filter(F.when(F.col("o") >= F.col("b"), F.col("o_low") * similarity <= F.col("high"))
                                                 .otherwise(F.col("low") * similarity <= F.col("o_high")))
    pairs = met.select("component", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    # Always a merge join: members are a share of the documents, so at size their table is no side to broadcast.
    texts = placed.hint("merge").join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    units = texts.join(pairs, ["component", "b"]).select("component", "i", "j", "copy", "b", "text")
    dealt = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = stage(dealt.mapInArrow(_verified(similarity), "copy binary, links long, root binary"), "links")
    links = found.groupBy("copy").agg(F.sum("links").alias("links"), F.count_distinct("root").alias("roots"), F.min("root").alias("root"))
    joined = found.filter("root <> copy").select(F.col("copy").alias("a"), F.col("root").alias("b"))
    whole = _components(joined, links.select("copy"))
    named = whole.join(classes.select("copy", "rep"), "copy")
    first = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    known = named.join(first, "component").join(links.select("copy", "links"), "copy").select("copy", "class_id", "links")
    every = classes.select("copy", "rep").join(known, "copy", "left").select(
        "copy", F.col("rep").alias("copy_id"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", "h", "copy").join(every, "copy", "left").select(
        "doc_id", "h", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links) for every row.

    ``class_id``: smallest id among the texts connected by links of at least ``similarity``; ``copy_id``: smallest id
    with the same shingle set; ``n_links``: number of other copy classes linked to this one.
    """
    return classes_of(sketches(docs, similarity), docs, similarity).drop("h")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest id; same columns.

    Rows without words are classes of their own and stay; rows with the same id and text count as one.
    """
    rows = classes_of(sketches(docs, similarity), docs, similarity)
    wordless = F.col("class_id").isNull()
    best = rows.groupBy("class_id").agg(F.min(F.struct("doc_id", "h")).alias("best")).filter(~wordless).select("best.*")
    best = best.unionByName(rows.filter(wordless).select("doc_id", "h").distinct())
    kept = join_null_safe(docs.withColumn("__h", F.xxhash64("text")), best.withColumnRenamed("h", "__h"), ["doc_id", "__h"])
    return kept.dropDuplicates(["doc_id", "__h"]).select(*[F.col(f"`{c}`") for c in docs.columns])
