"""Connected components by alternating large-star and small-star contraction.

Before that, every task replaces its edges by a forest: each node linked to the smallest it is connected to there. This is done where edges
arise, so that of very many edges only forests are shuffled, and again when these are dealt by ranges of their nodes. What lies between
neighbouring ids, chains above all, is done after that, and no task emits more edges than nodes.

Each round is two aggregations (map-side combined minima) and two equi joins, so a hub with very
many neighbours is never gathered in one place. Every round is written to the shared checkpoint
folder, which keeps the plan short and lets a lost executor resume from files.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import materialise


FOREST_EDGES = 1 << 18  # edges that a task holds at once

log = logging.getLogger(__name__)


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges that is not the smallest of its component there, and that smallest node."""
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = codes[:len(u)], codes[len(u):], np.arange(len(nodes))
    while True:
        a, b = root[a], root[b]
        open_ = a != b
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a root is linked to the smallest root it meets
        while not np.array_equal(root, above := root[root]):
            root = above
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def forest(parts: list[pd.DataFrame]) -> list[pd.DataFrame]:
        found = []
        for job, own in pd.concat(parts).groupby("job_id", sort=False):
            node, root = _roots(own["u"].to_numpy(), own["v"].to_numpy())
            found.append(pd.DataFrame({"job_id": [job] * len(node), "u": node, "v": root}))
        return found

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= FOREST_EDGES:
            held = forest(held)
            if sum(map(len, held)) >= FOREST_EDGES // 2:  # a smaller one is kept, and takes up what follows
                yield from held
                held = []
    if held:
        yield from forest(held)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("job_id", "u", "v").unionByName(
        edges.select("job_id", F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("job_id", "u").agg(F.min("v").alias("m"))
    return (
        both.join(smallest, ["job_id", "u"]).filter("v > u")
        .select("job_id", F.col("v").alias("u"), F.least("u", "m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("job_id", "u").agg(F.min("v").alias("m"))
    onward = edges.join(smallest, ["job_id", "u"]).filter("v <> m").select("job_id", F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.unionByName(smallest.select("job_id", "u", F.col("m").alias("v")))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job_id, pos, component) for ``nodes(job_id, pos)``; a component is named by its smallest member. A node without a job is alone."""
    current = edges.filter("a <> b and job_id is not null").select("job_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = materialise(current.mapInPandas(_forests, current.schema).distinct())
    current = materialise(current.repartitionByRange("job_id", "u").mapInPandas(_forests, current.schema))
    seen, rounds = None, 0
    while True:
        mark = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("job_id", "u", "v"))).first()
        log.info("edges before round %d: %d", rounds, mark[0])
        if mark == seen or mark[0] == 0:
            break
        seen, rounds = mark, rounds + 1
        contracted = _small_star(_large_star(current).distinct())
        current = materialise(contracted.filter("u <> v").distinct())
    labels = current.groupBy("job_id", F.col("u").alias("pos")).agg(F.min("v").alias("component"))
    return nodes.select("job_id", "pos").join(labels, ["job_id", "pos"], "left").withColumn(
        "component", F.coalesce("component", "pos"))
