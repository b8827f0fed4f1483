"""What a task of the similarity join and of the components holds does not grow with its rows."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from citeloom.operators import graph, similarity


def side(n, seed):
    rng = np.random.default_rng(seed)
    vec = 1 + 0.01 * rng.random((n, 8))
    values = pa.array(vec.reshape(-1))
    rows = pa.table({"pos": np.arange(n) + seed * n, "angle": np.zeros(n), "vec": pa.ListArray.from_arrays(np.arange(0, 8 * n + 1, 8, dtype="int32"), values)})
    return similarity._Side(rows, False)


def test_matches_of_a_unit_are_found_in_bounded_products():
    left, right = side(16384, 0), side(256, 1)
    tracemalloc.start()
    found = sum(len(a) for a, _b, _cosine in similarity._matches(left, right, 0.9, 0.9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 16384 * 256 and peak < 48 << 20


def test_forest_of_a_task_takes_up_later_edges(monkeypatch):
    monkeypatch.setattr(graph, "FOREST_EDGES", 64)
    star = pd.DataFrame({"job_id": [1] * 16, "u": range(1, 17), "v": [0] * 16})
    out = pd.concat(graph._forests(iter([star] * 40)))
    assert sorted(zip(out["u"], out["v"], strict=True)) == [(u, 0) for u in range(1, 17)]


def test_roots_of_chains_and_rings():
    rng = np.random.default_rng(3)
    order = rng.permutation(5000)
    u, v = np.maximum(order[:-1], order[1:]), np.minimum(order[:-1], order[1:])
    cut = rng.random(len(u)) < 0.9
    u, v = u[cut], v[cut]
    label = np.arange(5000)
    for _ in range(5000):
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        if np.array_equal(before, label):
            break
    node, root = graph._roots(u, v)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {i: int(x) for i, x in enumerate(label) if x != i}


def test_guests_of_several_batches_are_all_met(spark):
    """Own rows of a unit come first, however many batches a unit has."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(600, 4))
    rows = [(1, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "job_id long, pos long, vec array<double>")
        found = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, 0.9, block_rows=32).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    assert found == set(zip(a.tolist(), b.tolist(), strict=True))
