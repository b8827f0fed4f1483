"""Pivotal rounding against targets worked out by hand and a step-by-step replay of the water level."""

import pytest
from pyspark.sql import functions as F

from citeloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, taken string"


def level_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mix_meets_targets_and_agrees_on_reruns(spark):
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), "abc"[i % 3] if i % 10 else None, "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = mixing.measured(docs)
    got = {(r.doc_id, r.copies, r.source, r.size, r.target) for r in mixing.plan(sizes).collect()}
    assert got == {(r.doc_id, r.copies, r.source, r.size, r.target) for r in mixing.plan(mixing.measured(docs.repartition(7))).collect()}
    per = {}
    for _, text, source, _ in rows:
        per[source] = per.get(source, 0) + len(text.split())
    want = level_targets(per)
    for source in per:
        taken = sum(c * n for _, c, s, n, _ in got if s == source)
        assert {round(t, 6) for _, _, s, _, t in got if s == source} == {round(want[source], 6)}
        assert abs(taken - want[source]) <= 17
    assert len(got) == 3000 and {c for _, c, *_ in got} <= {0, 1, 2, 3}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(c for _, c, *_ in got)


def test_rounding_is_unbiased(spark):
    """Over many documents a fraction p is taken up about p of the time, whatever its size."""
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "a" if i % 4 else "b", "") for i in range(8000)]
    got = mixing.plan(mixing.measured(spark.createDataFrame(rows, SCHEMA))).filter("source = 'a'")
    for size, share, ratio in got.groupBy("size").agg(F.avg("copies"), F.first(F.col("target") / F.col("source_size"))).collect():
        assert share == pytest.approx(ratio, abs=0.06), size


def test_limits_nulls_and_repeats(spark):
    rows = [(1, "a b", "s", "")] * 3 + [(2, None, None, ""), (3, "", "t", ""), (None, "x", "t", ""), (4, " ".join(["w"] * 90), "u", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan(mixing.measured(docs)).collect()
    assert len(got) == 5
    targets = {r.source: r.target for r in got}
    want = level_targets({"s": 6, None: 0, "t": 1, "u": 90})
    assert targets == pytest.approx(want)
    assert all(r.copies <= 3 for r in got)
    mixed = mixing.mix(docs).groupBy("doc_id").count().filter("doc_id = 1").first()
    assert mixed is None or mixed["count"] % 3 == 0
    empty = docs.limit(0)
    assert mixing.plan(mixing.measured(empty)).count() == 0 and mixing.mix(empty).count() == 0
