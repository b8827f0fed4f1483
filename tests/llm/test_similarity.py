"""Near duplicates, vector searches and resharding against brute force on small and hand-made data."""

import itertools
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import ann, neardup, sharding, topk, vectors
from tests.conftest import SF


def shingle_set(text):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def plain_classes(rows):
    """doc id -> (smallest id connected to it, links to other sets)."""
    sets = {i: shingle_set(t) for i, t in rows}
    near, links = {i: {i} for i in sets}, defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            near[a].add(b)
            near[b].add(a)
            if x != y:
                links[a].add(y)
                links[b].add(x)
    name = {i: i for i in sets}
    while True:
        new = {i: min(name[j] for j in near[i]) for i in sets}
        if new == name:
            return {i: (name[i], len(links[i])) for i in sets}
        name = new


def made_documents(n=140):
    draw = random.Random(2)
    rows = []
    for i in range(n):
        if i % 7 == 0 or not rows:
            words = [f"w{draw.randrange(500)}" for _ in range(draw.choice((3, 8, 40, 120)))]
        else:
            words = rows[-1][1].split() if draw.random() < 0.6 else [f"w{draw.randrange(500)}" for _ in range(60)]
            if draw.random() < 0.7 and words:
                words[draw.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "one")]


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = made_documents()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    got = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == plain_classes(rows) and len(got) == len(rows)


def test_keep_one_of_each_class(spark):
    rows = made_documents(60)
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*rows, rows[0]]] + [(None, "no id at all here", "x")], "doc_id long, text string, h string")
    kept = neardup.keep_one(docs)
    want = {name for name, _ in plain_classes(rows).values()} | {None}
    assert kept.columns == docs.columns and sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect())
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_forest_prefix_and_overlaps():
    k = neardup.prefix_length()
    assert 1 - (1 - 0.8**k) ** neardup.TREES >= neardup.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** neardup.TREES
    draw = np.random.default_rng(0)
    sets = [np.unique(draw.integers(0, 6000, n).astype(np.uint64)) for n in (1, 50, 3000, 5000, 200)]
    assert (neardup.overlaps(sets) == [[len(np.intersect1d(a, b)) if i != j or (len(a) > 0) else 0 for j, b in enumerate(sets)]
                                       for i, a in enumerate(sets)])[~np.eye(5, dtype=bool)].all()
    near = np.zeros((6, 6), bool)
    for a, b in ((5, 3), (3, 4), (1, 2)):
        near[a, b] = near[b, a] = True
    assert neardup._roots(near).tolist() == [0, 1, 1, 3, 3, 3]


VECTORS = [(0, [0.5, -0.25]), (1, [0.5, 0.25]), (2, [0.1, 0.1]), (3, [0.1, 0.1]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
           (7, []), (8, [1.0, 2.0, 3.0]), (9, [0.0, 0.0]), (10, [-1.0, 0.5]), (10, [-1.0, 0.5]), (20, [0.3, 0.3]), (None, [1.0, 1.0])]


def plain_top(rows, each, k, score, zero):
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))))
    out = []
    for q in rows:
        if q[0] % each == 0:
            found = sorted((-score(q[1], c[1]), c[0]) for c in rows if c != q and len(c[1]) == len(q[1]))[:k]
            out += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 100)
    monkeypatch.setattr(topk, "QUERY_CHUNK", 7)

    def score(a, b):
        return int(sum(np.floor(256 * x) * np.floor(256 * y) for x, y in zip(a, b, strict=True)))

    table = spark.createDataFrame([(i, v, 1) for i, v in VECTORS], "vec_id long, embedding array<double>, rank int")
    assert sorted(map(tuple, topk.search(table, vectors.every(5), 3).collect())) == plain_top(VECTORS, 5, 3, score, True)
    some = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 300")
    rows = [(r.vec_id, r.embedding) for r in some.collect()]
    assert sorted(map(tuple, topk.search(some, vectors.every(50), 5).collect())) == plain_top(rows, 50, 5, score, True)
    assert topk.search(table.limit(0), vectors.every(5), 3).count() == 0


def test_threshold_stops_early_and_huge_components_do_not_overflow():
    draw = np.random.default_rng(1)
    rows = np.floor(draw.normal(size=(20_000, 2)) * 256)
    lists = topk.Lists(rows)
    which, scores = lists.best(np.array([300.0, 10.0]), np.zeros(len(rows), bool), 5)
    assert len(which) < 5_000 and sorted(scores)[-5:] == sorted((rows @ [300, 10]).astype(int))[-5:]
    limits = vectors.whole(np.array([[1.7e308, -1.7e308], [-1e308, 1.0], [1.0, 0.5], [1e308, 1e308]]))
    for query in limits:
        which, scores = topk.Lists(limits).best(query, np.zeros(4, bool), 4)
        exact = [min(max(sum(int(a) * int(b) for a, b in zip(limits[i], query, strict=True)), topk.LONG[0]), topk.LONG[1]) for i in which]
        assert len(which) == 4 and scores.tolist() == exact
    which, scores = topk.Lists(np.array([[1e300], [-1e300], [2.0]])).best(np.array([1e10]), np.zeros(3, bool), 3)
    assert sorted(scores) == [-(1 << 63), 2 * 10**10, (1 << 63) - 1]


def test_nearest_neighbours(spark):
    def score(a, b):
        return float(np.dot(np.array(a, float), np.array(b, float)))

    table = spark.createDataFrame([(i, v, 1) for i, v in VECTORS], "vec_id long, embedding array<double>, bucket int")
    got = ann.search(table, vectors.every(5), 3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [x[:3] for x in plain_top(VECTORS, 5, 3, score, False)]
    some = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in some.collect()]
    want = {(q, i) for q, _, i, _ in plain_top(rows, 20, 20, score, False)}
    found = ann.search(some, vectors.every(20), 20).collect()
    assert len(want & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(want)
    by_id = dict(rows)
    assert all(r.score == pytest.approx(score(by_id[r.query_id], by_id[r.vec_id]), abs=1e-12) for r in found)
    assert ann.search(table.limit(0), vectors.every(5), 3).count() == 0


def test_a_pair_met_by_several_tasks_is_one_result(spark):
    """Buckets spread over many tasks: no vector twice in a query's results, and the scores are sums in component order."""
    some = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    by_id = {r.vec_id: np.array(r.embedding, float) for r in some.collect()}
    before = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = ann.search(some, vectors.every(20), 20).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    pairs = [(r.query_id, r.vec_id) for r in found]
    assert len(pairs) == len(set(pairs)) == 20 * len({q for q, _ in pairs})
    assert all(r.score == np.cumsum(by_id[r.query_id] * by_id[r.vec_id])[-1] for r in found)


def test_best_takes_one_of_several_scores_of_a_pair():
    best = vectors.Best(3)
    for score in (1.0, 1.0 + 2**-51):
        best.add(np.array([7]), np.array([0]), np.array([1, 2, 3]), np.array([0, 0, 0]), np.array([[score, 1.0 + 2**-52, 0.5]]),
                 np.zeros((1, 3), bool))
    assert best.all()[2].tolist() == [1, 2, 3]


@pytest.mark.parametrize("search", [ann.search, topk.search])
def test_repeated_rows_take_one_place(spark, search):
    """The best candidates are in the table several times; all k places still go to different rows."""
    rows = [(0, [1.0, 0.0])] + [(i, [10.0 - i, 0.5]) for i in range(1, 8)] + [(1, [9.0, 0.5])] * 4 + [(3, [7.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = search(table, F.col("id") == 0, 4).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in found] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def recall(spark, rows, each, k):
    want = {(q, i) for q, _, i, _ in plain_top(rows, each, k, lambda a, b: float(np.dot(a, b)), False)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in ann.search(table, vectors.every(each), k).collect()}
    return len(want & found) / len(want), len(found) / len(want)


def test_neighbours_of_mixed_norms(spark):
    """Some vectors are ten times as long as the others: for most queries they are the neighbours."""
    some = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    long = np.random.default_rng(5).random(len(some)) < 0.02
    rows = [(r.vec_id, [float(x) * (10.0 if far else 1.0) for x in r.embedding]) for r, far in zip(some, long, strict=True)]
    assert recall(spark, rows, 40, 20)[0] >= 0.9


def test_few_rows_of_many_components_are_all_found(spark):
    """Where there are fewer candidates than places, each is a result; 64 components have 1,024 signed axes."""
    some = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(40).collect()
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in some]
    for n in (1, 10, 40):
        if n == 1:
            assert ann.search(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), vectors.every(1), 20).count() == 0
        else:
            assert recall(spark, rows[:n], 1, 20) == (1.0, 1.0)


def test_probes_go_down_to_a_share_of_the_rows():
    draw = np.random.default_rng(3)
    filed = ann.buckets(ann.rotations(ann.in_bands(draw.normal(size=(3000, 8)))[0], False, 4))
    turned = ann.rotations(ann.directions(draw.normal(size=(5, 8))), True, 4)
    counts = np.bincount(filed.ravel(), minlength=4 * 2 * 16)
    for share, least, held in ((0.25, 200, 3000), (0.25, 2000, 8000), (0.25, 3000, 12_000), (0.25, 9000, 12_000)):
        for own in ann.probes(turned, counts, 4, share, least):
            assert counts[own].sum() >= held and (counts[own] > 0).all()
            assert held == 12_000 or counts[own[:-1]].sum() < held


def test_hot_bucket_is_searched_whole(spark, monkeypatch):
    """Two thirds of the rows are one vector; a bucket in many chunks gives the same as in one."""
    monkeypatch.setattr(ann, "CHUNK", 16)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(200)] + [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200, 300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [r.vec_id for r in ann.search(table, F.col("id") == 100, 20).orderBy("rank").collect()]
    exact = sorted((-x[1][0], x[0]) for x in rows if x[0] != 100)[:20]
    assert found == [i for _, i in exact]


def test_flow_moves_the_fewest_bytes():
    draw = random.Random(4)
    for _ in range(40):
        supply = [draw.randrange(9) for _ in range(3)]
        demand = sharding.capacities(sum(supply), 4)
        cost = [[draw.randrange(4) for _ in demand] for _ in supply]
        flow = sharding.min_cost_flow(supply, demand, cost)
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == demand
        units = [i for i, s in enumerate(supply) for _ in range(s)][:6]
        if len(units) == sum(supply):
            slots = [j for j, d in enumerate(demand) for _ in range(d)]
            least = min((sum(cost[i][j] for i, j in zip(units, p, strict=True)) for p in set(itertools.permutations(slots))), default=0)
            assert sum(f * c for r, p in zip(flow, cost, strict=True) for f, c in zip(r, p, strict=True)) == least


def sharded(spark, docs, old_shards=4, shards=6):
    rows = sharding.measured(docs)
    return rows, sharding.reshard(rows, F.pmod(F.xxhash64("content", F.lit(1)), F.lit(old_shards)), old_shards, shards=shards)


def test_reshard_is_even_gapless_and_minimal(spark):
    texts = [f"text {i} " + "x" * (i * 37 % 400) for i in range(3000)] + ["same text"] * 40 + [None, ""]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    got = sharded(spark, docs)[1].collect()
    assert len(got) == len(texts)
    held, old, slots = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in got:
        held[r.shard] += r.size
        old[r.old_shard] += r.size
        slots[r.shard].append(r.slot)
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    even = sum(held.values()) / 6
    assert sorted(held) == list(range(6)) and max(abs(b - even) for b in held.values()) < 0.02 * even
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if texts[r.doc_id] == "same text"}) == 1
    moved = sum(r.size for r in got if r.shard != r.old_shard)
    assert moved <= sum(max(0, b - even) for b in old.values()) + 0.02 * even * 6


def test_reshard_divides_a_hot_group_and_counts_repeats(spark):
    docs = spark.createDataFrame([(i, "hot " * 20) for i in range(600)] + [(i, f"t{i}" * 9) for i in range(600, 1200)] + [(5, "r")] * 7 + [(None, None)],
                                 "doc_id long, text string")
    got = sharded(spark, docs)[1].collect()
    held = defaultdict(int)
    for r in got:
        held[r.shard] += r.size
    assert len(got) == 1208 and max(held.values()) < 1.2 * min(held.values())
    assert len({(r.shard, r.slot) for r in got}) == 1208
    assert sharded(spark, docs.limit(0))[1].count() == 0


def test_rewrite_touches_only_what_changes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(400)], "doc_id long, text string")
    old = F.pmod(F.xxhash64(F.xxhash64("text"), F.lit(1)), F.lit(4)).cast("int")
    docs.withColumn("shard", F.when(old == 3, F.lit(3)).otherwise(old)).write.partitionBy("shard").parquet(str(tmp_path / "old"))
    stored = spark.read.parquet(str(tmp_path / "old"))
    rows = sharding.stage(sharding.measured(stored).join(stored.select("doc_id", "shard"), "doc_id"), "rows")
    sizes = {r[0]: r[1] for r in rows.groupBy("shard").agg(F.sum("size")).collect()}
    keep = [sizes[0], sizes[1] - 500, sizes[2], sizes[3], 600]
    plan = sharding.reshard(rows.withColumnRenamed("shard", "was"), F.col("was"), 4, sizes=keep).drop("was")
    where = {r.shard: r.path for r in sharding.rewrite(str(tmp_path / "old"), plan).collect()}
    assert os.path.dirname(where[0]) == os.path.dirname(where[2]) == str(tmp_path / "old") and os.path.dirname(where[4]) != str(tmp_path / "old")
    now = {r.doc_id: s for s, p in where.items() for r in spark.read.parquet(p).collect()}
    assert now == {r.doc_id: r.shard for r in plan.collect()} and len(now) == 400
