import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from citeloom.functions.ordered import prefix_sum, running_max, with_position
from citeloom.operators import graph, similarity, themes as ops

VEC = "job_id string, pos long, vec array<double>, entities array<string>"


def brute_pairs(data, plain, shared):
    out = set()
    for i, (job, a, va, ea) in enumerate(data):
        for job2, b, vb, eb in data[i + 1:]:
            if job != job2:
                continue
            na, nb = np.linalg.norm(va), np.linalg.norm(vb)
            sim = 0.0 if na * nb == 0 else float(np.dot(va, vb) / (na * nb))
            if sim >= (shared if set(ea) & set(eb) else plain):
                out.add((job, min(a, b), max(a, b)))
    return out


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for job, a, b in edges:
        ra, rb = find((job, a)), find((job, b))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n)[1] for n in nodes}


def test_blocked_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    data = []
    for pos in range(160):
        vec = centres[pos % 6] + 0.45 * rng.normal(size=8)
        data.append(("hot" if pos % 3 else "small", pos, [float(x) for x in vec], [f"e{pos % 4}"]))
    data.append(("hot", 900, [0.0] * 8, ["e0"]))
    want = brute_pairs(data, 0.9, 0.8)
    df = spark.createDataFrame(data, VEC)
    for block in (2048, 16):
        got = {(r.job_id, r.a, r.b) for r in similarity.similar_pairs(df, 0.9, 0.8, block_rows=block).collect()}
        assert got == want, block


def test_copies_form_a_star_with_the_same_components(spark):
    data = [("j", p, [1.0, 0.0], []) for p in range(50)] + [("j", 60, [0.99, 0.1], []), ("j", 70, [0.0, 1.0], [])]
    df = spark.createDataFrame(data, VEC)
    pairs = similarity.similar_pairs(df, 0.8)
    assert pairs.count() == 49 + 1
    labels = {r.pos: r.component for r in graph.connected_components(df, pairs).collect()}
    assert set(labels[p] for p in [*range(50), 60]) == {0} and labels[70] == 70


def test_threshold_is_inclusive_and_entities_lower_it(spark, rows):
    third = [3.0, 4.0]
    data = [("j", 0, [1.0, 0.0], ["x"]), ("j", 1, third, ["y"]), ("j", 2, third[::-1], ["x"])]
    df = spark.createDataFrame(data, VEC)
    assert rows(similarity.similar_pairs(df, 0.96), "a", "b") == [(1, 2)]
    assert rows(similarity.similar_pairs(df, 0.97, 0.8), "a", "b") == [(0, 2)]


def test_components_match_union_find(spark):
    random.seed(5)
    nodes = [("j", i) for i in range(60)] + [("k", i) for i in range(20)]
    edges = [("j", random.randrange(60), random.randrange(60)) for _ in range(35)]
    edges += [("k", i, i + 1) for i in range(0, 18)]  # a long chain
    got = {(r.job_id, r.pos): r.component for r in graph.connected_components(
        spark.createDataFrame(nodes, "job_id string, pos long"), spark.createDataFrame(edges, "job_id string, a long, b long")).collect()}
    assert got == union_find(nodes, edges)


def test_components_without_edges(spark, rows):
    nodes = spark.createDataFrame([("j", 4)], "job_id string, pos long")
    assert rows(graph.connected_components(nodes, spark.createDataFrame([], "job_id string, a long, b long"))) == [("j", 4, 4)]


def test_capped_parts_are_dealt_round_robin(spark):
    rng = np.random.default_rng(1)
    data = [("j", p, [1.0 + float(x), float(y)]) for p, (x, y) in enumerate(rng.normal(scale=0.1, size=(41, 2)))]
    vectors = spark.createDataFrame(data, "job_id string, pos long, vec array<double>")
    labels = vectors.select("job_id", "pos", F.lit(0).cast("long").alias("component"))
    got = {r.pos: r.sub for r in ops.cap_buckets(labels, vectors).collect()}
    matrix = np.array([d[2] for d in data])
    centre = matrix.mean(axis=0)
    cos = matrix @ centre / np.linalg.norm(matrix, axis=1) / np.linalg.norm(centre)
    order = sorted(range(41), key=lambda i: -cos[i])
    assert got == {p: rank % 3 for rank, p in enumerate(order)}
    assert max(list(got.values()).count(s) for s in range(3)) <= 20


def test_merge_chunks_first_wins_and_positions_are_distinct(spark, rows):
    themes = spark.createDataFrame([
        ("p", 0, 0, "a", "Deep_Learning", "d1"), ("p", 1, 0, "b", " deep  learning", "d2"), ("p", 1, 1, "c", "Other", "d3"),
        ("q", 0, 0, "d", "deep learning", "d4")], "paper_id string, chunk int, pos int, theme_id string, name string, description string")
    positions = spark.createDataFrame([
        ("p", "a", 0, 1, 1), ("p", "a", 1, 1, 1), ("p", "b", 0, 1, 1), ("p", "b", 1, 2, 5), ("p", "b", 2, 2, 5), ("p", "c", 0, 1, 1)],
        "paper_id string, theme_id string, at int, page int, paragraph int")
    claims = spark.createDataFrame([("p", "b", "c1"), ("p", "zz", "c2"), ("p", "c", "c3")], "paper_id string, theme_id string, claim_id string")
    merged, where, pointed = ops.merge_chunks(themes, positions, claims)
    assert rows(merged, "paper_id", "theme_id", "name") == [("p", "a", "Deep_Learning"), ("p", "c", "Other"), ("q", "d", "deep learning")]
    assert rows(where, "canonical_id", "page", "paragraph") == [("a", 1, 1), ("a", 1, 1), ("a", 2, 5), ("c", 1, 1)]
    assert rows(pointed, "claim_id", "theme_id") == [("c1", "a"), ("c2", "zz"), ("c3", "c")]


def test_theme_names_match_exactly_then_by_containment(spark, rows):
    themes = spark.createDataFrame([(0, 0, "t0", "Deep Learning"), (0, 1, "t1", "deep-learning"), (0, 2, "t2", "Graph learning methods"), (1, 0, "u0", "Deep Learning")],
                                   "batch int, pos int, theme_id string, name string")
    reviews = spark.createDataFrame([(0, 0, "DEEP_learning"), (0, 1, "learning"), (0, 2, "Unrelated"), (1, 0, "on deep learning")],
                                    "batch int, review_no int, theme_name string")
    got = rows(ops.match_theme_name(reviews, themes), "batch", "review_no", "theme_id")
    assert got == [(0, 0, "t1"), (0, 1, "t1"), (0, 2, "Unrelated"), (1, 0, "u0")]


def test_theme_map_skips_blanks_and_reports_range(spark, rows):
    themes = spark.createDataFrame([(0, 0, "a", "N", "p"), (0, 1, "b", "", "p"), (0, 2, "c", "M", None)],
                                   "bucket int, idx int, theme_id string, name string, paper_id string")
    groups = spark.createDataFrame([(0, 0, "G", "d", [2, 0, 1, 7, -1]), (0, 1, "H", "d", [9])],
                                   "bucket int, group_no int, canonical_name string, description string, member_indices array<int>")
    built = rows(ops.build_theme_map(groups, themes), "name", "source_theme_ids", "paper_ids", "aliases")
    assert built == [("G", ["c", "a", "b"], ["p"], ["M", "N"]), ("H", [], [], [])]
    assert rows(ops.select_indices(groups, themes)[1], "idx") == [(-1,), (7,), (9,)]
    both = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("a", "c", 0.9), ("c", "a", 0.49)], "a string, b string, contradiction double")
    assert rows(ops.group_contradictions(groups, themes, both), "idx_a", "idx_b") == [(0, 1)]


def test_claims_fall_back_to_own_theme(spark, rows):
    canonical = spark.createDataFrame([("x", ["a", "a", "b"]), ("y", [])], "canonical_id string, source_theme_ids array<string>")
    claims = spark.createDataFrame([("a", "1"), ("b", "2"), ("y", "3"), ("x", "4")], "theme_id string, claim_id string")
    assert rows(ops.claims_for_theme(canonical, claims), "canonical_id", "claim_id") == [("x", "1"), ("x", "2"), ("y", "3")]


def test_reconcile_keeps_singletons_and_first_appearance(spark, rows):
    themes = spark.createDataFrame([("j", 0, "a", "A", "da"), ("j", 1, "b", "B", "db"), ("j", 2, "c", "C", "dc")],
                                   "job_id string, pos long, canonical_id string, name string, description string")
    vectors = spark.createDataFrame([("j", 0, [1.0, 0.0]), ("j", 1, [0.0, 1.0]), ("j", 2, [1.0, 0.01])], "job_id string, pos long, vec array<double>")
    members = spark.createDataFrame([("a", "source", 0, "s1"), ("c", "source", 0, "s1"), ("a", "paper", 0, "p"), ("c", "paper", 0, "p"), ("c", "paper", 1, "q"), ("b", "source", 0, "s2")],
                                    "canonical_id string, kind string, at int, value string")
    final, listed = ops.reconcile_themes(themes, vectors, members)
    names = {r.name: r.canonical_id for r in final.collect()}
    assert set(names) == {"A", "B"} and names["B"] == "b" and names["A"] not in ("a", "c")
    got = sorted((r.kind, r.pos, r.at, r.value) for r in listed.filter(F.col("canonical_id") == names["A"]).collect())
    assert got == [("paper", 0, 0, "p"), ("paper", 2, 1, "q"), ("source", 0, 0, "s1"), ("source", 2, 0, "s1")]


def test_order_helpers_across_block_borders(spark):
    data = [("hot" if i % 3 else None, i * 7, i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, pos long, v long")
    sums = {(r.k, r.pos): r.s for r in prefix_sum(df, ["k"], "pos", F.col("v"), "s").collect()}
    latest = {(r.k, r.pos): r.m for r in running_max(df, ["k"], "pos", F.when(F.col("v") % 10 == 0, F.col("v")), "m").collect()}
    places = {(r.k, r.pos): r.p for r in with_position(df, ["k"], [-F.col("v")], "p").collect()}
    for key in ("hot", None):
        own = [d for d in data if d[0] == key]
        total, last = 0, None
        for n, (k, pos, v) in enumerate(own):
            assert sums[(k, pos)] == total
            total += v
            last = v if v % 10 == 0 else last
            assert latest[(k, pos)] == last
            assert places[(k, pos)] == len(own) - 1 - n


def test_search_threshold_and_zero_vectors(spark, rows):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], "pos long, vec array<double>")
    assert rows(similarity.search(df, [2.0, 0.0], 3, 0.3), "pos") == [(0,), (2,)]
    many = similarity.search_many(df, spark.createDataFrame([(5, [2.0, 0.0]), (6, [0.0, 0.0])], "query_id long, vec array<double>"), 2, 0.3)
    assert rows(many, "query_id", "pos", "rank") == [(5, 0, 1), (5, 2, 2)]


def test_query_bounds(spark, rows):
    asked = spark.createDataFrame([("a", 0), ("b", None), ("c", 500), ("x" * 10001, 5)], "query string, limit int")
    got = rows(similarity.query_bounds(asked), "limit", "accepted")
    assert got == [(1, True), (10, True), (100, True), (5, False)] or sorted(got) == sorted([(1, True), (10, True), (100, True), (5, False)])


def test_clustered_vectors_are_mostly_not_compared(spark):
    """A job of 60 clusters, most of it copies and near copies, and a small job: all pairs are found, few are looked at."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(60, 32))
    near = [centres[i % 60] + draw.normal(size=32) * 0.2 for i in range(2400)]
    data = [("big", i, v.tolist()) for i, v in enumerate(near)] + [("big", 2400 + i, near[7].tolist()) for i in range(50)]
    data += [("small", i, v.tolist()) for i, v in enumerate(near[:40])]
    df = spark.createDataFrame(data, "job_id string, pos long, vec array<double>")
    base, _ = similarity.representatives(df)
    met = similarity.units(similarity.placed(base, 0.8, 64), 64).groupBy("job_id", "cell", "chunk", "part").agg(
        F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    compared = met.agg(F.sum(F.col("h") * F.col("g") + F.when(F.col("part") == 0, F.col("h") * F.col("h") / 2).otherwise(0))).first()[0]
    assert compared < 0.1 * 2400**2 / 2
    got = {(r.job_id, r.a, r.b) for r in similarity.similar_pairs(df, 0.8, block_rows=64).collect()}
    unit = np.array(near) / np.linalg.norm(near, axis=1, keepdims=True)
    sims = unit @ unit.T
    want = {("big", int(a), int(b)) for a, b in np.argwhere(np.triu(sims >= 0.8, 1))} | {("big", 7, 2400 + i) for i in range(50)}
    want |= {("small", int(a), int(b)) for a, b in np.argwhere(np.triu(sims[:40, :40] >= 0.8, 1))}
    assert got == want


def test_vectors_without_clusters_are_joined_whole(spark):
    draw = np.random.default_rng(9)
    data = [("j", i, draw.normal(size=6).tolist()) for i in range(500)]
    df = spark.createDataFrame(data, "job_id string, pos long, vec array<double>")
    vec = np.array([d[2] for d in data])
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    for threshold, block in ((0.7, 8), (0.2, 16), (0.95, 4)):
        got = {(r.a, r.b) for r in similarity.similar_pairs(df, threshold, block_rows=block).collect()}
        assert got == {(int(a), int(b)) for a, b in np.argwhere(np.triu(unit @ unit.T >= threshold, 1))}


def test_long_chains_take_few_rounds(spark, caplog):
    """A chain in order of ids shrinks to a link per task before the first round; one in random order still ends."""
    for seed, most in ((None, 4), (5, 12)):
        order = np.arange(100_000)
        if seed:
            np.random.default_rng(seed).shuffle(order)
        edges = spark.createDataFrame(pd.DataFrame({"job_id": "j", "a": order[:-1], "b": order[1:]}), "job_id string, a long, b long")
        caplog.clear()
        with caplog.at_level("INFO", logger="citeloom.operators.graph"):
            got = graph.connected_components(edges.select("job_id", F.col("a").alias("pos")), edges)
            assert got.agg(F.min("component"), F.max("component"), F.count("*")).first() == (0, 0, 99_999)
        assert len(caplog.records) <= most + 1


def test_components_of_null_jobs_and_forests_in_parts(spark, monkeypatch):
    edges = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("x", 3, 2), ("x", 9, 9), ("x", 5, 4)], "job_id string, a long, b long")
    nodes = spark.createDataFrame([("x", i) for i in (2, 3, 4, 5, 9)], "job_id string, pos long")
    assert {(r.pos, r.component) for r in graph.connected_components(nodes, edges).collect()} == {(2, 2), (3, 2), (4, 4), (5, 4), (9, 9)}
    node, root = graph._roots(np.array([5, 9, 7, 3]), np.array([3, 7, 5, 1]))
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {3: 1, 5: 1, 7: 1, 9: 1}


def test_vectors_without_clusters_are_not_copied_per_block(spark):
    """Dividing near-orthogonal vectors spares no comparison: they stay in one cell, and a vector goes to few units however small the blocks are."""
    draw = np.random.default_rng(4)
    df = spark.createDataFrame([("j", i, v.tolist()) for i, v in enumerate(draw.normal(size=(1500, 64)))], "job_id string, pos long, vec array<double>")
    base, _ = similarity.representatives(df)
    assert similarity.units(similarity.placed(base, 0.35, 8), 8).count() < 2 * 1500


def test_copies_have_equal_scores_in_a_search_by_one_vector(spark):
    """Scores of copies must not depend on their place, or else they are not listed by position."""
    draw = np.random.default_rng(0)
    own = draw.normal(size=(300, 64))
    dealt = draw.integers(0, 300, 5003).tolist()
    corpus = spark.createDataFrame([(i, own[k].tolist()) for i, k in enumerate(dealt)], "pos long, vec array<double>")
    for query in range(4):
        found = similarity.search_many(corpus, spark.createDataFrame([(0, own[query].tolist())], "query_id long, vec array<double>"), 1500, 0.0)
        scores = {}
        for r in found.collect():
            scores.setdefault(dealt[r["pos"]], set()).add(r["score"])
        assert len(scores) > 50 and all(len(s) == 1 for s in scores.values())


def test_guests_are_taken_in_stretches_of_the_rows_they_meet(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = [("j", pos, [float(x) for x in rng.normal(size=4)], []) for pos in range(1500)]
    df = spark.createDataFrame(data, VEC)
    monkeypatch.setattr(similarity, "UNIT_VALUES", 4)
    monkeypatch.setattr(similarity, "VISITS", -1)  # the cell stays whole
    sizes = spark.sparkContext.accumulator(0)

    class Side(similarity._Side):
        def __init__(self, rows, entities):
            super().__init__(rows, entities)
            if len(rows) > 400:
                sizes.add(1)

    monkeypatch.setattr(similarity, "_Side", Side)
    got = {(r.a, r.b) for r in similarity.similar_pairs(df, 0.9, block_rows=300).collect()}
    unit = np.array([v for _, _, v, _ in data])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    one, other = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    assert got == set(zip(one.tolist(), other.tolist(), strict=True)) and sizes.value == 0


def test_blocks_of_queries_and_corpus_meet_in_any_task(spark, monkeypatch):
    """Block numbers of both sides are dealt alike, also when every partition is a task of its own."""
    draw = np.random.default_rng(2)
    own, asked = draw.normal(size=(300, 8)), draw.normal(size=(40, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "pos long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<double>")
    monkeypatch.setattr(similarity, "CORPUS_BLOCK", 40)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 10)
    sims = (own / np.linalg.norm(own, axis=1, keepdims=True)) @ (asked / np.linalg.norm(asked, axis=1, keepdims=True)).T
    want = {(j, int(i), n) for j in range(40) for n, i in enumerate(np.argsort(-sims[:, j])[:5], 1)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = similarity.search_many(corpus, queries, 5, -1.0).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["query_id"], r["pos"], r["rank"]) for r in found} == want


def test_scores_are_rounded_as_in_sql():
    """The quotient by the root of both squared lengths: on vectors of floats equal to the SQL in the last bit, so that near ties come in its order."""
    duckdb = pytest.importorskip("duckdb")
    draw = np.random.default_rng(1)
    left, right = (draw.normal(size=(500, 64)).astype("float32").astype("float64") for _ in range(2))
    left[:100] = right[:100] * 2
    db = duckdb.connect()
    db.register("pairs", pd.DataFrame({"i": np.arange(500), "a": list(left), "b": list(right)}))
    want = [s for _, s in db.execute("select i, list_cosine_similarity(a::double[], b::double[]) from pairs order by i").fetchall()]
    assert similarity._cosines(left, right).tolist() == want
    tiny = np.array([[1e-100, 0.0], [0.0, 0.0]])
    assert similarity._cosines(tiny, tiny[[0, 0]]).tolist() == pytest.approx([1.0, 0.0])


def test_every_pair_of_copies_is_returned_when_asked(spark):
    """Copies, also of rows that come twice, are in all pairs of their own; rows with one position are no pair."""
    rng = np.random.default_rng(8)
    own = rng.normal(size=(30, 4))
    data = [(("j", "k")[p % 2], p, own[p % 17].tolist(), [f"e{p % 3}"]) for p in range(90)]
    data += data[:5] + [("j", 2, own[29].tolist(), ["e1"]), ("j", 91, own[4].tolist(), None), ("j", 92, own[4].tolist(), None),
                        (None, 93, own[4].tolist(), ["e1"]), ("j", None, own[4].tolist(), ["e1"]), ("j", 94, [float("nan")] * 4, ["e1"]), ("j", 95, [0.0] * 4, ["e1"])]
    df = spark.createDataFrame(data, VEC)
    usable = [d for d in data if d[0] and d[1] is not None and np.nansum(np.abs(d[2])) > 0]
    want = Counter()
    for job, a, va, ea in usable:
        for other, b, vb, eb in usable:
            if job == other and a < b and np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb) >= (0.6 if set(ea or ()) & set(eb or ()) else 0.8):
                want[job, a, b] += 1
    for block in (2048, 8):
        assert Counter((r.job_id, r.a, r.b) for r in similarity.similar_pairs(df, 0.8, 0.6, block_rows=block, every=True).collect()) == want
    labels = {(r.job_id, r.pos): r.component for r in graph.connected_components(
        df.filter("job_id is not null and pos is not null"), similarity.similar_pairs(df, 0.8, 0.6)).collect()}
    assert {k: v for k, v in labels.items()} == union_find({(d[0], d[1]) for d in data if d[0] and d[1] is not None}, want)


def test_registered_pairs_of_copies_match_their_sql(spark, tmp_path):
    import citeloom.catalog.themes  # noqa: F401  registers the queries
    from citeloom.catalog.registry import ORACLES, QUERIES

    duckdb = pytest.importorskip("duckdb")
    own = np.random.default_rng(3).normal(size=(40, 8)).astype("float32")
    table = pa.table({"vec_id": pa.array(range(120)), "embedding": pa.array([own[i % 40].tolist() for i in range(120)], pa.list_(pa.float32())), "label": pa.array([i % 3 for i in range(120)], pa.int32())})
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    for name in ("similar_pairs", "similar_pairs_blocked"):
        got = QUERIES[name](spark, str(tmp_path)).select("job_id", "a", "b", "cosine").collect()
        want = db.execute(f"select job_id, a, b, cosine from ({ORACLES[name]})").fetchall()
        assert len(want) > 300 and sorted(map(tuple, got)) == sorted(want)


def test_word_vectors_of_odd_texts_match_their_sql(spark, tmp_path):
    """Texts without words have no row, those of one id are counted together, and words are lowered character by character."""
    import citeloom.catalog.themes  # noqa: F401  registers the queries
    from citeloom.catalog.registry import ORACLES, QUERIES

    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "One two\tTWO\r\n one"), (2, None), (3, ""), (4, " \t\n "), (5, "a b c"), (5, "B d"), (5, None), (None, "x"), (None, "X y"),
            (6, "\u0130stanbul \u039f\u0394\u039f\u03a3 \u00c9t\u00c9 \u03a3"), (7, "i\u0307 \u03bf\u03b4\u03bf\u03c2"), (8, "a\u00a0b\x0bc \x00 d")]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = db.execute(f"select doc_id, vec from ({ORACLES['with_vectors']})").fetchall()
    got = QUERIES["with_vectors"](spark, str(tmp_path)).select("doc_id", "vec").collect()
    assert len(want) == 6 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
