"""Null, late, repeated and hot-key rows, and inputs larger than a block."""

import numpy as np
from pyspark.sql import functions as F

from citeloom.operators import chunking, citations, events, messages, similarity, themes, views
from citeloom.sources import entities


def text_of(lines):
    return [r.line for r in lines.orderBy(*messages.LINE_KEY).collect()]


def test_theme_message_keeps_claims_with_missing_values(spark):
    themes_df = spark.createDataFrame([("j", 0, 0, "t", None, None, [])], "job_id string, batch int, at int, canonical_id string, name string, description string, aliases array<string>")
    claims = spark.createDataFrame(
        [("t", None, 1, "c1", "x", None, None, None, None), ("t", None, 2, None, None, 3, 4, "d", None), ("t", "p", 3, "c3", "long", 1, 1, None, "short")],
        "canonical_id string, paper_id string, pos long, claim_id string, text string, page int, paragraph int, deep string, summary string")
    got = text_of(messages.theme_message(themes_df, claims))
    assert got == [
        "Analyze the following 1 themes:", "", '<theme id="t" name="Unknown">', "DESCRIPTION: ", "PAPERS: 2 paper(s), 3 claims", "",
        "  Paper: unknown", '  <claim id="c1" paper="unknown" page="?" paragraph="?">x</claim>', '  <claim id="?" paper="unknown" page="3" paragraph="4"></claim>',
        "      Context: d", "", "  Paper: p", '  <claim id="c3" paper="p" page="1" paragraph="1">short</claim>', "", "</theme>", ""]


def test_section_message_keeps_lines_with_missing_values(spark):
    reviews = spark.createDataFrame([("j", 0, 0, None, None, [None, "a"], None, None)],
                                    "job_id string, batch int, at int, label string, review string, consensus array<string>, disagreements array<string>, gaps array<string>")
    kc = spark.createDataFrame([("j", 0, 0, 1, 7, "c", None, None)],
                               "job_id string, batch int, at int, kc_pos long, ref_number long, claim_id string, paper_id string, summary string")
    claims = spark.createDataFrame([("j", "c", 1, None, 2)], "job_id string, claim_id string, pos long, page int, paragraph int")
    got = text_of(messages.section_message(reviews, kc, claims))
    assert "--- THEME 1: Theme 1 ---" in got and "  - " in got and "  [7]  (paper: , p.?,§2)" in got and "  [7] claim_id=c paper_id=" in got


def test_title_abstract_message(spark):
    rows = spark.createDataFrame([("j", 1, None, "b"), ("j", 0, "A", None)], "job_id string, section_pos long, label string, content string")
    assert text_of(messages.title_abstract_message(rows)) == ["=== SECTIONS ===", "", "--- A ---", "", "", "---  ---", "b", ""]


def test_ref_numbers_of_a_hot_review(spark):
    """One review holds most key claims, one claim is cited again and again, one has no id."""
    rows = [("j", 0, k, f"c{k:05d}") for k in range(5000)] + [("j", 1, k, "c00007") for k in range(200)] + [("j", 2, 0, None), ("k", 0, 0, "c1")]
    got = citations.assign_ref_numbers(spark.createDataFrame(rows, "job_id string, review_pos long, kc_pos long, claim_id string"))
    numbers = {(r.job_id, r.claim_id): r.ref_number for r in got.collect()}
    assert numbers == {("j", f"c{k:05d}"): k + 1 for k in range(5000)} | {("j", ""): 5001, ("k", "c1"): 1}


def test_last_citation_is_the_last_in_order(spark):
    rows = spark.createDataFrame([("j", 1, "z", 0), ("j", 1, "a", 5)], "job_id string, ref_number long, claim_id string, pos long")
    assert citations.last_citations(rows).first().claim_id == "a" and citations.last_citations(rows.drop("pos")).first().claim_id == "z"


def test_packing_is_linear_and_handles_nulls(spark):
    many = "\n\n".join(f"block {i}" for i in range(50_000))
    docs = spark.createDataFrame([(1, many), (2, None), (3, ""), (4, "a" * 100 + "\n\n\n\nb")], "paper_id long, content string")
    got = chunking.pack_under_budget(docs, F.lit(20)).collect()
    assert "\n\n".join(r.content for r in sorted(got, key=lambda r: r.part) if r.paper_id == 1) == many
    assert all(sum(len(b) // 4 for b in r.content.split("\n\n")) <= 20 for r in got if r.paper_id == 1)
    assert [(r.paper_id, r.part, r.content) for r in sorted(got, key=lambda r: (r.paper_id, r.part)) if r.paper_id > 1] == [
        (2, 0, ""), (3, 0, ""), (4, 0, "a" * 100), (4, 1, "b")]


def test_replay_pages_above_a_thousand(spark):
    log = spark.createDataFrame([(str(i), "j", i) for i in range(3000)], "event_id string, job_id string, seq long")
    got = events.events_after(log, spark.createDataFrame([("j", "99")], "job_id string, marker string"), 2500)
    assert [r.seq for r in got.orderBy("rank").collect()] == list(range(100, 2600))


def test_buckets_of_a_large_component(spark):
    rows = [("j", i, [1.0, float(i % 5)]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "job_id string, pos long, vec array<double>")
    parts = themes.cap_buckets(vectors.select("job_id", "pos", F.lit(0).cast("long").alias("component")), vectors, 20).groupBy("sub").count().collect()
    assert sorted(r["count"] for r in parts) == [16, 17, 17]


def test_copies_and_small_blocks_give_the_groups_of_all_pairs(spark):
    rows = [("j", i, [1.0, float(i // 4)]) for i in range(24)]
    vectors = spark.createDataFrame(rows, "job_id string, pos long, vec array<double>")
    for block in (2048, 3):
        found = {(r.a, r.b) for r in similarity.similar_pairs(vectors, 0.9999, block_rows=block).collect()}
        assert found == {(i // 4 * 4, i) for i in range(24) if i % 4} | {(a, b) for a, b in found if a % 4 == 0 and b % 4 == 0}


def test_batch_search_with_more_queries_than_a_slice(spark):
    corpus = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)] + [(99, None)], "pos long, vec array<double>")
    asked = spark.createDataFrame([(q, [float(q % 11), 1.0]) for q in range(1500)] + [(1500, None)], "query_id long, vec array<double>")
    got = similarity.search_many(corpus, asked, 2, 0.1)
    assert similarity.search_many(corpus, asked.limit(0), 2, 0.1).count() == similarity.search_many(corpus.limit(0), asked, 2, 0.1).count() == 0
    assert got.count() == 3000 and [r.pos for r in got.filter("query_id = 0").orderBy("rank").collect()] == [0, 7]


def test_batch_search_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CORPUS_BLOCK", 60)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 7)
    draw = np.random.default_rng(1)
    own, other = draw.normal(size=(200, 5)), draw.normal(size=(30, 5))
    corpus = spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in enumerate(own)], "pos long, title string, vec array<double>")
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(other)], "query_id string, vec array<double>")
    sims = (other / np.linalg.norm(other, axis=1, keepdims=True)) @ (own / np.linalg.norm(own, axis=1, keepdims=True)).T
    want = {(f"q{i}", r + 1, int(j), f"t{j}") for i, row in enumerate(sims) for r, j in enumerate(np.lexsort((np.arange(200), -row))[:4]) if row[j] >= 0.5}
    assert {(r.query_id, r["rank"], r.pos, r.title) for r in similarity.search_many(corpus, asked, 4, 0.5).collect()} == want


def test_reader_papers_by_job(spark):
    cites = spark.createDataFrame([("a", 1, "c", "p", "", 1, 1), ("b", 1, "c", "p", "", 1, 1)], "job_id string, ref_number long, claim_id string, paper_id string, paper_title string, page int, paragraph int")
    papers = spark.createDataFrame([("a", "p", "A", None, ["x"]), ("b", "p", "B", None, ["y"])], "job_id string, paper_id string, title string, filename string, authors array<string>")
    claims = spark.createDataFrame([], "job_id string, claim_id string, pos long, summary string, text string, page int, paragraph int")
    assert sorted((r.job_id, r.title) for r in views.review_reader(cites, papers, claims).collect()) == [("a", "A"), ("b", "B")]


def test_upsert_touches_its_buckets_only_and_collapses_repeats(spark, tmp_path):
    root, shape = str(tmp_path), "id string, job_id string, text string, vec array<double>, paper_id string, name string, description string"
    entities.ensure_collections(spark, root)
    entities.upsert(spark, root, "paper_themes", spark.createDataFrame([(str(i), "j", "old", [1.0], "p", "n", "") for i in range(300)], shape))
    before = entities._read_manifest(spark, root, "paper_themes", 1)
    entities.upsert(spark, root, "paper_themes", spark.createDataFrame([("7", "j", t, [1.0], "p", "n", "") for t in ("a", "b")], shape))
    after = entities._read_manifest(spark, root, "paper_themes", 2)
    assert sum(before[k] != after[k] for k in before) == 1 and before.keys() == after.keys()
    rows = {r.id: r.text for r in entities.read_collection(spark, root, "paper_themes").collect()}
    assert len(rows) == 300 and rows["7"] == "b" and rows["8"] == "old"
    written = {v: sum(f.stat().st_size for f in (tmp_path / "paper_themes" / v).rglob("*.parquet")) for v in {f.split("/")[0] for own in after.values() for f in own}}
    assert len(written) == 2 and min(written.values()) < 0.1 * max(written.values())
    assert entities.vacuum(spark, root, "paper_themes", keep=1) == 0
    for n in range(entities.DELTAS + 1):
        entities.upsert(spark, root, "paper_themes", spark.createDataFrame([("7", "j", f"v{n}", [1.0], "p", "n", "")], shape))
        rows = {r.id: r.text for r in entities.read_collection(spark, root, "paper_themes").collect()}
        assert len(rows) == 300 and rows["7"] == f"v{n}" and rows["8"] == "old"
    held = entities._read_manifest(spark, root, "paper_themes", entities.DELTAS + 3)
    assert sorted({len(own) for own in held.values()}) in ([1, 2], [1]) and entities.vacuum(spark, root, "paper_themes", keep=1) >= entities.DELTAS
    assert entities.read_collection(spark, root, "paper_themes").count() == 300
    import pytest
    with pytest.raises(Exception, match="exist"):
        entities._publish(spark, root, "paper_themes", entities.DELTAS + 3, {})
