from pyspark.sql import functions as F

from citeloom.operators import citations as ops

KC = "job_id string, review_pos long, kc_pos int, claim_id string, paper_id string"
SECTIONS = "job_id string, section_pos long, theme_id string, label string, content string, citation_refs array<long>"
CITES = "job_id string, ref_number long, claim_id string, paper_id string"
CLAIMS = "job_id string, claim_id string, pos long, page int, paragraph int"


def test_numbers_follow_first_appearance_and_reuse(spark, rows):
    kc = spark.createDataFrame([
        ("j", 0, 0, "a", "p"), ("j", 0, 1, "b", "p"), ("j", 1, 0, "a", "p"), ("j", 1, 1, None, "p"),
        ("j", 2, 0, "c", "p"), ("j", 2, 1, "", "p"), ("k", 5, 0, "b", "p")], KC)
    got = rows(ops.assign_ref_numbers(kc), "job_id", "claim_id", "ref_number")
    assert got == [("j", "", 3), ("j", "a", 1), ("j", "b", 2), ("j", "c", 4), ("k", "b", 1)]


def test_merge_keeps_first_batch(spark, rows):
    cites = spark.createDataFrame([("j", 1, 0, 7, "late", "p"), ("j", 0, 3, 7, "early", "p"), ("j", 0, 1, 2, "x", "q")],
                                  "job_id string, batch long, pos long, ref_number long, claim_id string, paper_id string")
    assert rows(ops.merge_citations(cites)) == [("j", 2, "x", "q"), ("j", 7, "early", "p")]


def test_orphans_look_at_all_batches_and_ignore_zeros(spark, rows):
    sections = spark.createDataFrame([
        ("j", 0, "t0", "L", "See [2], [01] and [9], [9].", []), ("j", 1, "t1", "L", "none", []), ("j", 2, "t2", "L", "[10][3]", [])], SECTIONS)
    cites = spark.createDataFrame([("j", 1, "a", "p"), ("j", 2, "b", "p")], CITES)
    assert rows(ops.orphan_refs(sections, cites), "theme_id", "missing") == [("t0", [9]), ("t2", [3, 10])]


def test_resolve_rewrites_strips_and_tidies(spark, rows):
    sections = spark.createDataFrame([
        ("j", 0, "t0", "L", "Good [1] and [02] , gone [5] .\n  kept\t\tblank", [1]), ("j", 1, "t1", "L", "a  b ; no marker", []),
        ("j", 2, "t2", "L", "", [])], SECTIONS)
    cites = spark.createDataFrame([("j", 1, "a", "p"), ("j", 2, "unknown", "p")], CITES)
    claims = spark.createDataFrame([("j", "a", 1, 3, 4)], CLAIMS)
    got = dict(rows(ops.resolve_citations(sections, cites, claims), "theme_id", "content"))
    assert got == {"t0": 'Good [1](cite:1 "p.3,§4") and [2](cite:2 "?"), gone.\n kept blank', "t1": "a b; no marker", "t2": ""}


def test_resolve_does_not_touch_text_without_markers_twice(spark, rows):
    text = 'Done [1](cite:1 "p.3,§4").'
    sections = spark.createDataFrame([("j", 0, "t0", "L", "plain text.", [])], SECTIONS)
    once = ops.resolve_citations(sections, spark.createDataFrame([], CITES), spark.createDataFrame([], CLAIMS))
    assert rows(once, "content") == [("plain text.",)] and text


def test_strip_keeps_order_and_empty_lists(spark, rows):
    sections = spark.createDataFrame([("j", 0, "t0", "L", "x", [3, 1, 2]), ("j", 1, "t1", "L", "x", [2]), ("j", 2, "t2", "L", "x", [])], SECTIONS)
    cites = spark.createDataFrame([("j", 1, "a", "p"), ("j", 2, "bad", "p"), ("j", 3, "c", "p")], CITES)
    claims = spark.createDataFrame([("j", "a", 1, 1, 1), ("j", "c", 2, 1, 1)], CLAIMS)
    kept, valid = ops.strip_invalid_citations(sections, cites, claims)
    assert rows(kept, "theme_id", "citation_refs") == [("t0", [3, 1]), ("t1", []), ("t2", [])]
    assert rows(valid, "ref_number") == [(1,), (3,)]
    ids = ops.collect_claim_ids(kept, valid)
    assert rows(ids, "theme_id", "claim_ids") == [("t0", ["c", "a"]), ("t1", []), ("t2", [])]


def test_positions_default_when_unknown(spark, rows):
    cites = spark.createDataFrame([("j", 1, "a", "p"), ("j", 2, "zz", "q")], CITES)
    claims = spark.createDataFrame([("j", "a", 1, 1, 1), ("j", "a", 2, 8, 9)], CLAIMS)
    papers = spark.createDataFrame([("p", "Title", ["A"])], "paper_id string, title string, authors array<string>")
    assert rows(ops.position_lookup(cites, claims, papers), "ref_number", "paper_title", "page", "paragraph") == [(1, "Title", 8, 9), (2, "", 0, 0)]
    refs = rows(ops.build_references(cites, claims, papers), "paper_id", "paper_title", "authors", "first_ref", "page")
    assert refs == [("p", "Title", ["A"], 1, 8), ("q", "", [], 2, 0)]


def test_integrity_names_both_kinds(spark, rows):
    sections = spark.createDataFrame([("j", 0, "t0", "L", "x", [1, 9])], SECTIONS)
    cites = spark.createDataFrame([("j", 1, "nope", "p")], CITES)
    got = rows(ops.citation_integrity(sections, cites, spark.createDataFrame([], CLAIMS)), "path")
    assert got == [("citations.1.claim_id",), ("sections.0.citation_refs.1",)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_sorted_by_the_key_with_most_values(spark):
    cites = spark.createDataFrame([("j", 1, "a", "p"), ("j", 2, "b", "p")], CITES)
    claims = spark.createDataFrame([("j", "a", 1, 3, 4), ("j", "b", 2, 5, 6)], CLAIMS)
    sections = spark.createDataFrame([("j", 0, "t0", "L", "Good [1] and [02].", [1])], SECTIONS)
    looked_up = ops.latest_claims(claims, "page", "paragraph", cited=cites)
    assert "SortAggregate" not in plan_of(looked_up)
    for df in (ops.merge_citations(cites.selectExpr("*", "0L batch", "0L pos")), ops.resolve_citations(sections, cites, claims)):
        assert "Sort [job_id" not in plan_of(df)


def test_text_with_very_many_markers_gets_each_link_by_position(spark, rows):
    text = " ".join(f"[{i}]" for i in range(1, 4001)) + " [007] [5000] [0]"
    sections = spark.createDataFrame([("j", 0, "t0", "L", text, [])], SECTIONS)
    cites = spark.createDataFrame([("j", i, f"c{i}", "p") for i in range(1, 4001)], CITES)
    claims = spark.createDataFrame([("j", f"c{i}", i, i, 1) for i in range(1, 4001)], CLAIMS)
    done = ops.resolve_citations(sections, cites, claims)
    want = " ".join(f'[{i}](cite:{i} "p.{i},§1")' for i in range(1, 4001)) + ' [7](cite:7 "p.7,§1")'
    assert rows(done, "content") == [(want + " ",)]
    assert "map_from_entries" not in plan_of(done)  # looking a number up in a map reads it from the start


def test_claims_numbers_and_sections_of_a_query_are_written_once(spark):
    from citeloom.catalog.stand_ins import Tables

    from tests.conftest import SF

    t = Tables(spark, SF)
    for df in (t.claims, t.sections, t.section_citations):
        assert "Exchange" not in plan_of(df)


def test_aggregation_looks_claims_up_once(spark):
    from citeloom.plans import jobs

    sections = spark.createDataFrame([("j", 0, "t0", "L", "Good [1] and [2].", [1, 2])], SECTIONS).withColumn("review_pos", F.col("section_pos"))
    given = spark.createDataFrame([("j", 0, 0, 1, "a", "p"), ("j", 0, 1, 2, "b", "p")], "job_id string, batch long, pos long, ref_number long, claim_id string, paper_id string")
    claims = spark.createDataFrame([("j", "a", 1, 3, 4)], CLAIMS).withColumn("claim_id", F.concat("claim_id", F.lit("")))
    papers = spark.createDataFrame([("p", "Title", ["A"])], "paper_id string, title string, authors array<string>")
    done = jobs.aggregate(sections, given, claims, papers)
    assert [r.content for r in done.sections.collect()] == ['Good [1](cite:1 "p.3,§4") and.']
    assert [(r.ref_number, r.page) for r in done.citations.collect()] == [(1, 3)] and done.orphans.count() == 0
    for df in (done.sections, done.citations, done.references):
        assert "max_by" not in plan_of(df.select("job_id", *[c for c in ("page", "paragraph", "citation_refs") if c in df.columns]))
