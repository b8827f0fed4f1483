"""Sections checked in one step against the single steps, and positions without dealing rows twice."""

from pyspark.sql import functions as F

from citeloom.functions.ordered import with_position
from citeloom.operators import citations as ops
from tests.test_citations import plan_of

SECTIONS = "job_id string, section_pos long, theme_id string, label string, content string, citation_refs array<bigint>"


def test_checked_sections_equal_the_single_steps(spark):
    sections = spark.createDataFrame([
        ("j", 0, "a", "L", "One [1], [02] and [1] [99]  .", [1, 2, 99]),
        ("j", 1, "b", "L", "Other order [3] [2] [123456789012345678901234567890]", [2, 3, 2]),
        ("j", 2, "c", "L", None, [1]), ("j", 3, "d", "L", "No numbers", None), ("j", 4, "e", "L", "[1]", []), ("j", 5, "f", "L", "x [50][2]", [4, 50]),
        (None, 6, "g", "L", "[1] [2]", [1]), ("k", 0, "h", "L", "[1][7][1]", [1, 1])], SECTIONS)
    cites = spark.createDataFrame([
        ("j", 1, "c1", "p"), ("j", 2, "c2", "p"), ("j", 3, "gone", "p"), ("j", 50, "c5", "p"), ("k", 1, "c1", "p")],
        "job_id string, ref_number long, claim_id string, paper_id string")
    claims = spark.createDataFrame([
        ("j", "c1", 1, 4, 5), ("j", "c1", 2, 6, 7), ("j", "c2", 1, 8, None), ("j", "c5", 1, None, 1), ("k", "c1", 1, 2, 3)],
        "job_id string, claim_id string, pos long, page int, paragraph int")
    merged = ops.placed(cites, claims)
    stripped, valid = ops.strip_invalid_citations(sections, merged, claims)
    chain = ops.collect_claim_ids(ops.resolve_citations(stripped, valid, claims), valid)
    chain = chain.join(ops.orphan_refs(sections, merged).select("theme_id", "missing"), "theme_id", "left")
    columns = ["theme_id", "content", "citation_refs", "claim_ids", "missing"]
    want = sorted(map(tuple, chain.select(*columns).collect()), key=str)
    assert sorted(map(tuple, ops.checked_sections(sections, merged).select(*columns).collect()), key=str) == want


def test_positions_do_not_deal_the_rows_again(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    placed = with_position(df, ["k"], [F.col("v")], "p")
    assert "Window" not in plan_of(placed) and "SortMergeJoin" not in plan_of(placed)
    own = {}
    for r in placed.orderBy("k", "v").collect():
        assert r.p == own.get(r.k, 0)
        own[r.k] = r.p + 1
    assert sorted(own.values()) == [333, 333, 334]


def test_first_place_of_a_claim_is_not_sorted_for(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ops, "materialise", lambda df: seen.append(plan_of(df)) or df)
    rows = [("j", 2, 1, "a"), ("j", 1, 9, "a"), ("j", 1, 4, "a"), ("j", 1, 5, "b"), ("j", None, 3, "c"), ("j", 1, None, "d")]
    got = ops.assign_ref_numbers(spark.createDataFrame(rows, "job_id string, review_pos long, kc_pos long, claim_id string"))
    assert {r.claim_id: r.ref_number for r in got.collect()} == {"c": 1, "d": 2, "a": 3, "b": 4}
    assert len(seen) == 1 and "SortAggregate" not in seen[0]


def test_points_are_embedded_once(spark, monkeypatch, tmp_path):
    import __spark_entry__  # noqa: F401  registers the queries in their order
    from citeloom.catalog import live
    from citeloom.catalog.stand_ins import Tables

    written = []
    upsert = live.entities.upsert
    monkeypatch.setattr(live.entities, "upsert", lambda s, root, name, df, **more: written.append(plan_of(df)) or upsert(s, root, name, df, **more))
    points = spark.createDataFrame([("1", "j", "a b"), ("9", "j", "c")], "id string, job_id string, text string")
    found = live.indexed(Tables(spark, str(tmp_path)), "literature_review", points, order="job_id")
    assert sorted(map(tuple, found.collect())) == [("1", "a b", 8), ("9", "c", 8)]
    assert len(written) == 2 and not any("ArrowEvalPython" in plan for plan in written)
