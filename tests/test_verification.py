from pyspark.sql import functions as F

from citeloom.operators import checks, corpus, evals, gates, grounding, views
from citeloom.plans import jobs

SCORES = "theme_id string, sentence_pos int, claim_pos int, claim_id string, contradiction double, entailment double, neutral double"


def test_verdict_boundaries_and_ties(spark, rows):
    data = [("t", 0, 0, "a", 0.9, 0.7, 0.0), ("t", 1, 0, "a", 0.7, 0.1, 0.2), ("t", 1, 1, "b", 0.7, 0.69, 0.0), ("t", 2, 0, "a", 0.1, 0.5, 0.4),
            ("t", 2, 1, "b", 0.1, 0.5, 0.4), ("t", 3, 0, "a", 0.0, 0.2, 0.8), ("t", 3, 1, "b", 0.0, 0.99, 0.0)]
    got = rows(grounding.grounding_verdict(spark.createDataFrame(data, SCORES), ["theme_id", "sentence_pos"]), "sentence_pos", "verdict", "best_claim_id")
    assert got == [(0, "grounded", "a"), (1, "contradicted", "a"), (2, "borderline", "a"), (3, "grounded", "b")]


def test_labels_apply_to_every_row_with_the_text(spark, rows):
    verdicts = spark.createDataFrame([("t", "s", "borderline", "deberta"), ("t", "s", "grounded", "deberta"), ("t", "u", "contradicted", "deberta"), ("x", "s", "grounded", "deberta")],
                                     "theme_id string, sentence string, verdict string, resolved_by string")
    labels = spark.createDataFrame([("t", "s", "NEUTRAL"), ("t", "u", "ENTAILED"), ("x", "s", "ENTAILED")], "theme_id string, sentence string, label string")
    got = rows(grounding.resolve_borderline(verdicts, labels), "theme_id", "sentence", "verdict", "resolved_by")
    assert got == [("t", "s", "contradicted", "llm_as_nli")] * 2 + [("t", "u", "contradicted", "deberta"), ("x", "s", "grounded", "deberta")]


def test_sections_move_to_gaps_unless_theme_has_no_claims(spark, rows):
    reviews = spark.createDataFrame([("t", ["c1", "c2"], ["d1"], ["g"]), ("none", ["c1"], [], ["g"]), ("empty", [], [], [])],
                                    "theme_id string, consensus array<string>, disagreements array<string>, gaps array<string>")
    labels = spark.createDataFrame([("t", "CONSENSUS", 0, "NEITHER"), ("t", "CONSENSUS", 1, "CONSENSUS"), ("t", "DISAGREEMENT", 0, "CONSENSUS")],
                                   "theme_id string, kind string, at int, label string")
    claims = spark.createDataFrame([("t",), ("t",), ("empty",)], "theme_id string")
    got = rows(grounding.verify_sections(reviews, labels, claims))
    assert got == [("empty", [], [], []), ("none", ["c1"], [], ["g"]),
                   ("t", ["c2"], [], ["g", "Not verified as consensus: c1", "Not verified as disagreement: d1"])]


def test_pairs_and_provenance(spark, rows):
    reviews = spark.createDataFrame([("t", "One. Two!"), ("u", " ")], "theme_id string, review string")
    claims = spark.createDataFrame([("t", "a", 0.65), ("t", "b", 0.649), ("u", "c", 0.9)], "theme_id string, claim_id string, score double")
    assert rows(grounding.sentence_claim_pairs(reviews, claims), "claim_id", "sentence_pos", "sentence") == [
        ("a", 0, "One."), ("a", 1, "Two!"), ("b", 0, "One."), ("b", 1, "Two!")]
    themes = spark.createDataFrame([("t",), ("v",)], "theme_id string")
    counted, kept, dropped = grounding.provenance_filter(themes, claims)
    assert rows(counted) == [("t", 1), ("v", 0)] and rows(kept, "claim_id") == [("a",), ("c",)] and rows(dropped, "claim_id") == [("b",)]


def toxic(spark, scores, **kw):
    reviews = spark.createDataFrame([("j", "T", "")], "job_id string, title string, abstract string")
    sections = spark.createDataFrame([("j", 0, "t0", "", "bad"), ("j", 1, "t1", "One", "bad"), ("j", 2, "t2", "Two", "")],
                                     "job_id string, section_pos long, theme_id string, label string, content string")
    df = spark.createDataFrame(scores, "job_id string, field string, section_pos long, score double, passed boolean")
    return gates.toxic_gate(reviews, sections, df, **kw).first()


def test_toxic_gate(spark):
    assert toxic(spark, [], enabled=False).verdict == "pass"
    assert toxic(spark, []).reason == "toxic-gate service unreachable"
    assert toxic(spark, [("j", "combined", None, 0.0, True)]).verdict == "pass"
    assert toxic(spark, [("j", "combined", None, 0.5, False)]).reason == "toxic content detected"
    many = [("j", "combined", None, 0.5, False), ("j", "title", None, 0.5, False), ("j", "abstract", None, 0.5, False)] + [
        ("j", "section", p, 0.5, False) for p in (0, 1, 2)]
    assert toxic(spark, many).reason == "toxic content detected in: title, section '', section 'One'".replace("section ''", "section 't0'")


def test_judge_gate_and_chain(spark, rows):
    reviews = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "job_id string")
    scores = spark.createDataFrame([("a", "faithfulness", 0.7), ("a", "citation_accuracy", 0.7), ("b", "faithfulness", 0.69), ("b", "citation_accuracy", 0.1),
                                    ("c", "faithfulness", 0.9)], "job_id string, metric string, score double")
    got = {r.job_id: r.reason for r in gates.judge_gate(reviews, scores).collect()}
    assert got == {"a": None, "b": "judge gate failed rubric item(s): faithfulness, citation_accuracy", "c": "judge service unreachable", "d": "judge service unreachable"}
    assert rows(gates.judge_gate(reviews, scores, enabled=False), "verdict") == [("pass",)] * 4
    blocked = spark.createDataFrame([("a", "pass", None, 0.0), ("b", "quarantine", "toxic!", 0.9), ("c", "pass", None, 0.0), ("d", "pass", None, 0.0)],
                                    "job_id string, verdict string, reason string, score double")
    chain = rows(gates.gate_chain(reviews, blocked, scores), "job_id", "gate", "status")
    assert chain == [("a", None, "completed"), ("b", "toxic", "quarantined"), ("c", "judge", "quarantined"), ("d", "judge", "quarantined")]


def test_topic_gate(spark, rows):
    papers = spark.createDataFrame([(1, "x" * 50, 1, "t", ["a"]), (2, "x" * 49, 1, "t", ["a"]), (3, "x" * 50, 1, "", ["a"]), (4, "x" * 50, 1, "t", []), (5, "x" * 50, 0, "t", ["a"])],
                                   "paper_id int, content string, page_count int, title string, authors array<string>")
    assert rows(gates.topic_gate(papers), "paper_id", "verdict") == [(1, "accept")] + [(i, "reject") for i in (2, 3, 4, 5)]


def test_sample_sizes(spark):
    for n, want in ((1, 1), (9, 1), (10, 1), (19, 1), (20, 2), (1000, 100)):
        df = spark.range(n)
        got = evals.sample_exact(df, "id")
        assert got.count() == want and got.distinct().count() == want
    assert {r.id for r in evals.sample_exact(spark.range(50), "id").collect()} == {r.id for r in evals.sample_exact(spark.range(50).repartition(7), "id").collect()}


def test_completeness(spark):
    full = '{"title":"t","abstract":"a","sections":[{"theme_id":"1","label":"l","content":"c"}],"citations":[1],"references":[1]}'
    cases = [full, "nope", '{"title":"t","sections":[]}', full.replace('"content":"c"', '"content":""'), full.replace('"title":"t"', '"title":0')]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, review_json string")
    got = [(round(r.score, 6), r.reason) for r in sorted(evals.schema_completeness(df).collect(), key=lambda r: r.i)]
    assert got == [(1.0, "All required fields present"), (0.0, "Output is not valid JSON"), (0.12, "Missing fields: abstract, sections, citations, references"),
                   (round(0.6 + 0.4 * 2 / 3, 6), "All required fields present"), (0.88, "Missing fields: title")]


def test_residual_error_totals(spark):
    themes = spark.createDataFrame([("a",), ("b",)], "theme_id string")
    grounding_rows = spark.createDataFrame([("a", "grounded", "deberta"), ("a", "contradicted", "llm_as_nli"), ("a", "borderline", "odd")], "theme_id string, verdict string, resolved_by string")
    gaps = spark.createDataFrame([("b", "Not verified as consensus: x"), ("b", "plain")], "theme_id string, entry string")
    got = {r.theme_id: (r.sentences, r.grounded, r.contradicted, r.nli_downgrades, r.verdict) for r in evals.residual_error(themes, grounding_rows, gaps).collect()}
    assert got == {"a": (3, 1, 1, 0, "GO"), "b": (0, 0, 0, 1, "GO"), None: (3, 1, 1, 1, "GO")}


def test_checks(spark, rows):
    df = spark.createDataFrame([("a", "", ["x"]), ("b", None, []), ("c", "t", ["x"])], "k string, t string, l array<string>")
    assert rows(checks.non_empty(df, "tbl", "k", ["t", "l"]), "key", "rule") == [("a", "t is empty"), ("b", "l is empty"), ("b", "t is empty")]
    labels = spark.createDataFrame([("a", "running"), ("b", "odd"), ("c", None)], "k string, s string")
    assert rows(checks.label_domain(labels, "tbl", "k", "s", "job_state"), "key") == [("b",), ("c",)]
    messages = spark.createDataFrame([(" \n",), ("x" * 10001,), ("x" * 10000 + " ",)], "text string")
    assert rows(checks.message_limits(messages), "reason") == [("Message cannot be empty",), ("Message too long (max 10000 characters)",)]


def test_scroll_and_failures(spark, rows):
    df = spark.range(5).withColumn("k", F.col("id") % 2)
    assert rows(corpus.scroll(df, "id", F.col("k") == 0, 2), "id", "truncated") == [(0, True), (2, True)]
    assert rows(corpus.scroll(df, "id", None, 5), "truncated") == [(False,)] * 5
    chunks = spark.createDataFrame([("j", 1, True), ("j", 1, False), ("j", 2, True), ("k", 3, True)], "job_id string, paper_id int, failed boolean")
    papers, jobs = corpus.failure_policy(chunks)
    assert rows(papers, "paper_id", "paper_failed") == [(1, False), (2, True), (3, True)]
    assert rows(jobs, "job_id", "successful", "failed", "stage_failed") == [("j", 1, 1, False), ("k", 0, 1, True)]
    contents = corpus.load_chunks(spark.createDataFrame([(1,), (2,), (3,)], "paper_id int"), spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "paper_id int, chunk int, content string"),
                                  spark.createDataFrame([(1, "whole"), (2, "w2")], "paper_id int, content string"))
    assert rows(contents) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "w2"), (3, 0, "")]


def test_review_text_parts_join_to_the_whole(spark):
    review = spark.createDataFrame([("j", "T", "A"), ("k", "T", "")], "job_id string, title string, abstract string")
    sections = spark.createDataFrame([("j", i, f"L{i}", f"c{i}") for i in range(5)], "job_id string, section_pos long, label string, content string")
    parts = [r.text for r in sorted(views.review_text(review, sections, block=2).filter("job_id = 'j'").collect(), key=lambda r: r.part)]
    assert "\n\n".join(parts) == "# T\n\nA\n\n" + "\n\n".join(f"## L{i}\nc{i}" for i in range(5))
    shown = views.review_markdown(review, sections, block=2)
    assert shown.filter("job_id = 'k'").count() == 0 and shown.filter("part = -1").first().text == "*A*"


def test_reviews_are_not_planned_as_broadcasts(spark, rows, tmp_path):
    """All sides of the joins of reviews grow with the input, and their files are far smaller than what the driver would hold of them."""
    def stored(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    key = F.col("id").cast("string")
    parts = stored("parts", spark.range(300))
    batch = F.floor(F.col("id") / 5)
    reviews = parts.select(batch.alias("batch"), F.col("id").alias("review_no"), F.concat(F.lit("theme__"), key).alias("theme_name"), F.concat(F.lit("x@y.org on "), key).alias("review"),
                           F.array(F.concat(F.lit("a"), key), F.lit("b")).alias("consensus"), F.array(F.lit("c")).alias("disagreements"), F.array(F.lit("g")).alias("gaps"))
    named = parts.select(batch.alias("batch"), F.col("id").alias("pos"), key.alias("theme_id"), F.concat(F.lit("Theme "), key).alias("name"))
    claims = stored("claims", spark.range(0, 300, 3).select(key.alias("theme_id"), F.concat(F.lit("c"), key).alias("claim_id")))
    labels = parts.select(key.alias("theme_id"), F.lit("CONSENSUS").alias("kind"), F.lit(0).alias("at"), F.lit("CONSENSUS").alias("label"))
    scores = claims.select("theme_id", F.lit(0).alias("sentence_pos"), F.lit("S").alias("sentence"), F.lit(0).alias("claim_pos"), "claim_id",
                           F.lit(0.1).alias("contradiction"), F.lit(0.2).alias("entailment"), F.lit(0.7).alias("neutral"))
    second = parts.select(key.alias("theme_id"), F.lit("S").alias("sentence"), F.lit("ENTAILED").alias("label"))
    cited = claims.select(F.lit("0").alias("batch"), F.lit("n").alias("theme_name"), "claim_id")
    told = jobs.review_themes(reviews, named, cited, cited.drop("theme_name"), claims, labels, scores, second)
    for df in (told.reviews, told.grounding):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["theme_id"]: r for r in told.reviews.collect()}
    assert len(got) == 300 and got["7"]["consensus"] == ["a7", "b"] and got["7"]["gaps"] == ["g"]
    assert got["9"]["label"] == "Theme 9" and got["9"]["review"] == "[EMAIL] on 9" and got["9"]["consensus"] == ["a9"] and got["9"]["disagreements"] == []
    assert got["9"]["gaps"] == ["g", "Not verified as consensus: b", "Not verified as disagreement: c"]
    assert rows(told.grounding, "verdict", "resolved_by") == [("grounded", "llm_as_nli")] * 100
