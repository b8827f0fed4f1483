import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import pii
from citeloom.functions import text as X
from citeloom.operators import chunking, layout

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(alphabet="aB c._-\t!?\n#9é", max_size=40), min_size=1, max_size=20)


def column(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", make(F.col("t")).alias("v"))
    return [r.v for r in sorted(df.collect(), key=lambda r: r.i)]


@FEW
@given(TEXTS)
def test_theme_key_matches_plain_python(spark, texts):
    want = [re.sub(r"[\s_\-]+", " ", t.lower().strip()) for t in texts]
    assert column(spark, texts, X.normalize_theme_name) == want


@FEW
@given(TEXTS)
def test_sentences_match_plain_python(spark, texts):
    want = [[s.strip() for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s.strip()] for t in texts]
    assert column(spark, texts, X.split_sentences) == want


@FEW
@given(TEXTS)
def test_tokens_are_a_quarter_of_the_length(spark, texts):
    assert column(spark, texts, X.estimate_tokens) == [len(t) // 4 for t in texts]


@FEW
@given(st.lists(st.lists(st.integers(0, 60), max_size=8), min_size=1, max_size=10), st.integers(1, 15))
def test_packing_keeps_every_block_in_order(spark, papers, budget):
    contents = ["\n\n".join(chr(97 + k % 26) * n for k, n in enumerate(sizes)) for sizes in papers]
    df = spark.createDataFrame(list(enumerate(contents)), "paper_id int, content string")
    parts: dict[int, list[str]] = {}
    for r in sorted(chunking.pack_under_budget(df, F.lit(budget)).collect(), key=lambda r: (r.paper_id, r.part)):
        parts.setdefault(r.paper_id, []).append(r.content)
    for i, content in enumerate(contents):
        blocks = [b for b in content.split("\n\n") if b.strip()]
        want, used = ([[]], 0) if blocks else ([[content]], 0)
        for block in blocks:
            tokens = len(block) // 4
            if want[-1] and used + tokens > budget:
                want.append([])
                used = 0
            want[-1].append(block)
            used += tokens
        assert parts[i] == ["\n\n".join(w) for w in want]


def test_packing_boundaries(spark):
    def pack(text, budget):
        df = spark.createDataFrame([(1, text)], "paper_id int, content string")
        return [r.content for r in sorted(chunking.pack_under_budget(df, F.lit(budget)).collect(), key=lambda r: r.part)]

    assert pack("aaaa\n\nbbbb", 2) == ["aaaa\n\nbbbb"]  # exactly the budget
    assert pack("x" * 40 + "\n\naaaa", 2) == ["x" * 40, "aaaa"]
    assert pack("aaaa\n\n" + "x" * 40 + "\n\nbbbb", 2) == ["aaaa", "x" * 40, "bbbb"]
    assert pack("aaaa\n\n" + "x" * 40, 2) == ["aaaa", "x" * 40]
    assert pack("", 2) == [""] and pack(" \n\n ", 2) == [" \n\n "]


def test_typography_folds(spark):
    assert column(spark, ["ﬁx ﬃ “q” — –… ​﻿z’s ﬅﬆ"], X.normalize_text) == [
        'fix ffi "q" -- -... z\'s ftst']


def test_small_text_functions(spark):
    assert column(spark, ["A; B ;; C", "A, B", " "], X.parse_authors) == [["A", "B", "C"], ["A", "B"], []]
    assert column(spark, ["--Hello, World!--", "a"], X.slugify) == ["hello-world", "a"]
    assert column(spark, ["x" * 200, "y" * 201], X.preview) == ["x" * 200, "y" * 197 + "..."]
    good = "123e4567-e89b-12d3-a456-426614174000"
    assert column(spark, [good, "nope", "{" + good + "}", good.replace("-", "")], X.is_uuid) == [True, False, True, True]
    made = column(spark, ["nope", good], X.point_id)
    assert made[1] == good and re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", made[0])
    df = spark.createDataFrame([(1, 59499), (2, 59500), (3, 185000)], "i int, ms long").select("i", X.format_duration(F.col("ms")).alias("v"))
    assert [r.v for r in sorted(df.collect())] == ["59s", "1m 0s", "3m 5s"]


def test_redaction(spark):
    texts = ["Contact j.rodriguez@example.edu for details.", "Call 555-123-4567 or +1 (743) 555-3824.", "She works in Palo Alto with Robert Chen.", "Clean 12 text."]
    terms = {"locations": ["Palo Alto"], "persons": ["Robert Chen"]}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out, types = pii.scrub(F.col("t"), pii.OUTPUT_SCOPE, **terms)
    got = [(r.o, r.k) for r in sorted(df.select("i", out.alias("o"), types.alias("k")).collect(), key=lambda r: r.i)]
    assert got == [("Contact [EMAIL] for details.", ["EMAIL_ADDRESS"]), ("Call [PHONE] or [PHONE].", ["PHONE_NUMBER"]),
                   ("She works in [LOCATION] with [PERSON].", ["LOCATION", "PERSON"]), ("Clean 12 text.", [])]
    narrow = df.select("i", pii.scrub(F.col("t"), pii.INPUT_SCOPE, **terms)[0].alias("o")).filter("i = 2").first().o
    assert narrow == "She works in [LOCATION] with Robert Chen."
    assert column(spark, ["Palo Alto or palo alto, X"], lambda c: pii.entities(c, ["Palo Alto"])) == [["palo alto"]]


SPANS = "paper_id int, page_idx int, block_idx int, line_idx int, span_idx int, text string, size double, font string"


def header(spark, spans):
    df = spark.createDataFrame(spans, SPANS)
    paragraphs = layout.classify_blocks(layout.rollup_blocks(df), layout.median_font(df))
    return paragraphs, layout.paper_header(paragraphs)


def test_title_authors_and_headings(spark, rows):
    spans = [
        (1, 0, 0, 0, 0, "Journal", 12.0, "F"), (1, 0, 1, 0, 0, "A Great", 18.0, "F-Bold"), (1, 0, 1, 1, 0, "Title", 18.0, "F-Bold"),
        (1, 0, 2, 0, 0, "Ann Lee; Bo Chu", 12.0, "F"), (1, 0, 3, 0, 0, "Introduction", 14.0, "F-Bold"), (1, 0, 4, 0, 0, "  ", 10.0, "F"),
        (1, 0, 5, 0, 0, "Body te", 10.0, "F"), (1, 0, 5, 0, 1, "xt.", 10.0, "F"), (1, 1, 0, 0, 0, "Methods", 14.0, "F-Bold"), (1, 1, 1, 0, 0, "More.", 10.0, "F")]
    paragraphs, head = header(spark, spans)
    assert rows(head) == [(1, "A Great Title", ["Ann Lee", "Bo Chu"])]
    assert rows(paragraphs, "page", "index", "text", "heading_level") == [
        (1, 1, "Journal", 1), (1, 2, "A Great Title", 1), (1, 3, "Ann Lee; Bo Chu", 0), (1, 4, "Introduction", 2), (1, 5, "Body text.", 0),
        (2, 1, "Methods", 2), (2, 2, "More.", 0)]


def test_equal_sizes_keep_first_title_and_blank_authors_are_passed_over(spark, rows):
    spans = [(1, 0, 0, 0, 0, "First", 18.0, "F"), (1, 0, 1, 0, 0, " ; ;", 18.0, "F"), (1, 0, 2, 0, 0, "Zoe, Max", 10.0, "F"), (2, 1, 0, 0, 0, "Page two only", 18.0, "F")]
    _, head = header(spark, spans)
    assert rows(head) == [(1, "First", ["Zoe", "Max"]), (2, "", [])]


def test_all_bold_paper_uses_default_size(spark, rows):
    df = spark.createDataFrame([(1, 0, 0, 0, 0, "x", 30.0, "F-Bold")], SPANS)
    assert rows(layout.median_font(df)) == [(1, 10.0, 11.0)]


def test_words_join_lines_and_split_at_gaps(spark, rows):
    words = [(1, 0, 10.4, 5.0, 1, "World", 10.0, "F"), (1, 0, 9.6, 0.0, 0, "Hello", 10.0, "F"), (1, 0, 24.0, 0.0, 2, "again.", 10.0, "F"),
             (1, 0, 46.0, 0.0, 3, "Next", 10.0, "F")]
    df = spark.createDataFrame(words, "paper_id int, page_idx int, top double, x0 double, seq int, text string, size double, font string")
    blocks = layout.words_to_blocks(df, layout.median_font(df, skip_blank=False))
    assert rows(blocks, "block_idx", "text") == [(0, "Hello World again."), (1, "Next")]


PARAS = "paper_id int, page int, index int, text string, is_heading boolean, heading_level int"


def test_heading_chunks(spark, rows):
    def chunks(levels):
        df = spark.createDataFrame([(1, 1, i, "t", v > 0, v) for i, v in enumerate(levels)], PARAS)
        return [c for _, c in rows(chunking.chunk_by_heading(df), "index", "chunk")]

    assert chunks([0]) == [0] and chunks([1, 0]) == [0, 0]
    assert chunks([1, 0, 2, 0, 2, 2, 0]) == [0, 0, 0, 0, 1, 2, 2]


def test_similarity_chunks_split_below_threshold_only(spark, rows):
    vecs = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame([(1, 1, i, "t", False, 0, v) for i, v in enumerate(vecs)], PARAS + ", vec array<double>")
    assert [c for _, c in rows(chunking.chunk_by_similarity(df), "index", "chunk")] == [0, 0, 1, 2, 3]
    assert [c for _, c in rows(chunking.chunk_paper(df), "index", "chunk")] == [0, 0, 1, 2, 3]


def test_markdown(spark, rows):
    df = spark.createDataFrame([(1, 1, 1, "Title", True, 1), (1, 1, 2, "body", False, 0), (1, 2, 1, "Sec", True, 2)], PARAS)
    assert rows(chunking.to_markdown(df)) == [(1, "# [p.1,§1] Title\n\n[p.1,§2] body\n\n## [p.2,§1] Sec\n")]
    assert rows(chunking.to_markdown(df, annotated=False)) == [(1, "# Title\n\nbody\n\n## Sec\n")]


def test_extractor_choice(spark, rows):
    papers = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "paper_id int, page_count int")
    good = spark.createDataFrame([(1, "x" * 50), (2, "x" * 49), (4, "x" * 99)], "paper_id int, text string")
    other = spark.createDataFrame([(1, "x" * 80), (2, "x" * 50)], "paper_id int, text string")
    chosen, rejected = layout.select_extractor((good, papers), (other, papers))
    assert rows(chosen, "paper_id", "extractor") == [(1, "primary"), (2, "fallback")]
    assert rows(rejected) == [(3,), (4,)]


def test_large_papers_are_chunked_by_the_cheapest_tier(spark, rows):
    paras = [(1, 1, 1, "short", False, 0)] + [(2, 1, i, "x" * 40, i in (1, 3), 2 if i in (1, 3) else 0) for i in range(1, 5)] + [
        (3, 1, i, "y" * 40, False, 0) for i in range(1, 4)]
    df = spark.createDataFrame(paras, PARAS)

    def with_vec(rest):
        assert {r.paper_id for r in rest.select("paper_id").distinct().collect()} == {3}
        return rest.withColumn("vec", F.when(F.col("index") < 3, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))

    got = rows(chunking.chunk_large(df, 20, with_vec), "paper_id", "index", "chunk")
    assert got == [(1, 1, 0), (2, 1, 0), (2, 2, 0), (2, 3, 1), (2, 4, 1), (3, 1, 0), (3, 2, 0), (3, 3, 1)]
    assert rows(chunking.chunk_large(df, 20).filter("paper_id = 3"), "chunk") == [(0,)] * 3


def test_terms_come_from_a_table(spark):
    """Each text meets the few terms that its words may begin; the longest whole term wins, wherever it stands."""
    listed = [("LOCATION", "New York"), ("LOCATION", "New York City"), ("LOCATION", "York"), ("LOCATION", "a.b*c"), ("PERSON", "O'Neil"), ("PERSON", "New"), ("LOCATION", r"\\E(x"), ("OTHER", "in"),
              ("LOCATION", "--"), ("LOCATION", "New York")]
    terms = spark.createDataFrame(listed, "kind string, term string")
    texts = [(1, "From New York City to York, New Yorker."), (2, "a.b*c aXbYc O'Neil in"), (3, None), (4, ""), (5, "nothing"), (5, "York"), (None, "York and New.")]
    df = spark.createDataFrame(texts, "id int, text string")
    held = pii.with_terms(df, ["id"], F.col("text"), terms, places="LOCATION", people="PERSON")
    clean, found = pii.scrub(F.col("text"), pii.OUTPUT_SCOPE, locations=F.col("places"), persons=F.col("people"))
    got = {(r.id, r.text): (r.clean, r.found) for r in held.select("id", "text", clean.alias("clean"), found.alias("found")).collect()}
    assert got == {
        (1, texts[0][1]): ("From [LOCATION] to [LOCATION], [PERSON] Yorker.", ["LOCATION", "PERSON"]), (2, texts[1][1]): ("[LOCATION] aXbYc [PERSON] in", ["LOCATION", "PERSON"]),
        (3, None): (None, []), (4, ""): ("", []), (5, "nothing"): ("nothing", []), (5, "York"): ("[LOCATION]", ["LOCATION"]), (None, "York and New."): ("[LOCATION] and [PERSON].", ["LOCATION", "PERSON"])}


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).select(F.lit("LOCATION").alias("kind"), F.concat(F.lit("Place "), F.col("id").cast("string")).alias("term"))
    terms = terms.unionByName(spark.range(100_000).select(F.lit("LOCATION").alias("kind"), F.concat(F.lit("T"), F.col("id").cast("string"), F.lit("x town")).alias("term")))
    df = spark.range(200).select("id", F.concat(F.lit("From T"), (F.col("id") * 400).cast("string"), F.lit("x town to T0x village, not Place x.")).alias("text"))
    held = pii.with_terms(df, ["id"], F.col("text"), terms, places="LOCATION")
    clean, _ = pii.scrub(F.col("text"), pii.INPUT_SCOPE, locations=F.col("places"))
    assert {r[0] for r in held.select(clean).collect()} == {"From [LOCATION] to T0x village, not Place x."}
    assert held.agg(F.max(F.size("places"))).first()[0] <= 2


def test_words_of_a_paper_are_not_shuffled(spark):
    from citeloom.catalog.layout import from_words
    from citeloom.catalog.stand_ins import Tables

    from tests.conftest import SF

    plan = from_words(Tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert dealt and all("hashpartitioning(doc_id" in line for line in dealt), dealt
