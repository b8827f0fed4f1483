"""Texts assembled for the models, as ordered lines.

A theme may have any number of claims, so a message is a table of lines with sort columns: written
in that order it is the message, and no message has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import CONTEXT
from citeloom.operators.citations import latest_claims

LINE_KEY = ["job_id", "batch", "part", "a", "b", "c"]

# What a message shows for a value that is missing.
NO_NAME, NO_PAPER, NO_VALUE = "Unknown", "unknown", "?"


def _or(default: str, *names: str) -> Column:
    """First of the columns that has a value, as text."""
    return F.coalesce(*[F.col(n).cast("string") for n in names], F.lit(default))


def _with(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with those text columns it lacks, empty of values."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def _lines(df: DataFrame, part: int, a: Column, b: Column, c: Column, line: Column) -> DataFrame:
    def number(column: Column, name: str) -> Column:
        return column.cast("long").alias(name)

    return df.select("job_id", number(F.col("batch"), "batch"), number(F.lit(part), "part"), number(a, "a"),
                     number(b, "b"), number(c, "c"), line.alias("line"))


def section_message(reviews: DataFrame, key_claims: DataFrame, claims: DataFrame) -> DataFrame:
    """Lines of the section writer's input per batch: theme reviews, then the claim registry.

    ``reviews(job_id, batch, at, label, review, consensus, disagreements, gaps)``,
    ``key_claims(job_id, batch, at, kc_pos, ref_number, claim_id, paper_id, summary)``. A missing value leaves its place
    empty (``?`` for page and paragraph, the theme's id or number for its label); it never takes a line away.
    """
    reviews = _with(reviews, "theme_id")
    batches = reviews.select("job_id", "batch").distinct()
    head = _lines(batches.select("*", F.posexplode(F.array(F.lit("=== THEME REVIEWS ==="), F.lit(""))).alias("k", "line")),
                  0, F.lit(0), F.lit(0), F.col("k"), F.col("line"))

    def listed(title: str, column: str) -> Column:
        points = F.transform(column, lambda p: F.concat(F.lit("  - "), F.coalesce(p, F.lit(""))))
        filled = F.concat(F.array(F.lit(title)), points, F.array(F.lit("")))
        return F.when(F.size(column) > 0, filled).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    synthesis = F.when(F.coalesce("review", F.lit("")) != "",
                       F.array(F.concat(F.lit("SYNTHESIS: "), F.col("review")), F.lit(""))).otherwise(none)
    number = (F.col("at") + 1).cast("string")
    opening = F.array(F.concat(F.lit("--- THEME "), number, F.lit(": "),
                               F.coalesce("label", "theme_id", F.concat(F.lit("Theme "), number)), F.lit(" ---")), F.lit(""))
    body = F.concat(opening, synthesis, listed("CONSENSUS:", "consensus"), listed("DISAGREEMENTS:", "disagreements"), listed("GAPS:", "gaps"))
    themes = _lines(reviews.select("job_id", "batch", "at", F.posexplode(body).alias("k", "line")), 1, F.col("at"), F.lit(0), F.col("k"), F.col("line"))
    numbered = key_claims.filter("ref_number is not null")
    cited = key_claims.select("job_id", "batch", "at").distinct()
    kc_open = _lines(cited, 1, F.col("at"), F.lit(1), F.lit(0), F.lit("KEY CLAIMS:"))
    known = latest_claims(claims, "page", "paragraph", cited=numbered)
    placed = numbered.join(known, ["job_id", "claim_id"], "left")

    claim_line = F.concat(F.lit("  ["), F.col("ref_number").cast("string"), F.lit("] "), _or("", "summary"), F.lit(" (paper: "),
                          _or("", "paper_id"), F.lit(", p."), _or(NO_VALUE, "page"), F.lit(",§"), _or(NO_VALUE, "paragraph"), F.lit(")"))
    kc_lines = _lines(placed, 1, F.col("at"), F.lit(2), F.col("kc_pos"), claim_line)
    kc_close = _lines(cited, 1, F.col("at"), F.lit(3), F.lit(0), F.lit(""))
    close = _lines(reviews, 1, F.col("at"), F.lit(4), F.lit(0), F.lit(""))
    intro = F.array(F.lit("=== CLAIM REGISTRY ==="), F.lit("Use these [N] numbers for inline citations in your response."), F.lit(""))
    registry_head = _lines(batches.select("*", F.posexplode(intro).alias("k", "line")), 2, F.lit(0), F.lit(0), F.col("k"), F.col("line"))
    last = numbered.groupBy("job_id", "batch", "ref_number").agg(
        F.max_by(F.struct("claim_id", "paper_id"), F.struct("at", "kc_pos")).alias("x"))
    entry = F.concat(F.lit("  ["), F.col("ref_number").cast("string"), F.lit("] claim_id="), _or("", "x.claim_id"),
                     F.lit(" paper_id="), _or("", "x.paper_id"))
    registry = _lines(last, 3, F.col("ref_number"), F.lit(0), F.lit(0), entry)
    whole = head
    for piece in (themes, kc_open, kc_lines, kc_close, close, registry_head, registry):
        whole = whole.unionByName(piece)
    return whole


def theme_message(themes: DataFrame, claims: DataFrame) -> DataFrame:
    """Lines of the theme reviewer's input per batch: each theme with its claims grouped by paper.

    ``themes(job_id, batch, at, canonical_id, name, description, aliases)``, ``claims(canonical_id,
    paper_id, pos, claim_id, text, page, paragraph, deep[, summary])``. Papers come in order of their first claim. A
    claim shows its summary or else its text; missing values have stand-ins, so every claim has its line.
    """
    claims = _with(claims, "summary").select(
        "canonical_id", _or(NO_PAPER, "paper_id").alias("paper_id"), "pos", _or(NO_VALUE, "claim_id").alias("claim_id"),
        _or("", "summary", "text").alias("text"), _or(NO_VALUE, "page").alias("page"), _or(NO_VALUE, "paragraph").alias("paragraph"), "deep")
    themes = _with(themes, "label")
    per_batch = themes.groupBy("job_id", "batch").agg(F.count(F.lit(1)).alias("n"))
    head = _lines(per_batch.select("job_id", "batch", F.posexplode(F.array(
        F.concat(F.lit("Analyze the following "), F.col("n").cast("string"), F.lit(" themes:")), F.lit(""))).alias("k", "line")),
        0, F.lit(0), F.lit(0), F.col("k"), F.col("line"))
    papers = claims.groupBy("canonical_id", "paper_id").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("m"))
    totals = papers.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("papers"), F.sum("m").alias("claims"))
    counted = themes.join(totals, "canonical_id", "left")

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("string")

    aliases = F.array_join("aliases", ", ")
    opening = F.array_compact(F.array(
        F.concat(F.lit('<theme id="'), F.col("canonical_id"), F.lit('" name="'), _or(NO_NAME, "name", "label"), F.lit('">')),
        F.concat(F.lit("DESCRIPTION: "), F.coalesce("description", F.lit(""))),
        F.when(aliases != "", F.concat(F.lit("ALIASES: "), aliases)),
        F.concat(F.lit("PAPERS: "), n("papers"), F.lit(" paper(s), "), n("claims"), F.lit(" claims")), F.lit("")))
    starts = _lines(counted.select("job_id", "batch", "at", F.posexplode(opening).alias("k", "line")), 1,
                    F.col("at") * 3, F.lit(0), F.col("k"), F.col("line"))
    where = themes.select("job_id", "batch", "at", "canonical_id")
    placed_papers = papers.join(where, "canonical_id")
    paper_open = _lines(placed_papers, 1, F.col("at") * 3 + 1, F.col("first"), F.lit(-1), F.concat(F.lit("  Paper: "), F.col("paper_id")))
    paper_close = _lines(placed_papers, 1, F.col("at") * 3 + 1, F.col("first"), F.lit(1 << 62), F.lit(""))
    claim = F.concat(F.lit('  <claim id="'), F.col("claim_id"), F.lit('" paper="'), F.col("paper_id"), F.lit('" page="'),
                     F.col("page"), F.lit('" paragraph="'), F.col("paragraph"), F.lit('">'),
                     F.col("text"), F.lit("</claim>"))
    context = F.when(F.coalesce("deep", F.lit("")) != "", F.concat(F.lit("      Context: "), F.substring("deep", 1, CONTEXT)))
    placed = claims.join(papers.select("canonical_id", "paper_id", "first"), ["canonical_id", "paper_id"]).join(where, "canonical_id")
    both = placed.select("job_id", "batch", "at", "first", "pos", F.posexplode(F.array_compact(F.array(claim, context))).alias("k", "line"))
    claim_lines = _lines(both, 1, F.col("at") * 3 + 1, F.col("first"), F.col("pos") * 2 + F.col("k"), F.col("line"))
    ends = _lines(themes.select("job_id", "batch", "at", F.posexplode(F.array(F.lit("</theme>"), F.lit(""))).alias("k", "line")), 1,
                  F.col("at") * 3 + 2, F.lit(0), F.col("k"), F.col("line"))
    whole = head
    for piece in (starts, paper_open, claim_lines, paper_close, ends):
        whole = whole.unionByName(piece)
    return whole


def title_abstract_message(sections: DataFrame) -> DataFrame:
    """Lines of the input for title and abstract: every section of a job under its label.

    ``sections(job_id, section_pos, label, content)``.
    """
    jobs = sections.select("job_id", F.lit(0).alias("batch")).distinct()
    head = _lines(jobs.select("*", F.posexplode(F.array(F.lit("=== SECTIONS ==="), F.lit(""))).alias("k", "line")), 0, F.lit(0), F.lit(0),
                  F.col("k"), F.col("line"))
    body = F.array(F.concat(F.lit("--- "), _or("", "label"), F.lit(" ---")), _or("", "content"), F.lit(""))
    told = sections.select("job_id", F.lit(0).alias("batch"), "section_pos", F.posexplode(body).alias("k", "line"))
    return head.unionByName(_lines(told, 1, F.col("section_pos"), F.lit(0), F.col("k"), F.col("line")))


def to_text_lines(lines: DataFrame) -> DataFrame:
    """Lines in message order, range-partitioned so that each output file is a consecutive stretch."""
    return lines.repartitionByRange(*LINE_KEY).sortWithinPartitions(*LINE_KEY)
