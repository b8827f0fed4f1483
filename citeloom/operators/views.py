"""Reader views of a finished review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ordered import prefix_sum, with_position
from citeloom.operators.citations import CLAIM, REF, latest_claims


def cited_in(citations: DataFrame, sections: DataFrame) -> DataFrame:
    """Labels of the sections that cite each number, one row each in section order (null: none)."""
    refs = sections.select("job_id", "section_pos", "label", F.explode(F.array_distinct("citation_refs")).alias("ref_number"))
    return citations.select("job_id", "ref_number", "claim_id").join(refs, REF, "left")


def review_reader(citations: DataFrame, papers: DataFrame, claims: DataFrame) -> DataFrame:
    """Citation entries as readers see them: title and text with their fallbacks, position as shown.

    ``citations(.., paper_title, page, paragraph)``, ``papers([job_id, ]paper_id, title, filename, authors)``,
    ``claims(job_id, claim_id, pos, summary, text, page, paragraph)``.
    """
    keys = [k for k in ("paper_id", "job_id") if k in papers.columns]
    known = papers.select(*keys, F.col("title").alias("p_title"), F.col("filename").alias("p_file"), F.col("authors").alias("p_authors"))
    looked_up = latest_claims(claims, "summary", "text", "page", "paragraph").select(
        "job_id", "claim_id", F.coalesce("summary", "text", F.lit("")).alias("claim_text"),
        F.col("page").alias("c_page"), F.col("paragraph").alias("c_paragraph"))
    page, paragraph = F.coalesce("page", "c_page", F.lit(0)), F.coalesce("paragraph", "c_paragraph", F.lit(0))
    shown = F.when(page > 0, F.concat(F.lit("p."), page.cast("string"), F.lit(", §"), paragraph.cast("string"))).otherwise("")
    return citations.join(known, keys, "left").join(looked_up, CLAIM, "left").select(
        "job_id", F.col("ref_number").alias("index"), "claim_id",
        F.coalesce("p_title", "paper_title", "p_file", F.lit("Unknown paper")).alias("title"),
        F.coalesce(F.array_join("p_authors", ", "), F.lit("")).alias("authors"), shown.alias("position"),
        F.coalesce("claim_text", F.lit("")).alias("text"), page.alias("page"), paragraph.alias("paragraph"))


def reference_fallback(references: DataFrame, citations: DataFrame, sections: DataFrame) -> DataFrame:
    """Paper-level references for jobs without any citation, with distinct section labels.

    ``references(job_id, paper_id, paper_title, first_ref, ref_number)`` in long form. ``index``
    counts papers from 1 in reference order; one row per distinct label (null: none).
    """
    needed = references.join(citations.select("job_id").distinct(), "job_id", "left_anti")
    papers = needed.groupBy("job_id", "paper_id", "paper_title").agg(F.min("first_ref").alias("first_ref"))
    indexed = with_position(papers, ["job_id"], [F.col("first_ref"), F.col("paper_id")], "position")
    refs = sections.select("job_id", "label", "section_pos", F.explode("citation_refs").alias("ref_number"))
    labels = needed.select("job_id", "paper_id", "ref_number").join(refs, ["job_id", "ref_number"]).groupBy(
        "job_id", "paper_id", "label").agg(F.min(F.struct("ref_number", "section_pos")).alias("first_at"))
    return indexed.join(labels, ["job_id", "paper_id"], "left").select(
        "job_id", (F.col("position") + 1).alias("index"), "paper_id",
        F.coalesce("paper_title", F.lit("Unknown")).alias("title"), "label")


TEXT_BLOCK = 1000


def _in_blocks(head: DataFrame, sections: DataFrame, piece: Column, first: Column, block: int) -> DataFrame:
    """Texts of a job in parts of at most ``block`` sections; joined by a blank line they are the whole."""
    cells = sections.select("job_id", F.floor(F.col("section_pos") / block).alias("part"),
                            F.struct("section_pos", piece.alias("text")).alias("row"))
    parts = cells.groupBy("job_id", "part").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("row")), lambda s: s["text"]), "\n\n").alias("text"))
    start = head.select("job_id", F.lit(-1).cast("long").alias("part"), first.alias("text")).filter(F.col("text").isNotNull())
    return start.unionByName(parts)


def review_text(reviews: DataFrame, sections: DataFrame, block: int = TEXT_BLOCK) -> DataFrame:
    """The text gates score: '# title', abstract, '## label' and content per section, in parts."""
    piece = F.concat(F.lit("## "), F.coalesce("label", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    first = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("abstract", F.lit("")))
    return _in_blocks(reviews, sections, piece, first, block)


def review_markdown(reviews: DataFrame, sections: DataFrame, block: int = TEXT_BLOCK) -> DataFrame:
    """The text readers see: '*abstract*' when there is one, then '## label' sections, in parts."""
    piece = F.concat(F.lit("## "), F.coalesce("label", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    first = F.when(F.coalesce("abstract", F.lit("")) != "", F.concat(F.lit("*"), F.col("abstract"), F.lit("*")))
    return _in_blocks(reviews, sections, piece, first, block)


def theme_colours(paper_themes: DataFrame) -> DataFrame:
    """Dense colour index per theme id by first appearance. ``paper_themes(job_id, pos, theme_id)``."""
    first = paper_themes.groupBy("job_id", F.coalesce("theme_id", F.lit("")).alias("theme_id")).agg(F.min("pos").alias("pos"))
    return prefix_sum(first, ["job_id"], "pos", F.lit(1), "colour_index")

