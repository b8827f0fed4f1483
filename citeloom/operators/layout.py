"""Paragraphs, headings, title and authors from layout spans or words.

Windows run per page and aggregations per block, line, page or paper. All of these are parts of one
uploaded file, whose size is limited on admission, so no group grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import normalize_text, parse_authors, strip

# Minimum characters per page, body size when nothing is measured, leading, line gap.
MIN_CHARS_PER_PAGE = 50
DEFAULT_SIZE = 10.0
LEADING = 1.4
PARAGRAPH_GAP = 1.5

_BOLD = "Bold"


def median_font(spans: DataFrame, *, skip_blank: bool = True) -> DataFrame:
    """Exact median size of body (non-bold) text per paper and the heading threshold above it."""
    body = ~F.contains("font", F.lit(_BOLD))
    if skip_blank:
        body = body & (strip(F.col("text")) != "")
    return spans.groupBy("paper_id").agg(
        F.coalesce(F.median(F.when(body, F.col("size"))), F.lit(DEFAULT_SIZE)).alias("body_size")).withColumn(
        "heading_size", F.col("body_size") + 1.0)


def rollup_blocks(spans: DataFrame) -> DataFrame:
    """One row per text block: lines joined by newline, trimmed; largest size; any bold; blanks dropped."""
    piece = F.struct("line_idx", "span_idx", normalize_text(F.col("text")).alias("text"))
    blocks = spans.groupBy("paper_id", "page_idx", "block_idx").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("size").alias("size"),
        F.bool_or(F.contains("font", F.lit(_BOLD))).alias("bold"))

    def placed(piece: Column, i: Column) -> Column:
        starts_line = (i > 0) & (F.get("pieces", i - 1)["line_idx"] != piece["line_idx"])
        return F.concat(F.when(starts_line, F.lit("\n")).otherwise(F.lit("")), piece["text"])

    text = strip(F.array_join(F.transform("pieces", placed), ""))
    return blocks.select("paper_id", "page_idx", "block_idx", text.alias("text"), "size", "bold").filter("text <> ''")


def classify_blocks(blocks: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Paragraph rows with heading level, and the flags title and author detection need.

    ``medians`` may be left out for blocks that already carry their paper's ``heading_size``.

    On the first page every block that sets a new largest size is a title candidate (level 1); bold
    blocks above the heading size are section headings (level 2). Paragraphs are numbered per page.
    """
    page = Window.partitionBy("paper_id", "page_idx").orderBy("block_idx")
    before = F.coalesce(F.max("size").over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sized = blocks if medians is None else blocks.join(medians, "paper_id")
    marked = sized.select(
        "paper_id", "page_idx", "block_idx", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"),
        "size", (F.col("bold") & (F.col("size") > F.col("heading_size"))).alias("bold_heading"),
        before.alias("largest_before"), F.row_number().over(page).alias("index"))
    record = (F.col("page_idx") == 0) & (F.col("size") > F.col("largest_before"))
    level = F.when(record, 1).when(F.col("bold_heading"), 2).otherwise(0)
    byline = (F.col("page_idx") == 0) & ~record & (F.col("largest_before") > 0) & ~F.col("bold_heading")
    return marked.select(
        "paper_id", (F.col("page_idx") + 1).alias("page"), "index", "text", (level > 0).alias("is_heading"),
        level.alias("heading_level"), record.alias("sets_title"), byline.alias("may_be_authors"))


def paper_header(paragraphs: DataFrame) -> DataFrame:
    """Title (last block to set the largest size) and authors (first following line that names any)."""
    authors = parse_authors(F.col("text"))
    named = F.col("may_be_authors") & (F.size(authors) > 0)
    found = paragraphs.groupBy("paper_id").agg(
        F.max_by("text", F.when(F.col("sets_title"), F.col("index"))).alias("title"),
        F.min_by(authors, F.when(named, F.col("index"))).alias("authors"))
    return found.select("paper_id", F.coalesce("title", F.lit("")).alias("title"),
                        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"))


def words_to_blocks(words: DataFrame, medians: DataFrame) -> DataFrame:
    """Rebuild paragraph blocks from positioned words: words to lines by rounded top, lines to
    paragraphs where the vertical gap is above 1.5 line heights. ``seq`` is the extraction order; the
    blocks carry their paper's ``heading_size``."""
    line_words = F.array_sort(F.collect_list(F.struct("x0", "seq", "text")))
    lines = words.withColumn("line_top", F.bround("top", 0).cast("long")).groupBy("paper_id", "page_idx", "line_top").agg(
        F.array_join(F.transform(line_words, lambda s: s["text"]), " ").alias("text"), F.max("size").alias("size"),
        F.bool_or(F.contains("font", F.lit(_BOLD))).alias("bold"))
    page = Window.partitionBy("paper_id", "page_idx").orderBy("line_top")
    gap = F.col("line_top") - F.lag("line_top").over(page)
    limit = F.col("body_size") * LEADING * PARAGRAPH_GAP
    split = lines.join(medians, "paper_id").withColumn("starts", F.coalesce((gap > limit).cast("int"), F.lit(0)))
    numbered = split.withColumn("block_idx", F.sum("starts").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_top", "text"))), lambda s: s["text"]), " ")
    return numbered.groupBy("paper_id", "page_idx", "block_idx").agg(
        normalize_text(strip(joined)).alias("text"), F.max("size").alias("size"),
        F.bool_or("bold").alias("bold"), F.max("heading_size").alias("heading_size")).filter("text <> ''")


def chars_per_page(paragraphs: DataFrame, papers: DataFrame) -> DataFrame:
    totals = paragraphs.groupBy("paper_id").agg(F.sum(F.length("text")).alias("chars"))
    return papers.join(totals, "paper_id", "left").withColumn("chars", F.coalesce("chars", F.lit(0)))


def quality_gate(paragraphs: DataFrame, papers: DataFrame, minimum: float = MIN_CHARS_PER_PAGE) -> DataFrame:
    """Papers with at least ``minimum`` characters per page; a paper without pages fails."""
    dense = F.col("chars") / F.nullif(F.col("page_count"), F.lit(0)) >= minimum
    return chars_per_page(paragraphs, papers).filter((F.col("page_count") > 0) & dense)


def select_extractor(primary: tuple[DataFrame, DataFrame], fallback: tuple[DataFrame, DataFrame],
                     minimum: float = MIN_CHARS_PER_PAGE) -> tuple[DataFrame, DataFrame]:
    """Per paper the primary extraction if it passes the quality gate, else the fallback if that does.

    Each argument is ``(paragraphs, papers)``. Returns (chosen papers with ``extractor``, rejected).
    """
    first = quality_gate(*primary, minimum).withColumn("extractor", F.lit("primary"))
    second = quality_gate(*fallback, minimum).withColumn("extractor", F.lit("fallback"))
    chosen = first.unionByName(second.join(first.select("paper_id"), "paper_id", "left_anti"))
    seen = primary[1].select("paper_id").unionByName(fallback[1].select("paper_id")).distinct()
    return chosen, seen.join(chosen.select("paper_id"), "paper_id", "left_anti")
