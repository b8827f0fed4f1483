"""Splitting papers into chunks, packing under a token budget, and annotated text.

Windows run per paper, and a paper is one file of limited size.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import estimate_tokens
from citeloom.functions.vectors import cosine

# Similarity below which a chunk starts, and the token size above which papers are chunked.
SIMILARITY_SPLIT = 0.55
TOKEN_THRESHOLD = 8000
CHARS_PER_TOKEN = 4


def _in_paper():
    return Window.partitionBy("paper_id").orderBy("page", "index")


def _so_far():
    return _in_paper().rowsBetween(Window.unboundedPreceding, 0)


def chunk_by_heading(paragraphs: DataFrame) -> DataFrame:
    """``chunk`` rises at every section heading but the first; front matter joins the first section."""
    headings = F.sum((F.col("heading_level") == 2).cast("int")).over(_so_far())
    return paragraphs.withColumn("chunk", F.greatest(headings - 1, F.lit(0)))


def chunk_by_similarity(paragraphs: DataFrame, threshold: float = SIMILARITY_SPLIT, vec: str = "vec") -> DataFrame:
    """``chunk`` rises where a paragraph is less similar than ``threshold`` to the one before."""
    previous = F.lag(vec).over(_in_paper())
    starts = F.coalesce((cosine(previous, F.col(vec)) < threshold).cast("int"), F.lit(0))
    return paragraphs.withColumn("__starts", starts).withColumn("chunk", F.sum("__starts").over(_so_far())).drop("__starts")


def chunk_paper(paragraphs: DataFrame, threshold: float = SIMILARITY_SPLIT, vec: str = "vec") -> DataFrame:
    """Heading chunks where they split the paper, else similarity chunks."""
    both = chunk_by_heading(paragraphs).withColumnRenamed("chunk", "__by_heading")
    both = chunk_by_similarity(both, threshold, vec).withColumnRenamed("chunk", "__by_similarity")
    splits = F.max("__by_heading").over(Window.partitionBy("paper_id")) > 0
    return both.withColumn("chunk", F.when(splits, F.col("__by_heading")).otherwise(F.col("__by_similarity"))).drop(
        "__by_heading", "__by_similarity")


def chunk_large(paragraphs: DataFrame, threshold: int = TOKEN_THRESHOLD,
                with_vec: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``chunk`` per paragraph for non-blank paragraphs: papers within ``threshold`` tokens stay whole.

    Larger ones are split at section headings; those without enough headings by similarity, and only
    for them ``with_vec`` is run to attach ``vec`` (without it they stay whole).
    """
    paper = Window.partitionBy("paper_id")
    # lines are joined by two newlines and end in one
    length = F.sum(F.length(_marked(True)) + 2).over(paper) - 1
    sized = chunk_by_heading(paragraphs).withColumn("__whole", F.floor(length / 4) <= threshold).withColumn(
        "__splits", F.max("chunk").over(paper) > 0)
    settled = F.col("__whole") | F.col("__splits")
    placed = sized.withColumn("chunk", F.when(F.col("__whole"), F.lit(0)).otherwise(F.col("chunk")).cast("long"))
    if with_vec is None:
        return placed.drop("__whole", "__splits")
    similar = chunk_by_similarity(with_vec(sized.filter(~settled).drop("chunk"))).drop("vec")
    return placed.filter(settled).unionByName(similar).drop("__whole", "__splits")


def _marked(annotated: bool) -> Column:
    tag = F.concat(F.lit("[p."), F.col("page").cast("string"), F.lit(",§"), F.col("index").cast("string"), F.lit("]"))
    body = F.concat_ws(" ", tag, F.col("text")) if annotated else F.col("text")
    hashes = F.repeat(F.lit("#"), F.greatest(F.col("heading_level"), F.lit(1)))
    return F.when(F.col("is_heading"), F.concat_ws(" ", hashes, body)).otherwise(body)


def to_markdown(paragraphs: DataFrame, *, annotated: bool = True, keys: tuple[str, ...] = ("paper_id",)) -> DataFrame:
    """One text per paper (or chunk): headings marked, positions tagged, blank lines between."""
    line = F.struct("page", "index", _marked(annotated).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"])
    text = F.concat(F.regexp_replace(F.array_join(ordered, "\n\n"), r"\n+\z", ""), F.lit("\n"))
    return paragraphs.groupBy(*keys).agg(text.alias("content"))


def _packed(text: str | None, budget: int | None) -> list[str]:
    """One pass over the blocks of a text; a block that no longer fits opens the next part."""
    parts: list[list[str]] = []
    used = 0
    for block in (text or "").split("\n\n"):
        if block.strip():
            tokens = len(block) // CHARS_PER_TOKEN
            if not parts or used + tokens > (budget or 0):
                parts.append([])
                used = 0
            parts[-1].append(block)
            used += tokens
    return ["\n\n".join(p) for p in parts] or [text or ""]


def _pack(texts: pa.Array, budgets: pa.Array) -> pa.Array:
    return pa.array((_packed(t.as_py(), b.as_py()) for t, b in zip(texts, budgets, strict=True)), type=pa.list_(pa.string()))


def pack_under_budget(contents: DataFrame, budget: Column, content: str = "content") -> DataFrame:
    """Greedy, order-keeping packing of blank-line-separated blocks into parts of at most ``budget`` tokens.

    A block over the budget stands alone and is never cut. Linear in the text: adds ``part`` and the part's text in
    place of the content.
    """
    texts = F.arrow_udf(_pack, "array<string>")(F.col(content), budget.cast("int"))
    staged = contents.withColumn("__texts", texts)
    others = [c for c in contents.columns if c != content]
    return staged.select(*others, F.posexplode("__texts").alias("part", content))


def size_trigger(contents: DataFrame, threshold: int = TOKEN_THRESHOLD, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(whole papers, papers to chunk) by estimated tokens."""
    sized = contents.withColumn("tokens", estimate_tokens(F.col(content)))
    return sized.filter(F.col("tokens") <= threshold), sized.filter(F.col("tokens") > threshold)
