"""Reads over the indexed collections, corpus totals and per-paper roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions.ordered import with_position

# Rows one scroll returns at most, and the five collections.
SCROLL_LIMIT = 200
COLLECTIONS = ["paper_themes", "paper_claims", "theme_map", "theme_reviews", "literature_review"]


def scroll(collection: DataFrame, key: str, condition: Column | None = None, limit: int = SCROLL_LIMIT) -> DataFrame:
    """First ``limit`` rows by key that meet the condition; ``truncated`` says whether more exist.

    The limit is the feature (a page of a collection). One row more is read to see whether it cut.
    """
    rows = collection if condition is None else collection.filter(condition)
    page = rows.orderBy(key).limit(limit + 1)
    counted = page.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))  # at most limit + 1 rows
    ranked = counted.withColumn("__rn", F.row_number().over(Window.orderBy(key)))
    return ranked.filter(F.col("__rn") <= limit).withColumn("truncated", F.col("__n") > limit).drop("__n", "__rn")


def get_paper_themes(themes: DataFrame, paper_id: str) -> DataFrame:
    return payload(scroll(themes, "theme_id", F.col("paper_id") == paper_id), "paper_themes")


def get_claims_by_theme(claims: DataFrame, theme_name: str) -> DataFrame:
    return payload(scroll(claims, "claim_id", F.col("theme_name") == theme_name), "paper_claims")


def get_theme_map(theme_map: DataFrame) -> DataFrame:
    return payload(scroll(theme_map, "canonical_id"), "theme_map")


def get_theme_review(reviews: DataFrame, label: str) -> DataFrame:
    """The review of one theme label; no row when there is none."""
    return payload(reviews.filter(F.col("label") == label).orderBy("theme_id").limit(1), "theme_reviews")


def get_literature_review(sections: DataFrame) -> DataFrame:
    return payload(scroll(sections, "theme_id"), "literature_review")


# Columns of the result shapes and their defaults (None: must be given).
PAYLOADS: dict[str, dict[str, tuple[str, object]]] = {
    "paper_themes": {"paper_id": ("string", None), "name": ("string", None), "description": ("string", "")},
    "paper_claims": {"paper_id": ("string", None), "theme_id": ("string", ""), "theme_name": ("string", ""),
                     "text": ("string", None), "page": ("int", 0), "paragraph": ("int", 0), "deep": ("string", ""),
                     "summary": ("string", "")},
    "theme_map": {"name": ("string", None), "description": ("string", ""), "paper_ids": ("array<string>", []),
                  "aliases": ("array<string>", [])},
    "theme_reviews": {"theme_id": ("string", None), "label": ("string", ""), "review": ("string", ""),
                      "consensus": ("array<string>", []), "disagreements": ("array<string>", []),
                      "gaps": ("array<string>", [])},
    "literature_review": {"title": ("string", ""), "abstract": ("string", ""), "theme_id": ("string", None),
                          "label": ("string", ""), "content": ("string", ""), "claim_ids": ("array<string>", []),
                          "citation_refs": ("array<bigint>", [])},
}


def payload(rows: DataFrame, kind: str) -> DataFrame:
    """The declared result columns of a collection with defaults filled in; other columns are pruned."""
    shaped = []
    for name, (dtype, default) in PAYLOADS[kind].items():
        column = F.col(name) if name in rows.columns else F.lit(None)
        column = column.cast(dtype)
        if default is not None:
            blank = F.array().cast(dtype) if isinstance(default, list) else F.lit(default).cast(dtype)
            column = F.coalesce(column, blank)
        shaped.append(column.alias(name))
    extra = [F.col("truncated")] if "truncated" in rows.columns else []
    return rows.select(*shaped, *extra)


def collection_health(spark, tables: dict[str, DataFrame | None]) -> DataFrame:
    """Row count and status of every collection; absent ones are 0 / not_found."""
    names = spark.createDataFrame([(n,) for n in COLLECTIONS], "name string")
    present = [df.agg(F.count(F.lit(1)).alias("points")).select(F.lit(name).alias("name"), "points")
               for name, df in tables.items() if df is not None]
    counts = present[0]
    for other in present[1:]:
        counts = counts.unionByName(other)
    return names.join(counts, "name", "left").select(
        "name", F.coalesce("points", F.lit(0)).alias("points"),
        F.when(F.col("points").isNull(), "not_found").otherwise("green").alias("status"))


def enriched_papers(papers: DataFrame, themes: DataFrame, claims: DataFrame) -> DataFrame:
    """Papers with their themes and claims in long form: one row per item, or one without an item.

    ``kind`` is theme / claim / null. Long form because a paper's items may be very many.
    """
    items = themes.select("paper_id", F.lit("theme").alias("kind"), F.col("theme_id").alias("item_id"), F.col("name").alias("text")).unionByName(
        claims.select("paper_id", F.lit("claim").alias("kind"), F.col("claim_id").alias("item_id"), "text"))
    return papers.join(items, "paper_id", "left")


def review_stats(papers: DataFrame, themes: DataFrame, claims: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Per job: papers, distinct themes, claims. ``approximate`` sketches the distinct count."""
    distinct = F.approx_count_distinct("theme_id") if approximate else F.count_distinct("theme_id")
    n_papers = papers.groupBy("job_id").agg(F.count(F.lit(1)).alias("papers"))
    n_themes = themes.groupBy("job_id").agg(distinct.alias("themes"))
    n_claims = claims.groupBy("job_id").agg(F.count(F.lit(1)).alias("claims"))
    joined = n_papers.join(n_themes, "job_id", "left").join(n_claims, "job_id", "left")
    return joined.select("job_id", "papers", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("themes", "claims")])


def corpus_counts(papers: DataFrame, themes: DataFrame, claims: DataFrame, sections: DataFrame) -> DataFrame:
    """Per job the totals acceptance checks use."""
    def per_job(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("job_id").agg(F.count(F.lit(1)).alias(name))

    counts = per_job(papers, "paper_count")
    for df, name in ((themes, "theme_count"), (claims, "claim_count"), (sections, "section_count")):
        counts = counts.join(per_job(df, name), "job_id", "left")
    names = ("theme_count", "claim_count", "section_count")
    return counts.select("job_id", "paper_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def claims_per_paper(theme_claims: DataFrame) -> DataFrame:
    """Per theme and paper the claims, with the theme's totals; papers ordered by their first claim.

    ``theme_claims(theme_id, paper_id, pos)``.
    """
    per_paper = theme_claims.groupBy("theme_id", "paper_id").agg(
        F.count(F.lit(1)).alias("paper_claims"), F.min("pos").alias("first_pos"))
    totals = per_paper.groupBy("theme_id").agg(
        F.count(F.lit(1)).alias("papers"), F.sum("paper_claims").alias("claims"))
    return per_paper.join(totals, "theme_id")


def failure_policy(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per paper, per job) outcome: a paper fails only if all its chunks fail, a stage only if all papers do."""
    papers = chunks.groupBy("job_id", "paper_id").agg(
        F.bool_and("failed").alias("paper_failed"), F.count_if("failed").alias("failed_chunks"), F.count(F.lit(1)).alias("chunks"))
    jobs = papers.groupBy("job_id").agg(
        F.count_if(~F.col("paper_failed")).alias("successful"), F.count_if("paper_failed").alias("failed"),
        F.bool_and("paper_failed").alias("stage_failed"))
    return papers, jobs


def load_chunks(papers: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Contents of every paper in order: its chunks, else its single document, else one empty text."""
    whole = documents.join(chunks.select("paper_id"), "paper_id", "left_anti").select(
        "paper_id", F.lit(0).alias("chunk"), "content")
    contents = chunks.select("paper_id", F.col("chunk").cast("int").alias("chunk"), "content").unionByName(whole)
    return papers.select("paper_id").join(contents, "paper_id", "left").select(
        "paper_id", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("content", F.lit("")).alias("content"))


def merge_chunks_with(chunks: DataFrame, merge, schema: str, keys: tuple[str, ...] = ("paper_id",)) -> DataFrame:
    """Merge a paper's chunk results with the caller's function over one pandas frame per paper.

    A paper is one uploaded file of limited size. The built-in merge is ``themes.merge_chunks``.
    """
    return chunks.groupBy(*keys).applyInPandas(merge, schema)


def ordered_union(frames: Sequence[DataFrame], order: str, out: str = "at") -> DataFrame:
    """Rows of all frames with ``out``, their position: those of the first frame by its ``order``, then those of the second, and so on."""
    tagged = [df.withColumn("__frame", F.lit(i)) for i, df in enumerate(frames)]
    return with_position(reduce(DataFrame.unionByName, tagged), [], [F.col("__frame"), F.col(order)], out).drop("__frame")
