"""The stages of a literature review as chains of operators.

Every stage takes and returns DataFrames. ``stage_table`` writes a stage's result to the shared folder
and hands back the table, which is the barrier between stages: a restarted job reads it instead of
computing it again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import pii
from citeloom.functions.ordered import with_position
from citeloom.operators import chunking, citations, corpus, evals, gates, grounding, layout, similarity, themes, views
from citeloom.operators.graph import connected_components
from citeloom.operators.similarity import COARSE_THRESHOLD, COARSE_THRESHOLD_SHARED_ENTITY, RECONCILE_THRESHOLD, similar_pairs
from citeloom.runtime import materialise, shuffled
from citeloom.sources import entities


def stage_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


@dataclass
class Ingested:
    papers: DataFrame
    rejected: DataFrame
    paragraphs: DataFrame
    contents: DataFrame


def ingest(spans: DataFrame, words: DataFrame, page_counts: DataFrame, *, terms: DataFrame | None = None,
           with_vec: Callable[[DataFrame], DataFrame] | None = None, minimum: float = layout.MIN_CHARS_PER_PAGE,
           threshold: int = chunking.TOKEN_THRESHOLD) -> Ingested:
    """Layout to admitted papers, redacted paragraphs and whole or chunked annotated texts.

    ``page_counts(paper_id, page_count, ..)``; ``with_vec`` attaches a ``vec`` to paragraphs and is
    only run on papers that are too large and have no section headings to split at.
    """
    # one shuffle by paper serves every aggregation, window and join of the stage; words are only used of papers whose
    # spans give too little text
    spans = spans.repartition("paper_id")
    primary = materialise(layout.classify_blocks(layout.rollup_blocks(spans), layout.median_font(spans)))
    good = layout.quality_gate(primary, page_counts, minimum).select("paper_id")
    left = page_counts.join(good, "paper_id", "left_anti")
    words = words.join(left.select("paper_id"), "paper_id", "left_semi").repartition("paper_id")
    fallback = materialise(layout.classify_blocks(layout.words_to_blocks(words, layout.median_font(words, skip_blank=False))))
    chosen, rejected = layout.select_extractor((primary, page_counts), (fallback, page_counts), minimum)
    chosen = materialise(chosen)

    def of(rows: DataFrame, extractor: str) -> DataFrame:
        return rows.join(chosen.filter(F.col("extractor") == extractor).select("paper_id"), "paper_id", "left_semi")

    kept = of(primary, "primary").unionByName(of(fallback, "fallback"))
    papers = chosen.join(layout.paper_header(kept), "paper_id", "left")
    kept = kept.drop("sets_title", "may_be_authors")
    if terms is not None:
        kept = pii.with_terms(kept, ["paper_id", "page", "idx"], F.col("text"), terms, __locations="LOCATION")
    clean, _types = pii.scrub(F.col("text"), pii.INPUT_SCOPE, locations=() if terms is None else F.col("__locations"))
    paragraphs = kept.withColumn("text", clean).drop("__locations")
    placed = chunking.chunk_large(paragraphs, threshold, with_vec)
    contents = chunking.to_markdown(placed, keys=("paper_id", "chunk"))
    return Ingested(papers, rejected, paragraphs, contents)


def analyse(papers: DataFrame, chunk_themes: DataFrame, positions: DataFrame, claims: DataFrame,
            threshold: float = grounding.PROVENANCE_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(gated papers, themes, positions, claims): topic gate, provenance filter, chunk merge.

    ``papers`` carry ``content``; ``claims`` carry the ``score`` against their excerpt.
    """
    gated = gates.topic_gate(papers)
    accepted = gated.filter("verdict = 'accept'").select("paper_id")
    own = [df.join(accepted, "paper_id", "left_semi") for df in (chunk_themes, positions, claims)]
    kept = own[2].filter(F.col("score") >= threshold)
    return (gated, *themes.merge_chunks(own[0], own[1], kept))


def bucket_themes(vectors: DataFrame, cap: int = themes.MAX_BUCKET, threshold: float = COARSE_THRESHOLD,
                  shared: float = COARSE_THRESHOLD_SHARED_ENTITY) -> DataFrame:
    """Buckets of similar themes, no larger than ``cap``: (job_id, pos, component, sub)."""
    pairs = similar_pairs(vectors, threshold, shared)
    components = materialise(connected_components(vectors, pairs))
    return themes.cap_buckets(components, vectors, cap)


def map_themes(groups: DataFrame, bucketed: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(canonical themes, out-of-range members, contradicting pairs) from the grouping model's output."""
    _members, offenders = themes.select_indices(groups, bucketed)
    return themes.build_theme_map(groups, bucketed), offenders, themes.group_contradictions(groups, bucketed, scores)


@dataclass
class Deduplicated:
    themes: DataFrame
    members: DataFrame
    out_of_range: DataFrame
    contradicting: DataFrame


def dedup_themes(found: DataFrame, vectors: DataFrame, group: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], scores: DataFrame, *,
                 cap: int = themes.MAX_BUCKET, threshold: float = COARSE_THRESHOLD, shared: float = COARSE_THRESHOLD_SHARED_ENTITY,
                 reconcile: float = RECONCILE_THRESHOLD) -> Deduplicated:
    """Themes of all papers to canonical themes: buckets of similar ones, grouped inside each bucket, then merged across buckets.

    ``found(job_id, pos, theme_id, name, description, paper_id)``, ``vectors(job_id, pos, vec[, entities])``. ``group`` is the grouping model: it gets
    the themes with ``bucket`` and ``idx`` and returns (bucket, group_no, canonical_name, description, member_indices). ``embed`` adds ``vec``
    to canonical themes, ``scores(a, b, contradiction)`` are of theme ids. Buckets and their groups are taken in the order of their first parts.
    """
    parts = bucket_themes(vectors, cap, threshold, shared)
    inside = Window.partitionBy("bucket").orderBy("pos")  # a bucket has at most ``cap`` themes
    placed = found.join(parts, ["job_id", "pos"]).withColumn("bucket", F.concat_ws("|", "job_id", "component", "sub"))
    placed = materialise(placed.withColumn("idx", (F.row_number().over(inside) - 1).cast("long")))
    groups = materialise(group(placed))
    canonical, offenders, contradicting = map_themes(groups, placed, scores)
    named = canonical.join(placed.select("bucket", "job_id", "component", "sub").distinct(), "bucket")
    numbered = materialise(with_position(named, ["job_id"], [F.col("component"), F.col("sub"), F.col("group_no")], "pos"))
    kinds = {"source": "source_theme_ids", "paper": "paper_ids", "alias": "aliases"}
    members = reduce(DataFrame.unionByName, [
        numbered.select("canonical_id", F.lit(kind).alias("kind"), F.posexplode(column).alias("at", "value")) for kind, column in kinds.items()])
    final, listed = themes.reconcile_themes(numbered.select("job_id", "pos", "canonical_id", "name", "description"),
                                            embed(numbered).select("job_id", "pos", "vec"), members, reconcile)
    return Deduplicated(final, listed, offenders, contradicting)


@dataclass
class Reviewed:
    reviews: DataFrame
    grounding: DataFrame
    key_claims: DataFrame
    invalid_claims: DataFrame
    audit: DataFrame


def review_themes(reviews: DataFrame, batch_themes: DataFrame, key_claims: DataFrame, batch_claims: DataFrame, claims: DataFrame,
                  labels: DataFrame, pair_scores: DataFrame, sentence_labels: DataFrame, *, terms: DataFrame | None = None) -> Reviewed:
    """Reviewer output to verified theme reviews: names, claim ids, redaction, verification, grounding."""
    named = themes.match_theme_name(reviews.select("batch", "review_no", "theme_name"), batch_themes)
    placed = reviews.join(shuffled(named.select("batch", "review_no", "theme_id", "label")), ["batch", "review_no"])
    clean, audit = gates.scrub_reviews(placed, terms=terms, keys=("batch", "review_no"))
    verified = grounding.verify_sections(clean, labels, claims)
    kept, invalid = grounding.valid_claims(key_claims, batch_claims)
    verdicts = grounding.grounding_verdict(pair_scores, ["theme_id", "sentence_pos", "sentence"])
    return Reviewed(verified, grounding.resolve_borderline(verdicts, sentence_labels), kept, invalid, audit)


@dataclass
class Aggregated:
    sections: DataFrame
    citations: DataFrame
    references: DataFrame
    orphans: DataFrame
    audit: DataFrame


def aggregate(sections: DataFrame, section_citations: DataFrame, claims: DataFrame, papers: DataFrame, *,
              terms: DataFrame | None = None) -> Aggregated:
    """Merged, integrity-checked, resolved and redacted review sections with their references."""
    # claims are looked up once, for the check, the links, the positions and the references
    merged = materialise(citations.placed(citations.merge_citations(section_citations), claims))
    valid = merged.filter("known")
    checked = citations.checked_sections(sections, merged)
    orphans = checked.filter("missing is not null").select(*citations.SECTION, "theme_id", "missing")
    clean, audit = gates.scrub_sections(checked.drop("missing"), terms=terms, keys=("job_id", "review_pos"))
    return Aggregated(clean, citations.position_lookup(valid, claims, papers),
                      citations.build_references(valid, claims, papers), orphans, audit)


def reader_view(review: DataFrame, aggregated: Aggregated, papers: DataFrame, claims: DataFrame, paper_themes: DataFrame) -> dict[str, DataFrame]:
    """The tables a reader's page is built from."""
    sections = materialise(aggregated.sections)  # two of the tables read them
    return {
        "entries": views.review_reader(aggregated.citations, papers, claims),
        "cited_in": views.cited_in(aggregated.citations, sections),
        "markdown": views.review_markdown(review, sections),
        "stats": corpus.review_stats(papers, paper_themes, claims),
        "colours": views.theme_colours(paper_themes),
    }


def evaluate(scores: DataFrame, baseline: DataFrame, old: DataFrame, new: DataFrame, traces: DataFrame) -> dict[str, DataFrame]:
    """Averages against the baseline, judge agreement, sampled traces and production misses."""
    averages = evals.score_average(scores)
    return {
        "averages": averages,
        "regressions": gates.regression_gate(averages, baseline),
        "concordance": evals.judge_concordance(old, new),
        "sampled": evals.sample_exact(evals.scoreable_traces(traces), "trace_id"),
        "misses": evals.production_misses(scores),
    }


def search_corpus(spark: SparkSession, root: str, collection: str, asked: DataFrame, embed: Callable[[DataFrame], DataFrame],
                  min_score: float = similarity.MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """(found, refused) for ``asked(query_id, query, limit)`` over a stored collection: best points of each query, and queries that are too long.

    Limits are clamped, texts are embedded by ``embed`` (which adds ``vec`` to rows with ``text``), and all queries search at once.
    """
    bounded = materialise(similarity.query_bounds(asked))
    taken = bounded.filter(F.coalesce("accepted", F.lit(False)))
    corpus_rows = entities.read_collection(spark, root, collection).withColumn("pos", F.col("id"))
    queries = embed(taken.select("query_id", F.col("query").alias("text"))).select("query_id", "vec")
    found = similarity.search_many(corpus_rows, queries, similarity.MAX_LIMIT, min_score)
    kept = found.join(taken.select("query_id", "limit"), "query_id").filter(F.col("rank") <= F.col("limit")).drop("limit", "pos")
    return kept, bounded.filter(~F.col("accepted")).select("query_id", "error")
