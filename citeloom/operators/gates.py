"""Quality, toxicity, judge and regression gates over supplied scores, and output redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import pii
from citeloom.operators.layout import MIN_CHARS_PER_PAGE

# Judge thresholds, allowed drop against the baseline, reason texts.
JUDGE_THRESHOLD = 0.70
BASELINE_FACTOR = 0.95
JUDGE_METRICS = ["faithfulness", "citation_accuracy"]
TOXIC_UNREACHABLE = "toxic-gate service unreachable"
JUDGE_UNREACHABLE = "judge service unreachable"


def topic_gate(papers: DataFrame) -> DataFrame:
    """Accept a paper with dense enough annotated text, a title and authors; else a reason."""
    dense = (F.col("page_count") > 0) & (
        F.length("content") / F.nullif(F.col("page_count"), F.lit(0)) >= MIN_CHARS_PER_PAGE)
    described = (F.coalesce("title", F.lit("")) != "") & (F.coalesce(F.size("authors"), F.lit(0)) > 0)
    accepted = F.coalesce(dense, F.lit(False)) & described
    return papers.withColumn("verdict", F.when(accepted, "accept").otherwise("reject")).withColumn(
        "reason", F.when(~accepted, F.lit("quality_or_metadata")))


SECTION_BLOCK = 1000


def toxic_fields(reviews: DataFrame, sections: DataFrame, scores: DataFrame) -> DataFrame:
    """(job_id, at, field): the failing fields of reviews whose combined text failed, in order of ``at``; empty fields are skipped.

    ``reviews(job_id, title, abstract)``, ``sections(job_id, section_pos, theme_id, label, content)``, ``scores(job_id, field, section_pos,
    score, passed)`` with field combined / title / abstract / section.
    """
    failed_jobs = scores.filter((F.col("field") == "combined") & ~F.col("passed")).select("job_id")
    headline = F.explode(F.array(
        F.struct(F.lit("title").alias("field"), F.col("title").alias("text"), F.lit(-2).cast("long").alias("at")),
        F.struct(F.lit("abstract").alias("field"), F.col("abstract").alias("text"), F.lit(-1).cast("long").alias("at"))))
    heads = reviews.select("job_id", headline.alias("f")).select(
        "job_id", "f.field", "f.text", "f.at", F.lit(None).cast("long").alias("section_pos"), F.col("f.field").alias("name"))
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("theme_id"), F.lit("section"))
    bodies = sections.select(
        "job_id", F.lit("section").alias("field"), F.col("content").alias("text"), F.col("section_pos").cast("long").alias("at"),
        F.col("section_pos").cast("long").alias("section_pos"), F.concat(F.lit("section '"), label, F.lit("'")).alias("name"))
    bad = scores.filter((F.col("field") != "combined") & ~F.col("passed")).select(
        "job_id", F.col("field").alias("bad_field"), F.coalesce(F.col("section_pos").cast("long"), F.lit(-1)).alias("bad_at"))
    fields = heads.unionByName(bodies).filter(F.coalesce("text", F.lit("")) != "").join(failed_jobs, "job_id", "left_semi")
    same = (fields["job_id"] == bad["job_id"]) & (F.col("field") == F.col("bad_field")) & (
        F.coalesce(F.col("section_pos"), F.lit(-1)) == F.col("bad_at"))
    return fields.join(bad, same, "left_semi").select("job_id", "at", F.col("name").alias("field"))


def toxic_gate(reviews: DataFrame, sections: DataFrame, scores: DataFrame, *, enabled: bool = True) -> DataFrame:
    """(job_id, verdict, reason, score) from the combined score, naming the failing fields (:func:`toxic_fields` has them as rows).

    Fields are only looked at when the combined text failed; a review without a combined score is quarantined.
    """
    if not enabled:
        return reviews.select("job_id", F.lit("pass").alias("verdict"), F.lit(None).cast("string").alias("reason"),
                              F.lit(None).cast("double").alias("score"))
    combined = scores.filter(F.col("field") == "combined").select("job_id", "score", "passed")
    failing = toxic_fields(reviews, sections, scores).withColumn("blk", F.floor(F.col("at") / SECTION_BLOCK))
    # names are joined per block of sections first, so one very long review is assembled in parallel
    parts = failing.groupBy("job_id", "blk").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "field"))), lambda s: s["field"]), ", ").alias("names"))
    named = parts.groupBy("job_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("blk", "names"))), lambda s: s["names"]), ", ").alias("names"))
    joined = reviews.select("job_id").join(combined, "job_id", "left").join(named, "job_id", "left")
    reason = F.when(F.col("passed").isNull(), F.lit(TOXIC_UNREACHABLE)).when(
        ~F.col("passed"), F.coalesce(F.concat(F.lit("toxic content detected in: "), F.col("names")),
                                     F.lit("toxic content detected")))
    return joined.select(
        "job_id", F.when(F.col("passed"), "pass").otherwise("quarantine").alias("verdict"), reason.alias("reason"), "score")


def judge_gate(reviews: DataFrame, scores: DataFrame, *, enabled: bool = True,
               threshold: float = JUDGE_THRESHOLD) -> DataFrame:
    """Pass when faithfulness and citation accuracy both reach the threshold; the reason names the failing.

    ``scores(job_id, metric, score)``; a review lacking either score is quarantined.
    """
    if not enabled:
        return reviews.select("job_id", F.lit("pass").alias("verdict"), F.lit(None).cast("string").alias("reason"))
    wide = scores.filter(F.col("metric").isin(JUDGE_METRICS)).groupBy("job_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in JUDGE_METRICS])
    joined = reviews.select("job_id").join(wide, "job_id", "left")
    missing = F.col("faithfulness").isNull() | F.col("citation_accuracy").isNull()
    failed = F.concat_ws(", ", *[F.when(F.col(m) < threshold, F.lit(m)) for m in JUDGE_METRICS])
    reason = F.when(missing, F.lit(JUDGE_UNREACHABLE)).when(
        failed != "", F.concat(F.lit("judge gate failed rubric item(s): "), failed))
    return joined.withColumn("reason", reason).select(
        "job_id", F.when(F.col("reason").isNull(), "pass").otherwise("quarantine").alias("verdict"), "reason")


def gate_chain(reviews: DataFrame, toxic: DataFrame, judge_scores: DataFrame, *, judge_enabled: bool = True) -> DataFrame:
    """Toxic gate first; only reviews it passed reach the judge gate. Every review keeps a row."""
    stopped = toxic.filter(F.col("verdict") == "quarantine").select(
        "job_id", F.lit("toxic").alias("gate"), F.coalesce("reason", F.lit("toxic gate failed")).alias("reason"))
    onward = reviews.join(stopped.select("job_id"), "job_id", "left_anti")
    judged = judge_gate(onward, judge_scores, enabled=judge_enabled).select(
        "job_id", F.when(F.col("verdict") == "quarantine", "judge").alias("gate"),
        F.when(F.col("verdict") == "quarantine", F.coalesce("reason", F.lit("judge gate failed"))).alias("reason"))
    both = stopped.unionByName(judged)
    return both.withColumn("status", F.when(F.col("gate").isNull(), "completed").otherwise("quarantined")).withColumn(
        "stage", F.lit("aggregation")).withColumn("progress", F.lit(1.0))


def regression_gate(scores: DataFrame, baseline: DataFrame, factor: float = BASELINE_FACTOR) -> DataFrame:
    """Pass when a score reaches ``factor`` of its metric's baseline."""
    required = F.col("baseline") * factor
    return scores.join(baseline, "metric").withColumn("required", required).withColumn(
        "passed", F.col("score") >= F.col("required"))


# output-side redaction -----------------------------------------------------------------------------

def _audit(found: DataFrame, stage: str, key: Column, types: str) -> DataFrame:
    return found.select(F.lit(stage).alias("stage"), key.cast("string").alias("key"),
                        F.explode(F.array_distinct(types)).alias("entity_type"))


def _with_terms(df: DataFrame, keys: Sequence[str], text: Column, terms: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with the listed places and people that its texts may hold, and these as arguments of a redaction."""
    if terms is None:
        return df, {}
    held = pii.with_terms(df, keys, text, terms, __locations="LOCATION", __persons="PERSON")
    return held, {"locations": F.col("__locations"), "persons": F.col("__persons")}


def scrub_reviews(reviews: DataFrame, *, terms: DataFrame | None = None, keys: Sequence[str] = ("theme_id",)) -> tuple[DataFrame, DataFrame]:
    """Redact synthesis and consensus only; audit rows say which type was found where, never the value. ``terms(kind, term)``."""
    held, lists = _with_terms(reviews, keys, F.array_append(F.coalesce("consensus", F.array().cast("array<string>")), F.col("review")), terms)
    review, in_review = pii.scrub(F.col("review"), pii.OUTPUT_SCOPE, **lists)
    consensus, in_consensus = pii.scrub_list(F.col("consensus"), pii.OUTPUT_SCOPE, **lists)
    found = held.withColumns({"__types": F.concat(in_review, in_consensus), "review": review, "consensus": consensus}).drop("__locations", "__persons")
    return found.drop("__types"), _audit(found, "theme_review", F.col("theme_id"), "__types")


def scrub_sections(sections: DataFrame, *, terms: DataFrame | None = None, keys: Sequence[str] = ("theme_id",)) -> tuple[DataFrame, DataFrame]:
    """Redact section content, after citations were resolved. ``terms(kind, term)``."""
    held, lists = _with_terms(sections, keys, F.col("content"), terms)
    content, types = pii.scrub(F.col("content"), pii.OUTPUT_SCOPE, **lists)
    found = held.withColumns({"__types": types, "content": content}).drop("__locations", "__persons")
    return found.drop("__types"), _audit(found, "aggregation", F.col("theme_id"), "__types")


def scrub_title_abstract(reviews: DataFrame, *, terms: DataFrame | None = None, keys: Sequence[str] = ("job_id",)) -> tuple[DataFrame, DataFrame]:
    """Redact title and abstract of the assembled review; the audit key is the field. ``terms(kind, term)``."""
    held, lists = _with_terms(reviews, keys, F.array("title", "abstract"), terms)
    title, in_title = pii.scrub(F.col("title"), pii.OUTPUT_SCOPE, **lists)
    abstract, in_abstract = pii.scrub(F.col("abstract"), pii.OUTPUT_SCOPE, **lists)
    found = held.withColumns({"__title": in_title, "__abstract": in_abstract, "title": title, "abstract": abstract})
    audit = _audit(found, "aggregation_reduce", F.lit("title"), "__title").unionByName(_audit(found, "aggregation_reduce", F.lit("abstract"), "__abstract"))
    return found.drop("__title", "__abstract", "__locations", "__persons"), audit
