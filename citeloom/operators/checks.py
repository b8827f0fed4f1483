"""Table checks: violations as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed label sets and the longest chat message.
LABELS = {
    "job_state": ["pending", "running", "completed", "failed", "quarantined"],
    "consensus": ["CONSENSUS", "DISAGREEMENT", "NEITHER"],
    "entailment": ["ENTAILED", "CONTRADICTED", "NEUTRAL"],
    "event_type": [
        "job_created", "job_started", "job_completed", "job_failed", "stage_started", "stage_completed",
        "stage_failed", "paper_ingested", "paper_processed", "paper_analyzed", "paper_rejected",
        "theme_extracted", "theme_deduplicated", "claim_extracted", "review_generated", "review_quarantined",
        "agent_started", "agent_tool_call", "agent_tool_result", "agent_content", "agent_completed", "agent_error"],
}
MAX_MESSAGE_CHARS = 10_000


def non_empty(df: DataFrame, table: str, key: str, columns: list[str]) -> DataFrame:
    """(table_name, key, rule) for each listed text or list that is missing or empty."""
    def empty(name: str) -> Column:
        size = F.size(name) if df.schema[name].dataType.typeName() == "array" else F.length(name)
        return F.coalesce(size == 0, F.lit(True)) | F.col(name).isNull()

    rules = F.array_compact(F.array(*[F.when(empty(c), F.lit(f"{c} is empty")) for c in columns]))
    return df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("key"), F.explode(rules).alias("rule"))


def group_membership(groups: DataFrame, themes: DataFrame) -> DataFrame:
    """Themes that are in no group or in several. ``groups(bucket, member_indices)``, ``themes(bucket, idx)``."""
    counts = groups.select("bucket", F.explode("member_indices").alias("idx")).groupBy("bucket", "idx").agg(
        F.count(F.lit(1)).alias("n"))
    return themes.select("bucket", "idx").join(counts, ["bucket", "idx"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))).filter("n <> 1")


def acceptance(counts: DataFrame, expected: DataFrame, cited: DataFrame) -> DataFrame:
    """Per job the expectations that do not hold.

    ``expected(job_id, expect_paper_count, expect_theme_count_min, expect_claim_count_min,
    expect_review_sections_min, expect_review_has_citations)``, nulls are not checked; ``cited(job_id,
    has_citations)``.
    """
    joined = expected.join(counts, "job_id", "left").join(cited, "job_id", "left")

    def below(expect: str, actual: str, what: str) -> Column:
        short = F.col(expect).isNotNull() & (F.coalesce(F.col(actual), F.lit(0)) < F.col(expect))
        return F.when(short, F.concat(F.lit("expected >= "), F.col(expect).cast("string"), F.lit(f" {what}, got "),
                                      F.coalesce(F.col(actual), F.lit(0)).cast("string")))

    papers = F.coalesce("paper_count", F.lit(0))
    wrong_papers = F.when(F.col("expect_paper_count").isNotNull() & (papers != F.col("expect_paper_count")), F.concat(
        F.lit("expected "), F.col("expect_paper_count").cast("string"), F.lit(" papers, got "), papers.cast("string")))
    no_cites = F.when(F.coalesce("expect_review_has_citations", F.lit(False)) & ~F.coalesce("has_citations", F.lit(False)),
                      F.lit("no citations found"))
    failures = F.array_compact(F.array(
        wrong_papers, below("expect_theme_count_min", "theme_count", "themes"),
        below("expect_claim_count_min", "claim_count", "claims"),
        below("expect_review_sections_min", "section_count", "sections"), no_cites))
    return joined.select("job_id", F.explode(failures).alias("failure"))


def has_citation(text: Column) -> Column:
    """The acceptance heuristic: a bracket or 'et al.' somewhere in the review."""
    return F.contains(text, F.lit("[")) | F.contains(text, F.lit("et al."))


def chat_expectations(cases: DataFrame) -> DataFrame:
    """Failed chat expectations. ``cases(case_id, content, n_steps, tools, expect_contains,
    expect_not_contains, expect_steps_min, expect_tools)``."""
    content = F.lower("content")
    missing = F.transform(F.filter("expect_contains", lambda s: ~F.contains(content, F.lower(s))),
                          lambda s: F.concat(F.lit("expected response to contain '"), s, F.lit("'")))
    present = F.transform(F.filter("expect_not_contains", lambda s: F.contains(content, F.lower(s))),
                          lambda s: F.concat(F.lit("response should not contain '"), s, F.lit("'")))
    steps = F.when(F.col("n_steps") < F.col("expect_steps_min"), F.array(F.concat(
        F.lit("expected >= "), F.col("expect_steps_min").cast("string"), F.lit(" steps, got "), F.col("n_steps").cast("string")))
    ).otherwise(F.array().cast("array<string>"))
    tools = F.transform(F.array_except("expect_tools", "tools"), lambda s: F.concat(F.lit("expected tool '"), s, F.lit("' not called")))
    return cases.select("case_id", F.explode(F.concat(missing, present, steps, tools)).alias("failure"))


def message_limits(messages: DataFrame, column: str = "text") -> DataFrame:
    """Messages that would be refused, with the reason; length counts after trimming."""
    trimmed = F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
    reason = F.when(trimmed == "", F.lit("Message cannot be empty")).when(
        F.length(trimmed) > MAX_MESSAGE_CHARS, F.lit(f"Message too long (max {MAX_MESSAGE_CHARS} characters)"))
    return messages.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def label_domain(df: DataFrame, table: str, key: str, column: str, domain: str) -> DataFrame:
    """Rows whose label is outside its closed set."""
    bad = F.coalesce(~F.col(column).isin(LABELS[domain]), F.lit(True))
    return df.filter(bad).select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("key"),
                                 F.concat(F.lit(f"{column} outside {domain}: "), F.coalesce(column, F.lit("null"))).alias("rule"))


def all_of(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)
