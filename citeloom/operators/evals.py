"""Evaluation tabulations: averages, residual error, completeness, concordance, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import metric_key

# Fixed values.
SAMPLE_RATE = 0.10
MISS_THRESHOLD = 0.70
DOWNGRADE_PREFIX = "Not verified as "
REVIEW_FIELDS = ["title", "abstract", "sections", "citations", "references"]
SECTION_FIELDS = ["theme_id", "label", "content"]
FIELD_WEIGHT, SECTION_WEIGHT = 0.6, 0.4
JUDGE_CONTEXTS, JUDGE_CHARS = 50, 5000


def score_average(scores: DataFrame) -> DataFrame:
    """Mean score per metric key; missing scores are skipped."""
    return scores.filter(F.col("score").isNotNull()).groupBy(metric_key(F.col("metric")).alias("metric")).agg(
        F.avg("score").alias("score"))


def residual_error(themes: DataFrame, grounding: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per theme and in total (theme_id null): what the verification cascade still left wrong.

    ``themes(theme_id)``, ``grounding(theme_id, verdict, resolved_by)``, ``gaps(theme_id, entry)``.
    """
    judged = grounding.groupBy("theme_id").agg(
        F.count(F.lit(1)).alias("sentences"),
        F.count_if(F.col("verdict") == "grounded").alias("grounded"),
        F.count_if(F.col("verdict") == "contradicted").alias("contradicted"),
        F.count_if(F.col("resolved_by") == "deberta").alias("by_deberta"),
        F.count_if(F.col("resolved_by") == "llm_as_nli").alias("by_llm_as_nli"))
    downgraded = gaps.filter(F.startswith("entry", F.lit(DOWNGRADE_PREFIX))).groupBy("theme_id").agg(
        F.count(F.lit(1)).alias("nli_downgrades"))
    counts = ["sentences", "grounded", "contradicted", "by_deberta", "by_llm_as_nli", "nli_downgrades"]
    per_theme = themes.select("theme_id").distinct().join(judged, "theme_id", "left").join(
        downgraded, "theme_id", "left").select("theme_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    rows = per_theme.rollup("theme_id").agg(F.count(F.lit(1)).alias("themes"), *[F.sum(c).alias(c) for c in counts])
    rate = F.coalesce(F.try_divide(F.col("contradicted"), F.col("sentences")), F.lit(0.0))
    go = (F.col("contradicted") > 0) | (F.col("nli_downgrades") > 0)
    return rows.withColumn("contradicted_rate", rate).withColumn("verdict", F.when(go, "GO").otherwise("NO-GO"))


def judge_concordance(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new score per (case, metric) with their absolute difference."""
    left = old.select("case_id", "metric", F.col("score").alias("old_score"))
    right = new.select("case_id", "metric", F.col("score").alias("new_score"))
    return left.join(right, ["case_id", "metric"]).withColumn("abs_diff", F.abs(F.col("old_score") - F.col("new_score")))


_EMPTY = r'^(null|false|""|\[\]|\{\}|-?0(\.0+)?)$'


def _present(value: Column) -> Column:
    """A JSON value that counts as given: not null, false, zero, nor an empty text, list or object."""
    return F.coalesce(~F.rlike(F.to_json(value), F.lit(_EMPTY)), F.lit(False))


def schema_completeness(reviews: DataFrame, column: str = "review_json") -> DataFrame:
    """Score 0..1 for the required fields of a review document; 0 for invalid JSON.

    0.6 x share of top-level fields given + 0.4 x mean share of fields given per section.
    """
    parsed = reviews.withColumn("__v", F.try_parse_json(F.col(column)))

    def field(source: Column, name: str) -> Column:
        return F.try_variant_get(source, f"$.{name}", "variant")

    given = {name: _present(field(F.col("__v"), name)) for name in REVIEW_FIELDS}
    sections = F.try_variant_get(F.col("__v"), "$.sections", "array<variant>")

    def share(section: Column) -> Column:
        hits = [_present(field(section, name)).cast("int") for name in SECTION_FIELDS]
        return sum(hits[1:], hits[0]) / F.lit(len(SECTION_FIELDS))

    total = sum([c.cast("int") for c in given.values()], F.lit(0)) / F.lit(len(REVIEW_FIELDS))
    mean = F.aggregate(F.transform(sections, share), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(sections), F.lit(0))
    score = total * FIELD_WEIGHT + F.coalesce(F.when(F.size(sections) > 0, mean), F.lit(0.0)) * SECTION_WEIGHT
    missing = F.concat_ws(", ", *[F.when(~ok, F.lit(name)) for name, ok in given.items()])
    valid = F.col("__v").isNotNull()
    reason = F.when(~valid, F.lit("Output is not valid JSON")).when(
        missing != "", F.concat(F.lit("Missing fields: "), missing)).otherwise("All required fields present")
    return parsed.withColumn("score", F.when(valid, score).otherwise(0.0)).withColumn("reason", reason).drop("__v")


def tool_correctness(output: Column, tool: Column) -> Column:
    """1.0 when the expected tool's name occurs in the output, ignoring case."""
    return F.when(F.contains(F.lower(F.coalesce(output, F.lit(""))), F.lower(tool)), 1.0).otherwise(0.0)


HASH_CELLS = 1 << 16


def sample_exact(rows: DataFrame, id_col: str, rate: float = SAMPLE_RATE, seed: str = "0") -> DataFrame:
    """Uniform sample of exactly max(1, int(rate * n)) rows, repeatable for a seed.

    Rows are ordered by a seeded hash. Instead of sorting everything, the hash prefix is counted
    into a fixed number of cells; whole cells are taken up to the cut, and only the cut cell is
    ranked.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))))
    hashed = hashed.withColumn("__cell", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    cells = hashed.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"))  # at most HASH_CELLS rows
    upto = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    wanted = F.greatest(F.lit(1), F.floor(F.sum("n").over(everything) * F.lit(rate)))
    marked = cells.select("__cell", (F.sum("n").over(upto) - F.col("n")).alias("before"), "n", wanted.alias("wanted"))
    taken = marked.filter(F.col("before") < F.col("wanted")).select(
        "__cell", (F.col("wanted") - F.col("before")).alias("room"), (F.col("before") + F.col("n") > F.col("wanted")).alias("cut"))
    kept = hashed.join(F.broadcast(taken), "__cell")  # bounded by HASH_CELLS
    whole = kept.filter(~F.col("cut"))
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy("__h", id_col))
    partial = kept.filter("cut").withColumn("__rn", rank).filter(F.col("__rn") <= F.col("room")).drop("__rn")
    return whole.unionByName(partial).select(*rows.columns)


def sample_fraction(rows: DataFrame, rate: float = SAMPLE_RATE, seed: int = 0) -> DataFrame:
    """Approximate sample: each row is kept with probability ``rate``."""
    return rows.sample(fraction=rate, seed=seed)


def scoreable_traces(traces: DataFrame) -> DataFrame:
    """Traces with input and output; ``has_contexts`` says whether context metrics apply."""
    filled = (F.coalesce("input", F.lit("")) != "") & (F.coalesce("output", F.lit("")) != "")
    return traces.filter(filled).withColumn("has_contexts", F.coalesce(F.size("retrieved_contexts") > 0, F.lit(False)))


def production_misses(scores: DataFrame, threshold: float = MISS_THRESHOLD) -> DataFrame:
    """Faithfulness scores below the production threshold."""
    return scores.filter((F.col("metric") == "faithfulness") & (F.col("score") < threshold))


def judge_contexts(claims: DataFrame, order: Column, limit: int = JUDGE_CONTEXTS, chars: int = JUDGE_CHARS) -> DataFrame:
    """First ``limit`` claim texts of every job as judge context, each cut to ``chars`` characters."""
    first = Window.partitionBy("job_id").orderBy(order)
    return claims.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit).withColumn(
        "text", F.substring("text", 1, chars))


def latest_job(jobs: DataFrame) -> DataFrame:
    """The most recently modified job."""
    return jobs.agg(F.max_by("job_id", F.struct("modified_at", "job_id")).alias("job_id"), F.max("modified_at").alias("modified_at"))
