"""Grounding of claims and synthesis sentences over supplied vectors, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import split_sentences
from citeloom.functions.vectors import cosine
from citeloom.runtime import shuffled

# Support a claim needs, confidence of the two verdicts, names of the two resolvers.
PROVENANCE_THRESHOLD = 0.65
CONFIDENT = 0.7
FIRST_TIER = "deberta"
SECOND_TIER = "llm_as_nli"


def grounding_score(text_vec: str, deep_vec: str) -> Column:
    """Similarity of a claim to its own evidence excerpt."""
    return cosine(F.col(text_vec), F.col(deep_vec))


def provenance_filter(themes: DataFrame, claims: DataFrame, threshold: float = PROVENANCE_THRESHOLD
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(themes with their remaining claim count, kept claims, dropped claims); themes always stay.

    ``claims`` carry a ``score``.
    """
    kept = claims.filter(F.col("score") >= threshold)
    dropped = claims.filter(F.col("score") < threshold)
    counts = kept.groupBy("theme_id").agg(F.count(F.lit(1)).alias("n_claims"))
    counted = themes.join(counts, "theme_id", "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))
    return counted, kept, dropped


def sentence_claim_pairs(reviews: DataFrame, claims: DataFrame) -> DataFrame:
    """Every sentence of a theme's synthesis next to every claim of the theme, ready for scoring.

    The sentences of one short synthesis ride along as an array on the claim side of the join, so a
    theme with very many claims stays spread over its claims' partitions.
    """
    sentences = reviews.select("theme_id", split_sentences(F.col("review")).alias("sentences"))
    return claims.join(sentences, "theme_id").select(
        *claims.columns, F.posexplode("sentences").alias("sentence_pos", "sentence"))


def grounding_verdict(scores: DataFrame, keys: list[str], confident: float = CONFIDENT) -> DataFrame:
    """Verdict per sentence from its claims' probabilities.

    Grounded if the best entailment is confident, else contradicted if the best contradiction is,
    else borderline. The first claim wins ties; the claim that decided is reported with its scores.
    """
    row = F.struct("claim_id", "contradiction", "entailment", "neutral")
    best = scores.groupBy(*keys).agg(
        F.max_by(row, F.struct(F.col("entailment"), -F.col("claim_pos"))).alias("e"),
        F.max_by(row, F.struct(F.col("contradiction"), -F.col("claim_pos"))).alias("c"))
    verdict = F.when(F.col("e.entailment") >= confident, "grounded").when(
        F.col("c.contradiction") >= confident, "contradicted").otherwise("borderline")
    judged = best.withColumn("verdict", verdict)
    pick = F.when(F.col("verdict") == "contradicted", F.col("c")).otherwise(F.col("e"))
    return judged.select(*keys, "verdict", pick.alias("best")).select(
        *keys, "verdict", F.col("best.claim_id").alias("best_claim_id"), "best.contradiction", "best.entailment",
        "best.neutral", F.lit(FIRST_TIER).alias("resolved_by"))


def resolve_borderline(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Second-tier labels decide borderline sentences and every other row with the same sentence text.

    ``verdicts(theme_id, sentence, verdict, resolved_by, ..)``, ``labels(theme_id, sentence, label)``
    with one label per borderline text.
    """
    borderline = verdicts.filter(F.col("verdict") == "borderline").select("theme_id", "sentence").distinct()
    decided = labels.join(shuffled(borderline), ["theme_id", "sentence"], "left_semi").groupBy("theme_id", "sentence").agg(
        F.max("label").alias("label"))
    joined = verdicts.join(shuffled(decided), ["theme_id", "sentence"], "left")
    outcome = F.when(F.col("label") == "ENTAILED", "grounded").otherwise("contradicted")
    hit = F.col("label").isNotNull()
    return joined.withColumn("verdict", F.when(hit, outcome).otherwise(F.col("verdict"))).withColumn(
        "resolved_by", F.when(hit, F.lit(SECOND_TIER)).otherwise(F.col("resolved_by"))).drop("label")


def downgrade(entry: Column, kind: Column) -> Column:
    return F.concat(F.lit("Not verified as "), F.lower(kind), F.lit(": "), entry)


def verify_sections(reviews: DataFrame, labels: DataFrame, claims: DataFrame) -> DataFrame:
    """Move consensus and disagreement entries the verifier did not confirm into the gaps.

    ``reviews(theme_id, consensus, disagreements, gaps)``, ``labels(theme_id, kind, at, label)``. An
    entry without a label counts as not confirmed. Themes without claims are left as they are. The
    lists are regrouped per review and are no longer than they came in.
    """
    evidenced = claims.select("theme_id").distinct().withColumn("evidenced", F.lit(True))
    marked = reviews.join(shuffled(evidenced), "theme_id", "left")

    def entries(column: str, kind: str) -> DataFrame:
        return marked.filter("evidenced").select(
            "theme_id", F.lit(kind).alias("kind"), F.posexplode(column).alias("at", "entry"))

    both = entries("consensus", "CONSENSUS").unionByName(entries("disagreements", "DISAGREEMENT"))
    checked = both.join(shuffled(labels), ["theme_id", "kind", "at"], "left").withColumn(
        "holds", F.coalesce(F.col("label") == F.col("kind"), F.lit(False)))
    item = F.struct("kind", "at", "holds", "entry")
    gathered = checked.groupBy("theme_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def kept(kind: str) -> Column:
        return F.transform(F.filter("items", lambda s: s["holds"] & (s["kind"] == kind)), lambda s: s["entry"])

    failed = F.transform(F.filter("items", lambda s: ~s["holds"]), lambda s: downgrade(s["entry"], s["kind"]))
    none = F.array().cast("array<string>")
    joined = marked.join(shuffled(gathered), "theme_id", "left")
    checked_row = F.col("evidenced").isNotNull()
    rest = [c for c in reviews.columns if c not in ("consensus", "disagreements", "gaps")]
    return joined.select(
        *rest,
        F.when(checked_row, F.coalesce(kept("CONSENSUS"), none)).otherwise(F.col("consensus")).alias("consensus"),
        F.when(checked_row, F.coalesce(kept("DISAGREEMENT"), none)).otherwise(F.col("disagreements")).alias("disagreements"),
        F.concat("gaps", F.coalesce(failed, none)).alias("gaps"))


def valid_claims(key_claims: DataFrame, batch_claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key claims whose id belongs to the batch's claims, and the rest with how many a theme has.

    ``key_claims(batch, theme_name, claim_id, ..)``, ``batch_claims(batch, claim_id)``.
    """
    ids = batch_claims.select("batch", "claim_id").distinct()
    kept = key_claims.join(ids, ["batch", "claim_id"], "left_semi")
    invalid = key_claims.join(ids, ["batch", "claim_id"], "left_anti")
    counts = invalid.groupBy("batch", "theme_name").agg(F.count(F.lit(1)).alias("n_invalid"))
    return kept, invalid.join(counts, ["batch", "theme_name"])
