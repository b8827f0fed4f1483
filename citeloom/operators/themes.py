"""Theme merging, bucketing, mapping, matching and reconciliation.

Lists that can grow with the corpus (members, aliases, papers of a reconciled theme) are kept in
long form with a position column; arrays appear only where a group is bounded, as in buckets.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ordered import with_position
from citeloom.functions.text import normalize_theme_name, theme_text
from citeloom.functions.vectors import cosine
from citeloom.operators.graph import connected_components
from citeloom.operators.similarity import RECONCILE_THRESHOLD, similar_pairs
from citeloom.runtime import materialise, shuffled

# Largest bucket, and the contradiction score a pair needs both ways to be flagged.
MAX_BUCKET = 20
CONTRADICTION = 0.5


def merge_chunks(themes: DataFrame, positions: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge the results of one paper's chunks by normalised theme name.

    ``themes(paper_id, chunk, pos, theme_id, name, description)``, ``positions(paper_id, theme_id,
    at, page, paragraph)``, ``claims(paper_id, theme_id, ..)``. The first theme of a name is
    canonical and keeps its positions as they are; later ones add positions not seen yet; claims are
    re-pointed and all kept.
    """
    keyed = themes.withColumn("key", normalize_theme_name(F.coalesce("name", F.lit(""))))
    order = F.struct("chunk", "pos")
    canonical = keyed.groupBy("paper_id", "key").agg(
        F.min_by(F.struct("theme_id", "name", "description"), order).alias("t"), F.min(order).alias("first"))
    remap = materialise(keyed.join(canonical, ["paper_id", "key"]).select(
        "paper_id", "theme_id", F.col("t.theme_id").alias("canonical_id"), "chunk", "pos"))
    merged_themes = canonical.select("paper_id", "t.*", F.col("first.chunk").alias("chunk"), F.col("first.pos").alias("pos"))
    arriving = positions.join(remap, ["paper_id", "theme_id"]).select(
        "paper_id", "canonical_id", "page", "paragraph", (F.col("theme_id") == F.col("canonical_id")).alias("own"),
        F.struct("chunk", "pos", "at").alias("arrival"))
    spot = ["paper_id", "canonical_id", "page", "paragraph"]
    own = arriving.filter("own").select(*spot, "arrival")
    added = arriving.groupBy(*spot).agg(F.min("arrival").alias("arrival"), F.bool_or("own").alias("has_own"))
    merged_positions = own.unionByName(added.filter(~F.col("has_own")).select(*spot, "arrival")).select(
        *spot, "arrival.chunk", "arrival.pos", "arrival.at")
    pointed = claims.join(remap.select("paper_id", "theme_id", "canonical_id"), ["paper_id", "theme_id"], "left")
    merged_claims = pointed.withColumn("theme_id", F.coalesce("canonical_id", "theme_id")).drop("canonical_id")
    return merged_themes, merged_positions, merged_claims


def cap_buckets(components: DataFrame, vectors: DataFrame, cap: int = MAX_BUCKET) -> DataFrame:
    """(job_id, pos, component, sub): components over ``cap`` members are dealt into ceil(n / cap) parts.

    Members are ordered by similarity to the component's mean vector, most similar first (ties by
    position), and dealt round-robin, so every part is a cross-section.
    """
    key = ["job_id", "component"]
    sized = components.join(components.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)
    small = sized.filter(F.col("n") <= cap).select("job_id", "pos", "component", F.lit(0).cast("long").alias("sub"))
    large = sized.filter(F.col("n") > cap).join(vectors.select("job_id", "pos", "vec"), ["job_id", "pos"])
    # one vector sum per task and component, not a row per dimension
    centre = large.groupBy(*key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("vec")))).alias("centre"))
    near = large.join(centre, key).select(*key, "pos", "n", cosine(F.col("vec"), F.col("centre")).alias("near"))
    dealt = with_position(near, key, [-F.col("near"), F.col("pos")], "rank")
    return small.unionByName(dealt.select(
        "job_id", "pos", "component", F.pmod("rank", F.ceil(F.col("n") / F.lit(cap))).alias("sub")))


def select_indices(groups: DataFrame, themes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group members that point into their bucket's theme list, and those that do not.

    ``groups(bucket, group_no, .., member_indices)``, ``themes(bucket, idx, ..)`` with idx 0..n-1.
    """
    members = groups.select("bucket", "group_no", "canonical_name", "description",
                            F.posexplode("member_indices").alias("at", "idx"))
    known = themes.select("bucket", "idx", F.lit(True).alias("known"))
    checked = members.join(known, ["bucket", "idx"], "left")
    offenders = checked.filter("known is null").select(
        "bucket", "group_no", "at", "idx",
        F.concat(F.lit("group '"), F.col("canonical_name"), F.lit("' references index "),
                 F.col("idx").cast("string")).alias("problem"))
    return checked.filter("known").drop("known"), offenders


def group_id(bucket: Column, group_no: Column) -> Column:
    return F.md5(F.concat_ws("|", bucket.cast("string"), group_no.cast("string")))


def build_theme_map(groups: DataFrame, themes: DataFrame) -> DataFrame:
    """One canonical theme per group with ordered source ids and distinct papers and aliases.

    A group lives inside a bucket of at most MAX_BUCKET themes, which bounds its arrays.
    """
    members, _ = select_indices(groups, themes)
    details = members.join(themes.select("bucket", "idx", "theme_id", "name", "paper_id"), ["bucket", "idx"])

    def ordered(column: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("at", column))), lambda s: s[column])

    def distinct_filled(values: Column) -> Column:
        return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))

    built = details.groupBy("bucket", "group_no").agg(
        ordered("theme_id").alias("source_theme_ids"), distinct_filled(ordered("paper_id")).alias("paper_ids"),
        distinct_filled(ordered("name")).alias("aliases"))
    none = F.array().cast("array<string>")
    return groups.drop("member_indices").join(built, ["bucket", "group_no"], "left").select(
        group_id(F.col("bucket"), F.col("group_no")).alias("canonical_id"), "bucket", "group_no",
        F.col("canonical_name").alias("name"), "description",
        *[F.coalesce(c, none).alias(c) for c in ("paper_ids", "aliases", "source_theme_ids")])


def group_contradictions(groups: DataFrame, themes: DataFrame, scores: DataFrame,
                         threshold: float = CONTRADICTION) -> DataFrame:
    """Member pairs of a group whose contradiction score reaches ``threshold`` in both directions.

    Driven by the supplied ``scores(a, b, contradiction)`` of theme ids: each score row is placed in
    the groups that hold both its themes, so no member pair is formed that was not scored.
    """
    members, _ = select_indices(groups, themes)
    ids = members.join(themes.select("bucket", "idx", "theme_id"), ["bucket", "idx"]).select(
        "bucket", "group_no", "canonical_name", "idx", "theme_id")
    left = ids.withColumnRenamed("theme_id", "a").withColumnRenamed("idx", "ia")
    right = ids.select("bucket", "group_no", F.col("theme_id").alias("b"), F.col("idx").alias("ib"))
    strong = scores.filter(F.col("contradiction") >= threshold).groupBy("a", "b").agg(
        F.max("contradiction").alias("contradiction"))
    placed = strong.join(left, "a").join(right, ["b", "bucket", "group_no"]).filter("ia <> ib")
    return (
        placed.groupBy("bucket", "group_no", "canonical_name", F.least("ia", "ib").alias("idx_a"),
                       F.greatest("ia", "ib").alias("idx_b"))
        .agg(F.count_distinct("ia").alias("directions")).filter("directions = 2").drop("directions")
        .withColumn("problem", F.concat(
            F.lit("themes at indices "), F.col("idx_a").cast("string"), F.lit(" and "), F.col("idx_b").cast("string"),
            F.lit(" were grouped as '"), F.col("canonical_name"), F.lit("' but do not appear semantically equivalent")))
    )


def reconcile_themes(themes: DataFrame, vectors: DataFrame, members: DataFrame,
                     threshold: float = RECONCILE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Merge canonical themes of a job that are connected at ``threshold``.

    ``themes(job_id, pos, canonical_id, name, description)``, ``vectors(job_id, pos, vec)`` and
    ``members(canonical_id, kind, at, value)`` with kind source / paper / alias. Returns the merged
    themes (name and description of the first member; id kept by singletons, else made from the
    members) and their members in long form: sources all kept, papers and aliases once, at their
    first appearance.
    """
    edges = similar_pairs(vectors, threshold)
    labels = materialise(connected_components(themes, edges))
    placed = themes.join(labels, ["job_id", "pos"])
    merged = placed.groupBy("job_id", "component").agg(
        F.min_by(F.struct("canonical_id", "name", "description"), "pos").alias("first"), F.count(F.lit(1)).alias("n"))
    new_id = F.when(F.col("n") == 1, F.col("first.canonical_id")).otherwise(
        F.md5(F.concat_ws("|", F.lit("merged"), F.col("job_id").cast("string"), F.col("first.canonical_id"))))
    final = merged.select("job_id", "component", new_id.alias("canonical_id"), "first.name", "first.description", "n")
    moved = placed.select("job_id", "component", "pos", "canonical_id").join(members, "canonical_id").drop("canonical_id")
    once = moved.filter("kind <> 'source'").groupBy("job_id", "component", "kind", "value").agg(
        F.min(F.struct("pos", "at")).alias("first")).select("job_id", "component", "kind", "value", "first.pos", "first.at")
    sources = moved.filter("kind = 'source'").select("job_id", "component", "kind", "value", "pos", "at")
    listed = sources.unionByName(once).join(final.select("job_id", "component", "canonical_id"), ["job_id", "component"])
    return final, listed.select("job_id", "canonical_id", "kind", "pos", "at", "value")


def claims_for_theme(canonical: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims of each canonical theme: those of its source themes, or of its own id when it lists none."""
    own = F.when(F.size("source_theme_ids") > 0, F.array_distinct("source_theme_ids")).otherwise(F.array("canonical_id"))
    wanted = canonical.select("canonical_id", F.explode(own).alias("theme_id"))
    return claims.join(wanted, "theme_id")


def match_theme_name(reviews: DataFrame, themes: DataFrame) -> DataFrame:
    """Theme id of a review by its free-text name, inside one batch of at most a few themes.

    Exact on the normalised name (last theme of a name wins), else the first theme, in batch order,
    where one name contains the other, else the name itself. ``reviews(batch, review_no,
    theme_name)``, ``themes(batch, pos, theme_id, name)``.
    """
    names = themes.withColumn("key", normalize_theme_name(F.coalesce("name", F.lit("")))).groupBy("batch", "key").agg(
        F.min("pos").alias("pos"), F.max_by(F.struct("theme_id", "name"), "pos").alias("t"))
    asked = reviews.withColumn("key", normalize_theme_name(F.col("theme_name")))
    exact = asked.join(shuffled(names.select("batch", "key", F.col("t").alias("exact"))), ["batch", "key"], "left")
    found = exact.filter("exact is not null").withColumnRenamed("exact", "hit")
    missed = exact.filter("exact is null").drop("exact")
    # equi join on the batch, which holds at most five themes
    candidates = names.select("batch", F.col("key").alias("known"), "pos", "t")
    contained = (
        missed.join(shuffled(candidates), "batch")
        .filter(F.contains(F.col("known"), F.col("key")) | F.contains(F.col("key"), F.col("known")))
        .groupBy("batch", "review_no").agg(F.min_by("t", "pos").alias("hit"))
    )
    second = missed.join(shuffled(contained), ["batch", "review_no"], "left")
    return found.unionByName(second).select(
        "batch", "review_no", "theme_name", F.col("hit").isNotNull().alias("matched"),
        F.coalesce("hit.theme_id", "theme_name").alias("theme_id"), F.coalesce("hit.name", "theme_name").alias("label"))


def assign_batches(rows: DataFrame, keys: list[str], order: list[Column], size: int = 5) -> DataFrame:
    """Consecutive batches of ``size`` in input order: ``batch`` and ``at`` inside the batch."""
    placed = with_position(rows, keys, order, "position")
    return placed.withColumn("batch", F.floor(F.col("position") / size)).withColumn(
        "at", F.pmod("position", F.lit(size))).drop("position")


def dedup_list(themes: DataFrame) -> DataFrame:
    """Numbered theme lines of a bucket, as shown to the grouping model."""
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.coalesce("name", F.lit("Unknown")),
                    F.lit(" — "), F.coalesce("description", F.lit("")), F.lit(" (paper: "),
                    F.coalesce("paper_id", F.lit("unknown")), F.lit(")"))
    lines = themes.select("bucket", F.struct("idx", line.alias("line")).alias("row"))
    return lines.groupBy("bucket").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("row")), lambda s: s["line"]), "\n").alias("message"))


def with_theme_text(themes: DataFrame) -> DataFrame:
    return themes.withColumn("text", theme_text(F.col("name"), F.col("description")))
