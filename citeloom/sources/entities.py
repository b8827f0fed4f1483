"""Per-job entity tables and the five searchable collections, kept as parquet.

A collection is a numbered manifest that names the folders of each bucket of ids: its base and the updates after it. An upsert writes
its own rows and then publishes the next manifest, so readers see the old or the new version, never a mixture, a failed write
leaves the old one, and of two writers at the same time the second fails instead of undoing the first. Readers put updates in
place of what they replace; a bucket with ``DELTAS`` of them is written anew with the next one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import point_id, theme_text
from citeloom.runtime import materialise

SCHEMAS = {
    "papers": "paper_id string, filename string, title string, authors array<string>, page_count int, ingested_at timestamp, job_id string",
    "themes": "theme_id string, name string, description string, paper_id string, positions array<struct<page:int,paragraph:int>>, job_id string",
    "claims": "claim_id string, theme_id string, theme_name string, text string, page int, paragraph int, deep string, summary string, "
              "paper_id string, job_id string",
    "theme_map": "canonical_id string, pos bigint, theme_id string, job_id string",
    "theme_reviews": "theme_id string, label string, review string, consensus array<string>, disagreements array<string>, gaps array<string>, "
                     "job_id string",
    "review": "title string, abstract string, job_id string",
    "status": "status string, stage string, progress double, paper_count int, created_at timestamp, updated_at timestamp, error string, "
              "quarantine_reason string, job_id string",
}

_POINT = "id string, job_id string, text string, vec array<double>"
COLLECTION_SCHEMAS = {
    "paper_themes": _POINT + ", paper_id string, name string, description string",
    "paper_claims": _POINT + ", paper_id string, theme_id string, theme_name string, page int, paragraph int, deep string, summary string",
    "theme_map": _POINT + ", name string, description string, paper_ids array<string>, aliases array<string>, source_theme_ids array<string>",
    "theme_reviews": _POINT + ", theme_id string, label string, consensus array<string>, disagreements array<string>, gaps array<string>",
    "literature_review": _POINT + ", theme_id string, label string, title string, abstract string, citation_refs array<bigint>",
}


def write_entity(df: DataFrame, root: str, name: str) -> None:
    """Write the jobs in ``df``, replacing those jobs only.

    Rebalancing puts the rows of small jobs together and spreads those of a very large one.
    """
    df.hint("rebalance", "job_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(f"{root}/{name}")


def read_entity(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """An entity table; empty with its declared columns when it was never written."""
    declared = schema or SCHEMAS[name]
    try:
        return spark.read.schema(declared).parquet(f"{root}/{name}")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], declared)


# collections -----------------------------------------------------------------------------------------

BUCKETS = 64
DELTAS = 8


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of a collection's manifests, oldest first."""
    folder, fs = _path(spark, f"{root}/{name}/manifests")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []


def _read_manifest(spark: SparkSession, root: str, name: str, number: int) -> dict[int, list[str]]:
    """Folders of each bucket that has rows, oldest first."""
    lines = spark.read.text(f"{root}/{name}/manifests/{number}").collect()  # at most BUCKETS lines of at most DELTAS + 1 folders
    return {int(k): v.split(" ") for k, v in (r["value"].split(" ", 1) for r in lines if r["value"])}


def _publish(spark: SparkSession, root: str, name: str, number: int, buckets: dict[int, list[str]]) -> None:
    """Fails if another writer has published this number meanwhile."""
    file, fs = _path(spark, f"{root}/{name}/manifests/{number}")
    out = fs.create(file, False)
    out.write(bytearray("".join(f"{k} {' '.join(v)}\n" for k, v in sorted(buckets.items())).encode()))
    out.close()


def ensure_collections(spark: SparkSession, root: str) -> list[str]:
    """Create the collections that do not exist yet, empty; returns their names."""
    created = []
    for name in COLLECTION_SCHEMAS:
        if not _manifests(spark, root, name):
            _publish(spark, root, name, 0, {})
            created.append(name)
    return created


def _rows(spark: SparkSession, root: str, name: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], COLLECTION_SCHEMAS[name])
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{name}/{f}" for f in folders])


def _merged(spark: SparkSession, root: str, name: str, buckets: dict[int, list[str]], key: str = "id") -> DataFrame:
    """Rows of the buckets with their updates in place. Only the ids of updates meet the bases that they belong to."""
    whole = _rows(spark, root, name, [folders[0] for folders in buckets.values() if len(folders) == 1])
    updated = [folders for folders in buckets.values() if len(folders) > 1]
    if not updated:
        return whole
    base, deltas = _rows(spark, root, name, [folders[0] for folders in updated]), None
    for i in range(1, max(map(len, updated))):
        rows = _rows(spark, root, name, [folders[i] for folders in updated if len(folders) > i]).withColumn("__n", F.lit(i))
        deltas = rows if deltas is None else deltas.unionByName(rows, allowMissingColumns=True)
    found = whole.unionByName(merge_points(base, last_per_key(deltas, "__n", key), key), allowMissingColumns=True)
    return found.select(*base.columns, *[c for c in found.columns if c not in base.columns])


def read_collection(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The current version of a collection, or None when there is none."""
    known = _manifests(spark, root, name)
    return _merged(spark, root, name, _read_manifest(spark, root, name, known[-1])) if known else None


def merge_points(target: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Target rows with updates put in place by key."""
    return target.join(updates.select(key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def last_per_key(updates: DataFrame, order: str, key: str = "id") -> DataFrame:
    """One row per key: the one with the highest ``order``."""
    others = [c for c in updates.columns if c not in (key, order)]
    return updates.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def upsert(spark: SparkSession, root: str, name: str, updates: DataFrame, key: str = "id", order: str | None = None) -> None:
    """Insert or replace points by id. Of an id that repeats within ``updates`` the row with the highest ``order`` is
    kept; without an order, the greatest row.

    Rows lie in ``BUCKETS`` buckets by a hash of the id. What is written is the updates, and the buckets among those they touch that already have
    ``DELTAS`` updates; nothing else is read.
    """
    known = _manifests(spark, root, name)
    held = _read_manifest(spark, root, name, known[-1]) if known else {}
    others = [c for c in updates.columns if c != key]
    single = last_per_key(updates, order, key) if order else updates.groupBy(key).agg(F.max(F.struct(*others)).alias("r")).select(key, "r.*")
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    new = materialise(single.withColumn("bucket", bucket))
    touched = [r[0] for r in new.select("bucket").distinct().collect()]
    full = [k for k in touched if len(held.get(k, [])) > DELTAS]
    rows = new
    if full:
        old = _merged(spark, root, name, {k: held[k] for k in full}, key).withColumn("bucket", bucket)
        rows = merge_points(old, new.filter(F.col("bucket").isin(full)), key).unionByName(new.filter(~F.col("bucket").isin(full)), allowMissingColumns=True)
    version = f"version-{uuid.uuid4().hex}"
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{root}/{name}/{version}")
    now = {k: [*([] if k in full else held.get(k, [])), f"{version}/bucket={k}"] for k in touched}
    _publish(spark, root, name, known[-1] + 1 if known else 0, held | now)


def vacuum(spark: SparkSession, root: str, name: str, keep: int = 2) -> int:
    """Delete bucket folders that none of the last ``keep`` manifests names, and older manifests; returns how many."""
    known = _manifests(spark, root, name)
    used = {folder for number in known[-keep:] for folders in _read_manifest(spark, root, name, number).values() for folder in folders}
    base, fs = _path(spark, f"{root}/{name}")
    gone = 0
    for version in fs.listStatus(base):
        if version.getPath().getName().startswith("version-"):
            for part in fs.listStatus(version.getPath()):
                own = f"{version.getPath().getName()}/{part.getPath().getName()}"
                if own.split("/")[1].startswith("bucket=") and own not in used:
                    gone += fs.delete(part.getPath(), True)
    for number in known[:-keep]:
        fs.delete(_path(spark, f"{root}/{name}/manifests/{number}")[0], False)
    return gone


# rows of the collections, before the vector is attached -------------------------------------------------

def theme_points(themes: DataFrame) -> DataFrame:
    return themes.select(F.col("theme_id").alias("id"), "job_id", theme_text(F.col("name"), F.col("description")).alias("text"),
                         "paper_id", "name", F.coalesce("description", F.lit("")).alias("description"))


def claim_points(claims: DataFrame) -> DataFrame:
    blank, zero = F.lit(""), F.lit(0)
    return claims.select(F.col("claim_id").alias("id"), "job_id", "text", "paper_id", F.coalesce("theme_id", blank).alias("theme_id"),
                         F.coalesce("theme_name", blank).alias("theme_name"), F.coalesce("page", zero).alias("page"),
                         F.coalesce("paragraph", zero).alias("paragraph"), F.coalesce("deep", blank).alias("deep"),
                         F.coalesce("summary", blank).alias("summary"))


def theme_map_points(canonical: DataFrame) -> DataFrame:
    return canonical.select(F.col("canonical_id").alias("id"), "job_id", theme_text(F.col("name"), F.col("description")).alias("text"),
                            "name", F.coalesce("description", F.lit("")).alias("description"), "paper_ids", "aliases", "source_theme_ids")


def theme_review_points(reviews: DataFrame) -> DataFrame:
    """Reviews with an id and a text; others are not indexed."""
    filled = reviews.filter((F.coalesce("theme_id", F.lit("")) != "") & (F.coalesce("review", F.lit("")) != ""))
    return filled.select(point_id(F.col("theme_id")).alias("id"), "job_id", F.col("review").alias("text"), "theme_id",
                         F.coalesce("label", F.lit("")).alias("label"), "consensus", "disagreements", "gaps")


def section_points(reviews: DataFrame, sections: DataFrame) -> DataFrame:
    heads = reviews.select("job_id", "title", "abstract")
    return sections.join(heads, "job_id", "left").select(
        point_id(F.col("theme_id")).alias("id"), "job_id", F.coalesce("content", F.lit("")).alias("text"), "theme_id", "label",
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), "citation_refs")
