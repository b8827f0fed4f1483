"""Uploaded files: manifest, admission rules, unique file names."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of one upload and how a PDF begins.
MAX_FILES = 50
MAX_BYTES = 50 * 1024 * 1024
MAGIC = "%PDF-"

LISTED = "job_id string, path string, length long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, path, length, magic) of all files below ``path/<job_id>/``, at any depth, empty and hidden ones included.

    One task lists the folders of the jobs, tasks list a folder each, and the files found are dealt anew, to be opened for their first
    bytes: neither many jobs nor a job of very many files falls to one task, and the driver lists and opens nothing. Files that lie
    in ``path`` itself belong to a job named like it; files above the limit are not opened.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.range(1, numPartitions=1).mapInPandas(_top(path), f"{LISTED}, folder boolean")
    files = top.repartition(parts, "path").mapInPandas(_below, LISTED)
    return files.repartition(parts, "path").mapInPandas(_heads, f"{LISTED}, magic string")


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("/", "file:")) else os.path.abspath(path))


def _uri(base: str, inner: str) -> str:
    """The path of a listed file as a URI of the same store as ``base``."""
    scheme, mark, rest = base.partition("://")
    return f"{scheme}://{rest.partition('/')[0]}/{inner.lstrip('/')}" if mark and scheme == "hdfs" else f"{scheme}://{inner}" if mark else inner


def _top(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = _file_system(path)
        name = inner.rstrip("/").split("/")[-1]
        for batch in batches:
            if len(batch):
                found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
                yield pd.DataFrame([(i.base_name if i.type == fs.FileType.Directory else name, _uri(path, i.path), i.size or 0, i.type == fs.FileType.Directory)
                                    for i in found], columns=["job_id", "path", "length", "folder"])

    return run


def _below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files stay, a folder becomes the files in it and below, one folder at a time."""
    columns = ["job_id", "path", "length"]
    for batch in batches:
        yield batch.loc[~batch["folder"].astype(bool), columns]
        for job, path in batch.loc[batch["folder"].astype(bool), columns[:2]].itertuples(index=False):
            (store, inner), waiting = _file_system(path), []
            waiting.append(inner)
            while waiting:
                found = store.get_file_info(fs.FileSelector(waiting.pop(), allow_not_found=True))
                waiting += [i.path for i in found if i.type == fs.FileType.Directory]
                yield pd.DataFrame([(job, _uri(path, i.path), i.size) for i in found if i.type == fs.FileType.File], columns=columns)


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def head(path: str, length: int) -> str | None:
        if not 0 < length <= MAX_BYTES:
            return None
        store, inner = _file_system(path)
        with store.open_input_file(inner) as file:
            return file.read(len(MAGIC)).decode("ISO-8859-1")

    for batch in batches:
        yield batch.assign(magic=[head(p, n) for p, n in zip(batch["path"], batch["length"], strict=True)])


def write_files(files: DataFrame, root: str) -> int:
    """Write ``files(job_id, name, body)`` as ``root/<job_id>/<name>`` in tasks; returns how many. A repeated task writes the same files again."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = _file_system(root)
        for batch in batches:
            for job in batch["job_id"].unique():
                store.create_dir(f"{inner}/{job}", recursive=True)
            for job, name, body in batch[["job_id", "name", "body"]].itertuples(index=False):
                with store.open_output_stream(f"{inner}/{job}/{name}") as file:
                    file.write(body.encode())
            yield pd.DataFrame({"written": [len(batch)]})

    return files.mapInPandas(run, "written long").agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def admit_files(manifest: DataFrame) -> DataFrame:
    """Each file with ``status`` accepted / skipped / refused and the ``reason``.

    Too many files, a wrong suffix or an oversized file refuses the whole job; a wrong beginning only
    skips the file; a job left without files is refused.
    """
    suffix = ~F.endswith(F.lower("path"), F.lit(".pdf"))
    per_job = manifest.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(suffix).alias("bad_suffix"), F.bool_or(F.col("length") > MAX_BYTES).alias("too_big"),
        F.bool_or(F.coalesce(F.col("magic") == MAGIC, F.lit(False))).alias("any_good"))
    problem = F.when(F.col("n") > MAX_FILES, F.concat(F.lit("Too many files: "), F.col("n").cast("string"),
                                                     F.lit(f" exceeds limit of {MAX_FILES}"))).when(
        F.col("bad_suffix"), F.lit("Only PDF files accepted")).when(F.col("too_big"), F.lit("File exceeds 50 MB limit")).when(
        ~F.col("any_good"), F.lit("No papers could be ingested"))
    joined = manifest.join(per_job.select("job_id", problem.alias("problem")), "job_id")
    good = F.coalesce(F.col("magic") == MAGIC, F.lit(False))
    status = F.when(F.col("problem").isNotNull(), "refused").when(good, "accepted").otherwise("skipped")
    reason = F.coalesce("problem", F.when(~good, F.lit("invalid PDF magic bytes")))
    return joined.withColumn("status", status).withColumn("reason", reason).drop("problem")


def dedup_filenames(files: DataFrame) -> DataFrame:
    """A unique stored name per file of a job: base name, then base_1, base_2 .. in upload order.

    Names taken by earlier files, suffixed ones included, are skipped. An upload has at most
    MAX_FILES files, so the names of a job fold inside one row. ``files(job_id, at, filename)``.
    """
    base = F.element_at(F.split("filename", "/"), -1)
    jobs = files.select("job_id", F.struct("at", "filename", base.alias("base")).alias("f")).groupBy("job_id").agg(
        F.array_sort(F.collect_list("f")).alias("files"))
    start = F.struct(F.array().cast("array<string>").alias("names"))

    def name_next(state: Column, f: Column) -> Column:
        # a leading dot is part of the stem, as in '.hidden'
        stem = F.regexp_extract(f["base"], r"^(.+?)(\.[^.]*)?$", 1)
        suffix = F.substr(f["base"], F.length(stem) + 1)
        numbered = F.transform(F.sequence(F.lit(1), F.size(state["names"]) + 1),
                               lambda k: F.concat(stem, F.lit("_"), k.cast("string"), suffix))
        options = F.concat(F.array(f["base"]), numbered)
        free = F.filter(options, lambda o: ~F.array_contains(state["names"], o))
        return F.struct(F.concat(state["names"], F.array(F.element_at(free, 1))).alias("names"))

    names = F.aggregate("files", start, name_next, lambda s: s["names"])
    named = jobs.select("job_id", F.explode(F.arrays_zip("files", names.alias("names"))).alias("z"))
    return named.select("job_id", "z.files.at", "z.files.filename", F.col("z.names").alias("stored_name"))
