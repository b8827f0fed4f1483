"""The append-only NDJSON event log, and a sorted copy of it from which replays read single pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = ("event_id string, event_type string, ts timestamp, job_id string, seq bigint, stage string, item_id string, "
                "total bigint, payload string")
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_WITH_CORRUPT = EVENT_SCHEMA + ", _corrupt_record string"


def write_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, one folder per job.

    Rebalancing puts the rows of small jobs together and spreads those of a very large one.
    """
    events.hint("rebalance", "job_id").write.mode("append").option("timestampFormat", TIMESTAMP_FORMAT).partitionBy("job_id").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of the log; blank and corrupt lines are skipped."""
    rows = spark.read.schema(_WITH_CORRUPT).option("mode", "PERMISSIVE").option("timestampFormat", TIMESTAMP_FORMAT).json(path)
    return rows.filter(F.col("_corrupt_record").isNull() & F.col("event_id").isNotNull()).drop("_corrupt_record")


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the log that are no event."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", _WITH_CORRUPT, {"mode": "PERMISSIVE", "timestampFormat": TIMESTAMP_FORMAT})
    return lines.filter(parsed["_corrupt_record"].isNotNull()).select("value")


def append_misses(misses: DataFrame, path: str) -> None:
    """Append low-scoring traces to the triage folder as JSON lines."""
    misses.write.mode("append").json(path)


# replay copy -------------------------------------------------------------------------------------------

REPLAY_INDEX = "job_id string, file string, first bigint, last bigint, n bigint"


def write_replay(events: DataFrame, path: str) -> None:
    """Append events to the sorted copy: files hold ranges of (job_id, seq), and an index says which range of each job a file holds."""
    batch = uuid.uuid4().hex
    rows = f"{path}/rows/batch-{batch}"
    events.repartitionByRange("job_id", "seq").sortWithinPartitions("job_id", "seq").write.parquet(rows)
    held = events.sparkSession.read.schema(events.schema).parquet(rows).groupBy("job_id", F.input_file_name().alias("file")).agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))
    held.write.parquet(f"{path}/index/batch-{batch}")


def replay_page(spark: SparkSession, path: str, job_id: str, after: int | None = None, limit: int = 1000) -> DataFrame:
    """The ``limit`` events of a job that follow position ``after`` (None: from the start), in log order. Batches may interleave.

    Only files that can hold the page are read: the index gives a position up to which there surely are ``limit`` events.
    """
    index = spark.read.schema(REPLAY_INDEX).option("recursiveFileLookup", "true").parquet(f"{path}/index").filter(F.col("job_id") == job_id)
    if after is not None:
        index = index.filter(F.col("last") > after)
    whole = index if after is None else index.filter(F.col("first") > after)
    held, end = 0, None
    for row in whole.orderBy("last", "file").limit(limit).collect():  # a file holds an event at least
        held += row["n"]
        if held >= limit:
            end = row["last"]
            break
    needed = index if end is None else index.filter(F.col("first") <= end)
    files = [r["file"] for r in needed.select("file").distinct().collect()]
    rows = spark.read.schema(EVENT_SCHEMA).parquet(*files) if files else spark.createDataFrame([], EVENT_SCHEMA)
    own = rows.filter(F.col("job_id") == job_id)
    return (own if after is None else own.filter(F.col("seq") > after)).orderBy("seq").limit(limit)
