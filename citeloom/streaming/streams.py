"""Live event feed: replay, de-duplication, progress, job state, sessions and late scores.

Sources are directories of files; a restarted query continues from its checkpoint, which is the
replay position. State is bounded by watermarks or, per job, by its terminal event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from citeloom.operators.events import JOB_ENDS, TOTAL_STAGES
from citeloom.runtime import configure, fresh_dir
from citeloom.sources.event_log import EVENT_SCHEMA, TIMESTAMP_FORMAT

# Log volume one micro-batch takes in; it bounds what one job can hold in a batch.
BATCH_BYTES = 256 * 1024 * 1024


def live_events(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The NDJSON event log as a stream; lines that do not parse are left out."""
    raw = (spark.readStream.schema(EVENT_SCHEMA).option("timestampFormat", TIMESTAMP_FORMAT)
           .option("maxBytesPerTrigger", batch_bytes).json(path))
    return raw.filter(F.col("event_id").isNotNull() & F.col("ts").isNotNull())


def fan_out(stream: DataFrame, listeners: dict[str, Callable[[DataFrame, int], None]], checkpoint_root: str,
            **trigger) -> dict[str, StreamingQuery]:
    """Feed several listeners from one stream; each is a query of its own, so one failing stops no other."""
    return {
        name: stream.writeStream.queryName(name).foreachBatch(listener)
        .option("checkpointLocation", f"{checkpoint_root}/{name}").trigger(**trigger).start()
        for name, listener in listeners.items()
    }


def drop_replayed(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, by id, however often a replay repeats it within the watermark delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def stage_items(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running number of distinct items done per job and stage (update or complete mode)."""
    done = stream.filter(F.col("event_type") == "paper_processed").withWatermark("ts", delay)
    once = done.dropDuplicatesWithinWatermark(["job_id", "stage", "item_id"])
    return once.groupBy("job_id", "stage").agg(F.count(F.lit(1)).alias("done"))


def live_sessions(stream: DataFrame, delay: str, key: str = "job_id", minutes: int = 60) -> DataFrame:
    """Closed sessions per key: accesses no more than ``minutes`` apart (append mode).

    ``delay`` must cover how far rows arrive out of order; then the sessions do not depend on the batches. Rows
    that come later still belong in the side table of ``late_to_side_table``.
    """
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", f"{minutes} minutes"), key).agg(
        F.count(F.lit(1)).alias("accesses"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("session_window")


def late_scores(reviews: DataFrame, scores: DataFrame, delay: str, wait: str = "1 hour") -> DataFrame:
    """Reviews joined to the scores that arrive within ``wait``; those left without one are quarantined.

    ``reviews(review_id, job_id, reviewed_at)``, ``scores(job_id, scored_at, score)``. An unmatched
    review comes out once the watermark has passed its waiting time. ``delay`` must cover how far rows arrive
    out of order; then the result does not depend on the batches. Where it may not, put ``late_to_side_table`` with the same delay
    before: what it lets pass is never behind this join's watermark, and what it does not is kept in a table.
    """
    left = reviews.withWatermark("reviewed_at", delay)
    right = scores.withColumnRenamed("job_id", "score_job").withWatermark("scored_at", delay)
    in_time = F.expr(f"job_id = score_job and scored_at >= reviewed_at and scored_at <= reviewed_at + interval {wait}")
    joined = left.join(right, in_time, "leftOuter")
    return joined.select("review_id", "job_id", "score", F.when(F.col("score").isNull(), "quarantine").otherwise("scored").alias("outcome"))


# How long, by event time, a finished job is remembered, so that what comes after its end is ignored.
FINISHED_FOR_MS = 7 * 24 * 3600 * 1000


class JobState(StatefulProcessor):
    """State of one job: its status, each stage's status and items done, the open stage's total.

    Emits the state after every batch that touched the job while it ran. With the terminal event all of a job's state goes, but for a mark
    that it is over; a timer takes that away once the watermark is ``finished_for_ms`` past the end, so state does not grow with finished jobs. The rows of a job in one batch
    are put in log order and reduced by stage; the size of a batch (BATCH_BYTES) bounds them.
    """

    def __init__(self, terminal: list[str] | None = None, finished_for_ms: int = FINISHED_FOR_MS) -> None:
        self._terminal = {"job_completed": "completed", "job_failed": "failed", "review_quarantined": "quarantined"}
        self._ends = set(terminal or JOB_ENDS)
        self._finished_for_ms = finished_for_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._status = handle.getValueState("job", "status string")
        self._stages = handle.getMapState("stages", "stage string", "status string, total long, done long")
        self._items = handle.getMapState("items", "stage string, item string", "seen boolean")
        self._over = handle.getValueState("over", "over boolean")
        self._handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if self._over.exists():
            return
        frame = pd.concat(frames).sort_values("seq", kind="stable")
        ends = frame["event_type"].isin(self._ends).to_numpy()
        over = bool(ends.any())
        if over:
            frame = frame.iloc[:ends.argmax() + 1]
        status = self._status.get()[0] if self._status.exists() else "pending"
        stages = {k[0]: tuple(v) for k, v in self._stages.iterator()}
        changed = self._reduce(frame, stages)
        if over:
            status = self._terminal.get(frame["event_type"].iloc[-1], "completed")
        elif changed or (frame["event_type"] == "job_started").any():
            status = "running"
        shown = sorted((stages | changed).items())
        finished = sum(1 for _, s in shown if s[0] == "completed")
        yield pd.DataFrame({
            "job_id": [key[0]], "status": [status], "last_seq": [int(frame["seq"].iloc[-1])],
            "stages": ["|".join(f"{name}:{state}:{done}" for name, (state, _total, done) in shown)],
            "progress": [min(1.0, finished / TOTAL_STAGES)]})
        if over:
            for state in (self._status, self._stages, self._items):
                state.clear()
            self._over.update((True,))
            self._handle.registerTimer(int(frame["at_ms"].max()) + self._finished_for_ms)
        else:
            for stage, value in changed.items():
                self._stages.updateValue((stage,), value)
            self._status.update((status,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._over.clear()
        return iter(())

    def _reduce(self, frame: pd.DataFrame, stages: dict[str, tuple]) -> dict[str, tuple]:
        """(status, total, items done) of each stage that the rows are about."""
        work = frame[frame["event_type"].isin(["stage_started", "stage_completed", "paper_processed"])]
        work = work.assign(stage=work["stage"].fillna("").astype(str), item_id=work["item_id"].astype(str))
        is_item = work["event_type"] == "paper_processed"
        marks = work[~is_item].drop_duplicates("stage", keep="last").set_index("stage")["event_type"]
        totals = work[work["event_type"] == "stage_started"].drop_duplicates("stage", keep="last").set_index("stage")["total"].fillna(0)
        # the state store is asked once for an item and batch
        fresh = [p for p in work.loc[is_item, ["stage", "item_id"]].drop_duplicates().itertuples(index=False, name=None) if not self._items.containsKey(p)]
        for pair in fresh:
            self._items.updateValue(pair, (True,))
        counts = pd.Series([stage for stage, _ in fresh], dtype=object).value_counts()
        changed = {}
        for stage in work["stage"].unique():
            state, total, done = stages.get(stage, ("pending", 0, 0))
            if stage in marks:
                state = "running" if marks[stage] == "stage_started" else "completed"
            changed[stage] = (state, int(totals.get(stage, total)), done + int(counts.get(stage, 0)))
        return changed

    def close(self) -> None:
        pass


JOB_STATE_SCHEMA = "job_id string, status string, last_seq bigint, stages string, progress double"


def job_states(stream: DataFrame, terminal: list[str] | None = None, delay: str = "1 day", finished_for_ms: int = FINISHED_FOR_MS) -> DataFrame:
    """State changes of every job (append mode); the latest ``last_seq`` per job is its current state.

    ``delay`` must cover how far rows arrive out of order, or ``late_to_side_table`` come before.

    Needs the state store that ``runtime.configure`` sets.
    """
    configure(stream.sparkSession)
    known = stream.withWatermark("ts", delay).select("job_id", "event_type", "seq", "stage", "item_id", "total", "ts", F.unix_millis("ts").alias("at_ms"))
    return known.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobState(terminal, finished_for_ms), outputStructType=JOB_STATE_SCHEMA, outputMode="Append", timeMode="EventTime")


def split_late(batch: DataFrame, high_water_us: int, delay_us: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch against the newest event time seen in earlier batches."""
    behind = F.unix_micros("ts") < F.lit(high_water_us - delay_us)
    return batch.filter(~behind), batch.filter(behind)


def late_to_side_table(stream: DataFrame, main: str, side: str, marks: str, checkpoint: str, delay_us: int,
                       **trigger) -> StreamingQuery:
    """Append on-time rows to ``main`` and late rows to ``side``.

    Every batch leaves its newest event time in ``marks``, one small row, so a restart resumes with
    it. A repeated batch replaces its own partitions and is not written twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("newest bigint, batch int").parquet(marks) if batch_id > 0 else None
        row = known.filter(F.col("batch") < batch_id).agg(F.max("newest")).first() if known is not None else None
        seen = row[0] if row is not None and row[0] is not None else 0
        held = batch.persist()  # three tables are written from it
        fresh, late = split_late(held, seen, delay_us)
        fresh.write.mode("overwrite").parquet(f"{main}/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{side}/batch={batch_id}")
        held.agg(F.max(F.unix_micros("ts")).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_to_table(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Process everything that is available into a table in the shared folder and read it back.

    In update mode each batch is written to its own partition with ``batch``, and readers keep the
    row of the highest batch per key.
    """
    spark = stream.sparkSession
    folder = fresh_dir(spark, purpose)
    target, checkpoint = f"{folder}/table", f"{folder}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(target)
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(target)
