"""Batch queries over the job event log.

``events(event_id, event_type, ts, job_id, seq, ..)``; ``seq`` is the log order. Running values go
through block-wise helpers, so one very busy job stays spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.ordered import join_null_safe, prefix_sum, prefix_sums, running_max

# Event kinds by role, stages of a job, internal tools, page size of a replay.
STARTS = ["job_started", "stage_started", "agent_started"]
ENDS = ["job_completed", "job_failed", "stage_completed", "agent_completed", "agent_error"]
JOB_ENDS = ["job_completed", "job_failed", "review_quarantined"]
TOTAL_STAGES = 4
INTERNAL_TOOLS = ["delegate_task_to_member", "transfer_task_to_agent"]
REPLAY_LIMIT, MAX_REPLAY = 1000, 10_000


def events_after(events: DataFrame, markers: DataFrame, limit: int = REPLAY_LIMIT) -> DataFrame:
    """First ``limit`` events of each job that follow its marker event in log order.

    ``markers(job_id, marker)``; an unknown marker gives nothing, a null marker the log from its start.
    The limit is the page size of a replay.
    """
    size = max(1, min(MAX_REPLAY, limit))
    ids = events.select("job_id", F.col("event_id").alias("marker"), "seq")
    named = markers.filter("marker is not null").join(ids, ["job_id", "marker"]).groupBy("job_id").agg(F.min("seq").alias("after"))
    start = markers.filter("marker is null").select("job_id", F.lit(None).cast("long").alias("after"))
    wanted = events.join(named.unionByName(start), "job_id").filter(
        F.col("after").isNull() | (F.col("seq") > F.col("after"))).drop("after")
    # positions by blocks of the log order: a job's tail is never sorted as a whole, whatever the page size
    return prefix_sum(wanted, ["job_id"], "seq", F.lit(1), "rank", inclusive=True).withColumn("rank", F.col("rank").cast("int")).filter(F.col("rank") <= size)


def agent_spans(events: DataFrame, keys: list[str], start: list[str], end: list[str]) -> DataFrame:
    """End events with the time of the latest start before them and the elapsed milliseconds."""
    relevant = events.filter(F.col("event_type").isin(start + end))
    begun = F.when(F.col("event_type").isin(start), F.struct(F.col("seq").alias("s"), F.col("ts").alias("t")))
    seen = running_max(relevant, keys, "seq", begun, "started")
    done = seen.filter(F.col("event_type").isin(end))
    micros = F.unix_micros("ts") - F.unix_micros("started.t")
    return done.withColumn("elapsed_ms", F.floor(micros / 1000)).withColumn("started_seq", F.col("started.s")).drop("started")


def relative_time(events: DataFrame) -> DataFrame:
    """Seconds since the job's first event, as number and as shown ('3.2s', '42s', '3m 5s')."""
    first = events.groupBy("job_id").agg(F.min("ts").alias("__first"))
    joined = events.join(first, "job_id")
    seconds = (F.unix_micros("ts") - F.unix_micros("__first")) / F.lit(1e6)
    timed = joined.withColumn("elapsed", seconds).drop("__first")
    e = F.col("elapsed")
    minutes = F.concat(F.floor(e / 60).cast("string"), F.lit("m "), F.floor(e % 60 + 0.5).cast("string"), F.lit("s"))
    shown = F.when(e < 0.1, "0.0s").when(e < 10, F.format_string("%.1fs", e)).when(
        e < 60, F.concat(F.floor(e + 0.5).cast("string"), F.lit("s"))).otherwise(minutes)
    return timed.withColumn("shown", shown)


def open_spans(events: DataFrame) -> DataFrame:
    """Start events with no later end event of the same job and stage ("no stage" counts as a stage)."""
    last = events.filter(F.col("event_type").isin(ENDS)).groupBy("job_id", "stage").agg(F.max("seq").alias("last_end"))
    starts = events.filter(F.col("event_type").isin(STARTS))
    return join_null_safe(starts, last, ["job_id", "stage"], "left").filter(
        F.col("seq") > F.coalesce("last_end", F.lit(-1))).drop("last_end")


def stage_counts(events: DataFrame) -> DataFrame:
    """Distinct items done per job and stage."""
    return events.filter(F.col("event_type") == "paper_processed").groupBy("job_id", "stage").agg(
        F.count_distinct("item_id").alias("done"))


def last_item_per_stage(events: DataFrame) -> DataFrame:
    """Title of the latest processed item per job and stage; events without stage or title are skipped."""
    usable = (F.col("event_type") == "paper_processed") & (F.coalesce("stage", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    return events.filter(usable).groupBy("job_id", "stage").agg(F.max_by("title", "seq").alias("title"))


def event_titles(events: DataFrame, papers: DataFrame) -> DataFrame:
    """Events with the title (else filename) of the paper they are about, by item id else paper id."""
    named = papers.select(F.col("paper_id").alias("about"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("filename")).alias("title"))
    about = F.coalesce(F.col("item_id"), F.col("paper_id")) if "paper_id" in events.columns else F.col("item_id")
    return events.withColumn("about", about).join(named, "about", "left").drop("about")


def progress(events: DataFrame) -> DataFrame:
    """Tracker state after each stage or item event: completed stages, items done, stage total, overall share.

    The item counter restarts with every stage start and end; ``total`` comes with the start event.
    """
    kinds = ["stage_started", "paper_processed", "stage_completed"]
    tracked = events.filter(F.col("event_type").isin(kinds))
    ended = (F.col("event_type") == "stage_completed").cast("int")
    borders = (F.col("event_type") != "paper_processed").cast("int")
    counted = prefix_sums(tracked, ["job_id"], "seq", {"completed_stages": ended, "epoch": borders, "done": 1 - borders}, inclusive=True)
    # an epoch begins with the stage event that it is counted by; items before that event belong to earlier ones
    opened = counted.filter(F.col("event_type") != "paper_processed").select(
        "job_id", "epoch", F.col("done").alias("__before"), F.when(F.col("event_type") == "stage_started", F.col("total")).alias("stage_total"))
    joined = counted.join(opened, ["job_id", "epoch"], "left").withColumns({
        "done": F.col("done") - F.coalesce("__before", F.lit(0)), "stage_total": F.coalesce("stage_total", F.lit(0))})
    return joined.withColumn("progress", overall_progress(F.col("completed_stages"), F.col("done"), F.col("stage_total"))).drop("epoch", "__before")


def overall_progress(completed: Column, done: Column, total: Column) -> Column:
    """(completed stages + share of the current stage) / number of stages."""
    return (completed + F.when(total > 0, done / F.nullif(total, F.lit(0))).otherwise(0.0)) / TOTAL_STAGES


def until_terminal(events: DataFrame, terminal: list[str] | None = None) -> DataFrame:
    """Events up to and including the first terminal event of their job."""
    ends = events.filter(F.col("event_type").isin(terminal or JOB_ENDS)).groupBy("job_id").agg(F.min("seq").alias("__end"))
    return events.join(ends, "job_id", "left").filter(F.col("__end").isNull() | (F.col("seq") <= F.col("__end"))).drop("__end")


def sessions(accesses: DataFrame, key: str, ts: str = "ts", minutes: int = 60) -> DataFrame:
    """Sessions per key: a pause of more than ``minutes`` starts a new one, exactly that long does not.

    Accesses are first counted into time cells of one pause length. Accesses of one cell are always
    of one session, so only the first and last of a cell matter and the window runs over cells.
    """
    gap = minutes * 60 * 1_000_000
    stamped = accesses.select(key, F.unix_micros(ts).alias("__us"))
    cells = stamped.groupBy(key, F.floor(F.col("__us") / gap).alias("__cell")).agg(
        F.min("__us").alias("first"), F.max("__us").alias("last"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy("__cell")
    starts = F.coalesce((F.col("first") - F.lag("last").over(order) > gap).cast("int"), F.lit(1))
    numbered = cells.withColumn("__starts", starts).withColumn(
        "session_no", F.sum("__starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session_no").agg(
        F.min("first").alias("first_us"), F.max("last").alias("last_us"), F.sum("n").alias("accesses"))


def recent_turns(turns: DataFrame, runs: int = 10) -> DataFrame:
    """Turns of the last ``runs`` runs of a conversation; a run is a user turn and what follows it."""
    numbered = prefix_sum(turns, ["conv_id"], "turn", (F.col("role") == "user").cast("int"), "run", inclusive=True)
    last = turns.groupBy("conv_id").agg(F.sum((F.col("role") == "user").cast("int")).alias("__last"))
    return numbered.join(last, "conv_id").filter(F.col("run") > F.col("__last") - runs).drop("__last")


def assemble_turns(chat_events: DataFrame) -> DataFrame:
    """One row per reply: text of its tokens in order, steps, references, how it ended.

    ``chat_events(session_id, seq, kind, content)`` with kind message / token / step / reference /
    done / error. Whatever follows the first done or error of a turn is ignored; an error is added to
    the text received so far; references count only when the turn is done. A turn is one streamed
    reply, which bounds the list built for it.
    """
    numbered = prefix_sum(chat_events, ["session_id"], "seq", (F.col("kind") == "message").cast("int"), "turn_no", inclusive=True)
    replies = numbered.filter((F.col("kind") != "message") & (F.col("turn_no") > 0))
    rows = replies.groupBy("session_id", "turn_no").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "content"))).alias("rows"))
    ends = F.array_position(F.transform("rows", lambda r: r["kind"].isin("done", "error")), True)
    received = rows.withColumn("rows", F.when(ends > 0, F.slice("rows", 1, ends.cast("int"))).otherwise(F.col("rows")))
    received = received.withColumn("final", F.element_at("rows", -1))

    def of(kind: str) -> Column:
        return F.transform(F.filter("rows", lambda r: r["kind"] == kind), lambda r: r["content"])

    text = F.array_join(of("token"), "")
    message = F.concat(F.lit("Error: "), F.col("final.content"))
    failed = F.when(text != "", F.concat(text, F.lit("\n\n"), message)).otherwise(message)
    none = F.array().cast("array<string>")
    return received.select(
        "session_id", "turn_no", F.when(F.col("final.kind") == "error", failed).otherwise(text).alias("content"), of("step").alias("steps"),
        F.when(F.col("final.kind") == "done", of("reference")).otherwise(none).alias("references"),
        F.when(F.col("final.kind").isin("done", "error"), F.col("final.kind")).otherwise("open").alias("ended"))


# job status ------------------------------------------------------------------------------------------

# Texts written when a job is interrupted or fails.
INTERRUPTED = "Pipeline server restarted — job was interrupted. Upload again to retry."
FAILED = "Pipeline failed. Check server logs for details."


def current_status(updates: DataFrame) -> DataFrame:
    """Latest status row per job, with the time the job was first created."""
    fields = [c for c in updates.columns if c not in ("job_id", "created_at")]
    latest = updates.groupBy("job_id").agg(F.max_by(F.struct(*fields), "updated_at").alias("s"), F.min("created_at").alias("created_at"))
    return latest.select("job_id", "s.*", "created_at")


def recover_orphans(updates: DataFrame, now: Column) -> DataFrame:
    """New 'failed' rows for jobs that are still pending or running when the service restarts."""
    stuck = current_status(updates).filter(F.col("status").isin("pending", "running"))
    return stuck.withColumn("status", F.lit("failed")).withColumn("error", F.lit(INTERRUPTED)).withColumn(
        "stage", F.coalesce("stage", F.lit(""))).withColumn("created_at", F.coalesce("created_at", now)).withColumn("updated_at", now)


def fail_jobs(updates: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Failure rows for the given jobs: creation time kept, stage, progress and paper count reset."""
    known = current_status(updates).select("job_id", "created_at")
    return failures.select("job_id").join(known, "job_id", "left").select(
        "job_id", F.lit("failed").alias("status"), F.lit("").alias("stage"), F.lit(0.0).alias("progress"),
        F.lit(0).alias("paper_count"), F.coalesce("created_at", now).alias("created_at"), now.alias("updated_at"), F.lit(FAILED).alias("error"))


# messages of events ------------------------------------------------------------------------------------

# Texts shown per (agent, event), and per event when the agent has none.
AGENT_TEXTS = {
    ("PaperAnalyzer", "agent_started"): "Analyzing '{paper_title}'...",
    ("PaperAnalyzer", "agent_completed"): "Analysis complete",
    ("PaperAnalyzer", "agent_error"): "Analysis failed",
    ("ThemeDedup", "agent_started"): "Deduplicating {theme_count} themes across papers...",
    ("ThemeDedup", "agent_completed"): "Deduplication complete",
    ("ThemeDedup", "agent_error"): "Deduplication failed",
    ("ThemeReviewer", "agent_started"): "Reviewing {theme_count} themes...",
    ("ThemeReviewer", "agent_completed"): "Theme review complete",
    ("ThemeReviewer", "agent_error"): "Theme review failed",
    ("Aggregator", "agent_started"): "Synthesizing literature review from {theme_count} themes...",
    ("Aggregator", "agent_completed"): "Literature review generated",
    ("Aggregator", "agent_error"): "Aggregation failed",
}
EVENT_TEXTS = {
    "agent_started": "Processing...", "agent_completed": "Complete", "agent_error": "Failed",
    "agent_tool_call": "Gathering information...", "agent_tool_result": "Information retrieved",
    "agent_content": "Generating response...",
}
PLACEHOLDERS = ["paper_title", "theme_count"]


def _lookup(texts: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])


def is_internal_tool(tool: Column) -> Column:
    return tool.isin(INTERNAL_TOOLS)


def step_message(agent: Column, event_type: Column, context: Column) -> Column:
    """Progress text of an agent event; ``context`` is a map of values for the placeholders.

    Without context the placeholders are taken out and the text ends in '...'.
    """
    texts = _lookup({f"{a}|{e}": text for (a, e), text in AGENT_TEXTS.items()})
    template = F.element_at(texts, F.concat_ws("|", agent, event_type))
    filled = template
    for name in PLACEHOLDERS:
        token = F.lit("{" + name + "}")
        filled = F.replace(filled, token, F.coalesce(F.element_at(context, name), token))
    bare = template
    for name in PLACEHOLDERS:
        for shown in (f"'{{{name}}}'", f"{{{name}}}"):
            bare = F.replace(F.replace(bare, F.lit(f" {shown} "), F.lit(" ")), F.lit(f" {shown}"), F.lit(" "))
    bare = F.concat(F.rtrim(F.rtrim(bare), F.lit(".")), F.lit("..."))
    chosen = F.when(F.coalesce(F.size(context), F.lit(0)) > 0, filled).otherwise(bare)
    return F.coalesce(chosen, F.element_at(_lookup(EVENT_TEXTS), event_type), F.lit("Processing..."))


def technical_message(agent: Column, event_type: Column, p: Column) -> Column:
    """Developer line from the payload struct ``p``: agent, tool call, result length, time, error."""
    tool = F.nullif(p["tool_name"], F.lit(""))
    args = F.nullif(p["tool_args_preview"], F.lit(""))
    call = F.when(args.isNotNull(), F.concat(tool, F.lit("("), args, F.lit(")"))).otherwise(tool)
    result = F.when(tool.isNotNull(), F.concat(F.lit("→ "), p["result_len"].cast("string"), F.lit(" chars")))
    parts = F.concat_ws(" ", F.concat(F.lit("["), F.nullif(agent, F.lit("")), F.lit("]")), call, result,
                        F.concat(F.lit("("), p["elapsed_ms"].cast("string"), F.lit("ms)")),
                        F.concat(F.lit("ERROR: "), F.nullif(p["error"], F.lit(""))))
    return F.when(parts == "", event_type).otherwise(parts)


# Payload fields of an event.
PAYLOAD = ("stage string, item_id string, paper_id string, paper_count bigint, completed bigint, total bigint, message string, "
           "error string, error_type string, theme_count bigint, claim_count bigint, title string, agent_name string, "
           "technical_message string, model string, tool_name string, tool_args_preview string, result_len bigint, "
           "elapsed_ms bigint, content_len bigint, content_type string, reason string, progress double")


def payload_fields(payload: Column) -> Column:
    """Typed payload fields; missing ones are null."""
    return F.from_json(payload, PAYLOAD)


def human_message(event_type: Column, p: Column) -> Column:
    """Sentence shown for a stage event, from the payload struct ``p``."""
    def shown(name: str) -> Column:
        return F.coalesce(p[name].cast("string"), F.lit("undefined"))

    # The sentences shown.
    texts = {
        "job_started": F.concat(F.lit("Pipeline started ("), shown("paper_count"), F.lit(" papers)")),
        "stage_started": F.concat(shown("stage"), F.lit(" started")),
        "paper_processed": F.concat(F.lit("Paper processed in "), shown("stage"), F.lit(" ("), shown("completed"), F.lit("/"), shown("total"), F.lit(")")),
        "stage_completed": F.concat(shown("stage"), F.lit(" completed")),
        "job_completed": F.lit("Pipeline completed"),
        "job_failed": F.concat(F.lit("Pipeline failed: "), shown("error")),
        "paper_analyzed": F.concat(shown("theme_count"), F.lit(" themes, "), shown("claim_count"), F.lit(" claims extracted")),
        "theme_extracted": F.concat(shown("theme_count"), F.lit(" themes extracted")),
        "claim_extracted": F.concat(shown("claim_count"), F.lit(" claims extracted")),
        "theme_deduplicated": F.concat(F.lit("Deduplicated to "), shown("theme_count"), F.lit(" themes")),
        "review_generated": F.concat(F.lit("Review generated: "), shown("title")),
    }
    message = F.lit(None).cast("string")
    for kind, text in texts.items():
        message = F.when(event_type == kind, text).otherwise(message)
    return F.coalesce(message, event_type)
