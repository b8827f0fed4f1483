"""Queries that write and read back, and streaming queries run over the ``events`` file."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog.layout import listed
from citeloom.catalog.registry import ORACLES, QUERIES, query
from citeloom.catalog.stand_ins import CTES
from citeloom.catalog.verification import reviews
from citeloom.functions.vectors import with_vectors
from citeloom.runtime import fresh_dir, materialise
from citeloom.sources import admission, entities, event_log
from citeloom.streaming import streams

# files ---------------------------------------------------------------------------------------------

CTES["manifest"] = ((), """
select (doc_id // 40)::varchar as job_id, 'up/' || lang || (doc_id % 5) || case when doc_id % 333 = 7 then '.txt' else '.PDF' end as path,
  n_chars * case when doc_id % 400 = 3 then 100000000 else 1 end as length, case when doc_id % 3 = 0 or doc_id // 40 % 8 = 5 then 'other' else '%PDF-' end as magic
from documents""")


def manifest(t):
    doc = F.col("doc_id")
    job = F.floor(doc / 40)
    return t.raw("documents").select(
        job.cast("string").alias("job_id"),
        F.concat(F.lit("up/"), F.col("lang"), (doc % 5).cast("string"), F.when(doc % 333 == 7, ".txt").otherwise(".PDF")).alias("path"),
        (F.col("n_chars") * F.when(doc % 400 == 3, 100000000).otherwise(1)).alias("length"),
        F.when((doc % 3 == 0) | (job % 8 == 5), "other").otherwise("%PDF-").alias("magic"))


@query("admit_files", "manifest", sql="""
with j as (select job_id, case when count(*) > 50 then 'Too many files: ' || count(*) || ' exceeds limit of 50' when bool_or(path not ilike '%.pdf') then 'Only PDF files accepted'
  when max(length) > 52428800 then 'File exceeds 50 MB limit' when not bool_or(magic = '%PDF-') then 'No papers could be ingested' end as problem from manifest group by job_id)
select m.job_id, m.path, m.length, case when problem is not null then 'refused' when magic = '%PDF-' then 'accepted' else 'skipped' end as status,
  coalesce(problem, case when magic <> '%PDF-' then 'invalid PDF magic bytes' end) as reason from manifest m join j using (job_id)""")
def _(t):
    return admission.admit_files(manifest(t)).select("job_id", "path", "length", "status", "reason")


CTES["uploads"] = ((), """
select (doc_id // 40 - case when doc_id // 40 % 8 = 7 then 1 else 0 end)::varchar as job_id,
  case doc_id % 7 when 1 then '_' when 2 then '.' else '' end || doc_id || '.pdf' as name,
  case when doc_id % 5 = 0 then '' when doc_id % 3 = 0 then 'other' else '%PDF-' || doc_id end as body
from (select distinct doc_id from documents where doc_id is not null)""")


def write_uploads(t):
    """A folder of one small file for each document: some empty, some with hidden names, some jobs above the limit."""
    root = fresh_dir(t.spark, "uploads")
    doc = F.col("doc_id")
    job = F.floor(doc / 40)
    files = t.raw("documents").filter(doc.isNotNull()).select("doc_id").distinct().select(
        (job - F.when(job % 8 == 7, 1).otherwise(0)).cast("string").alias("job_id"),
        F.concat(F.when(doc % 7 == 1, "_").when(doc % 7 == 2, ".").otherwise(""), doc.cast("string"), F.lit(".pdf")).alias("name"),
        F.when(doc % 5 == 0, "").when(doc % 3 == 0, "other").otherwise(F.concat(F.lit("%PDF-"), doc.cast("string"))).alias("body"))
    admission.write_files(files, root)
    return root


@query("scan_uploads", "uploads", sql="""
with j as (select job_id, case when count(*) > 50 then 'Too many files: ' || count(*) || ' exceeds limit of 50'
  when not bool_or(starts_with(body, '%PDF-')) then 'No papers could be ingested' end as problem from uploads group by job_id)
select u.job_id, u.name, length(body)::bigint as length, case when problem is not null then 'refused' when starts_with(body, '%PDF-') then 'accepted' else 'skipped' end as status,
  coalesce(problem, case when not starts_with(body, '%PDF-') then 'invalid PDF magic bytes' end) as reason from uploads u join j using (job_id)""")
def _(t):
    files = admission.admit_files(admission.read_manifest(t.spark, write_uploads(t)))
    return files.select("job_id", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "status", "reason")


@query("dedup_filenames", sql="""
select job_id, "at", lang || k || case when rn > 1 then '_' || (rn - 1) else '' end || '.pdf' as stored_name from (
  select (doc_id // 40)::varchar as job_id, doc_id as "at", lang, doc_id % 5 as k, row_number() over (partition by doc_id // 40, lang, doc_id % 5 order by doc_id) as rn from documents)""")
def _(t):
    files = t.raw("documents").select(F.floor(F.col("doc_id") / 40).cast("string").alias("job_id"), F.col("doc_id").alias("at"),
                                      F.concat(F.lit("some/dir/"), "lang", (F.col("doc_id") % 5).cast("string"), F.lit(".pdf")).alias("filename"))
    return admission.dedup_filenames(files).select("job_id", "at", "stored_name")


# tables --------------------------------------------------------------------------------------------

def log_rows(log):
    return log.withColumn("total", F.when(F.col("event_type") == "stage_started", 1 + F.col("seq") % 9))


@query("event_log_round_trip", "log", sql="""
select event_id, event_type, epoch_us(ts) as us, job_id, seq, stage, item_id, payload from log""")
def _(t):
    path = fresh_dir(t.spark, "event-log")
    event_log.write_events(log_rows(t.events), path)
    return event_log.read_events(t.spark, path).select("event_id", "event_type", F.unix_micros("ts").alias("us"), F.col("job_id").cast("string").alias("job_id"), "seq", "stage", "item_id", "payload")


@query("replay_pages", "log", sql="""
select event_id, seq, cast((row_number() over (order by seq) - 1) // 10 as integer) as page from log where job_id = '7' qualify row_number() over (order by seq) <= 30""")
def _(t):
    """A replay of one job by three pages, each from where the last one ended; the log was written in two interleaved batches."""
    path, pages, after = fresh_dir(t.spark, "replay"), None, None
    for half in (0, 1):
        event_log.write_replay(log_rows(t.events).filter(F.col("seq") % 2 == half), path)
    for number in range(3):
        page = event_log.replay_page(t.spark, path, "7", after, 10).select("event_id", "seq", F.lit(number).alias("page"))
        pages = page if pages is None else pages.unionByName(page)
        after = page.agg(F.max("seq")).first()[0] or after
    return pages


@query("entity_round_trip", "papers", sql="""
select job_id, paper_id::varchar as paper_id, case when job_id = 'src3' then 'new ' || filename else filename end as filename, page_count from papers""")
def _(t):
    """Papers are written per job; one job is then replaced."""
    root = fresh_dir(t.spark, "entities")
    papers = t.papers.select(F.col("paper_id").cast("string").alias("paper_id"), "filename", "title", "authors", "page_count",
                             F.lit(None).cast("timestamp").alias("ingested_at"), "job_id")
    entities.write_entity(papers, root, "papers")
    entities.write_entity(papers.filter("job_id = 'src3'").withColumn("filename", F.concat(F.lit("new "), "filename")), root, "papers")
    return entities.read_entity(t.spark, root, "papers").select("job_id", "paper_id", "filename", "page_count")


@query("upsert_collection", "themes", sql="""
select theme_id as id, case when pos % 3 = 0 then 'new ' || name else name end || ': ' || description as text from themes""")
def _(t):
    root = fresh_dir(t.spark, "collections")
    entities.ensure_collections(t.spark, root)
    rows = t.themes.withColumn("job_id", F.lit("j"))
    points = with_vectors(entities.theme_points(rows), "text", length=8)
    entities.upsert(t.spark, root, "paper_themes", points)
    again = rows.filter("pos % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name"))
    entities.upsert(t.spark, root, "paper_themes", with_vectors(entities.theme_points(again), "text", length=8))
    return entities.read_collection(t.spark, root, "paper_themes").select("id", "text")


@query("last_write_wins", "claims", sql="""
select theme_id as id, arg_max(text, pos) as text, arg_max(page, pos) as page from claims group by theme_id""")
def _(t):
    return entities.last_per_key(t.claims.select(F.col("theme_id").alias("id"), "text", "page", "pos"), "pos")


@query("claim_points", "claims", sql="""
select claim_id as id, job_id, text, paper_id, theme_id, '' as theme_name, page, paragraph, '' as deep, '' as summary from claims""")
def _(t):
    gaps = F.lit(None).cast("string")
    return entities.claim_points(t.claims.withColumn("theme_name", gaps).withColumn("deep", gaps).withColumn("summary", gaps))


@query("theme_map_points", "members", sql="""
select distinct md5(bucket || '|' || group_no) as id, 'j' as job_id, canonical_name || ': ' || description as text, canonical_name as name from members join groups using (bucket, group_no, canonical_name)""")
def _(t):
    from citeloom.catalog.themes import buckets
    from citeloom.operators.themes import build_theme_map

    built = build_theme_map(*buckets(t)).withColumn("job_id", F.lit("j"))
    return entities.theme_map_points(built).select("id", "job_id", "text", "name")


@query("theme_review_points", "reviews", sql="""
select concat_ws('-', substr(md5(theme_id), 1, 8), substr(md5(theme_id), 9, 4), substr(md5(theme_id), 13, 4), substr(md5(theme_id), 17, 4), substr(md5(theme_id), 21, 12)) as id,
  theme_id, review as text from reviews where size % 4 <> 0""")
def _(t):
    rows = reviews(t).withColumn("job_id", F.lit("j")).withColumn("label", F.lit("L")).withColumn(
        "review", F.when(F.col("size") % 4 != 0, F.col("review")).otherwise(""))
    return entities.theme_review_points(rows).select("id", "theme_id", "text")


@query("section_points", "sections", sql="""
select concat_ws('-', substr(md5(theme_id), 1, 8), substr(md5(theme_id), 9, 4), substr(md5(theme_id), 13, 4), substr(md5(theme_id), 17, 4), substr(md5(theme_id), 21, 12)) as id,
  job_id, content as text, case when job_id = 'A' then 'Review A' else '' end as title from sections""")
def _(t):
    from citeloom.catalog.citations import sections
    from citeloom.catalog.reading import heads

    own = heads(t).withColumn("job_id", F.when(F.col("job_id") == "A", F.col("job_id")).otherwise(F.concat(F.lit("other "), "job_id")))
    return entities.section_points(own, sections(t)).select("id", "job_id", "text", "title")


def indexed(t, name, points, order=None):
    """Points embedded, written to their collection twice (the second time nothing may change), and read back."""
    root = fresh_dir(t.spark, "collections")
    entities.ensure_collections(t.spark, root)
    with_vec = materialise(with_vectors(points, "text", length=8))  # embedded once for both
    entities.upsert(t.spark, root, name, with_vec, order=order)
    entities.upsert(t.spark, root, name, with_vec.filter("id < '8'"), order=order)
    found = entities.read_collection(t.spark, root, name)
    return found.select("id", "text", F.size("vec").alias("length"))


def of_points(name):
    return f"select id, text, 8 as length from ({ORACLES[name]})"


@query("index_claims", sql=of_points("claim_points"))
def _(t):
    return indexed(t, "paper_claims", QUERIES["claim_points"](t.spark, t.folder))


@query("index_theme_map", sql=of_points("theme_map_points"))
def _(t):
    return indexed(t, "theme_map", QUERIES["theme_map_points"](t.spark, t.folder))


@query("index_theme_reviews", sql=of_points("theme_review_points"))
def _(t):
    return indexed(t, "theme_reviews", QUERIES["theme_review_points"](t.spark, t.folder))


@query("index_sections", sql=f"select id, arg_max(text, job_id) as text, 8 as length from ({ORACLES['section_points']}) group by id")
def _(t):
    """A theme's section has one point, whichever job wrote it last."""
    return indexed(t, "literature_review", QUERIES["section_points"](t.spark, t.folder), order="job_id")


@query("flag_misses", "judge", sql="""
select job_id, round(faithfulness, 9) as score from judge where not missing and faithfulness < 0.7""")
def _(t):
    from citeloom.catalog.verification import gate_inputs
    from citeloom.operators.evals import production_misses

    path = fresh_dir(t.spark, "misses")
    event_log.append_misses(production_misses(gate_inputs(t)[3]), path)
    return t.spark.read.schema("job_id bigint, metric string, score double").json(path).select("job_id", F.round("score", 9).alias("score"))


# streams -------------------------------------------------------------------------------------------

def event_stream(t):
    """The events file as a stream with the columns of the event log."""
    schema = t.raw("events").schema
    raw = (t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
           .option("maxBytesPerTrigger", streams.BATCH_BYTES).parquet(t.folder))
    return log_rows(t.log_of(raw))


def arrivals(t, start, parts, run):
    """Events that arrive in ``parts`` batches: ``part`` says in which. ``run(folder)`` processes what has come so far.

    Every batch is written to the folder and processed before the next one comes.
    """
    folder = fresh_dir(t.spark, "arrivals")
    for k in range(parts):
        start(t.raw("events")).filter(F.col("part") == k).drop("part").write.mode("append").parquet(folder)
        run(folder)


def shuffled_parts(t):
    """Deals events into four batches by time, each out of order by up to an hour."""
    first, last = t.raw("events").agg(F.unix_seconds(F.min(F.col("ts").cast("timestamp"))), F.unix_seconds(F.max(F.col("ts").cast("timestamp")))).first()

    def part(events):
        shifted = F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 3600 - first
        return events.withColumn("part", F.least(F.lit(3), F.floor(shifted * 4 / max(1, last - first)).cast("int")))

    return part


def arriving(t, folder):
    return log_rows(t.log_of(t.spark.readStream.schema(t.raw("events").schema).parquet(folder)))


@query("stream_drop_replayed", "log", sql="select event_id, job_id, seq from log")
def _(t):
    """Every event is offered twice, as a replay does."""
    twice = event_stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return streams.run_to_table(streams.drop_replayed(twice, "40 days"), "replay").select("event_id", "job_id", "seq")


@query("stream_stage_items", "log", sql="""
select job_id, stage, count(distinct item_id) as done from log where event_type = 'paper_processed' group by job_id, stage""")
def _(t):
    counts = streams.run_to_table(streams.stage_items(event_stream(t), "40 days"), "stage-items", "update")
    return counts.groupBy("job_id", "stage").agg(F.max_by("done", "batch").alias("done"))


SESSIONS_SQL = """
with gaps as (select job_id, epoch_us(ts) as us, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by job_id order by ts) <= 3600000000 then 0 else 1 end as starts from log),
numbered as (select *, sum(starts) over (partition by job_id order by us) as session_no from gaps)
select job_id, count(*) as accesses, min(us) as first_us, max(us) as last_us from numbered group by job_id, session_no
having max(us) + 3600000000 <= (select epoch_us(max(ts)) // 1000 * 1000 - 7200000000 from log)"""


def shown_sessions(closed):
    return closed.select("job_id", "accesses", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("stream_sessions", "log", sql=SESSIONS_SQL)
def _(t):
    return shown_sessions(streams.run_to_table(streams.live_sessions(event_stream(t), "2 hours"), "sessions"))


@query("stream_sessions_in_batches", "log", sql=SESSIONS_SQL)
def _(t):
    """The same sessions, although the events come in four batches, each out of order by up to an hour."""
    target, checkpoint = fresh_dir(t.spark, "sessions"), fresh_dir(t.spark, "checkpoint")

    def run(folder):
        closed = streams.live_sessions(arriving(t, folder), "2 hours")
        closed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target).awaitTermination()

    arrivals(t, shuffled_parts(t), 4, run)
    return shown_sessions(t.spark.read.schema("job_id string, accesses bigint, first timestamp, last timestamp").parquet(target))


@query("stream_late_rows", "log", sql="""
with parts as (select event_id, job_id, ts, cast(event_id as bigint) % 3 as part from log),
marks as (select part, max(ts) as newest from parts group by part)
select event_id, job_id, case when part > 0 and epoch_us(ts) < (select max(epoch_us(newest)) from marks m where m.part < p.part) - 86400000000 then 'late' else 'on time' end as outcome
from parts p""")
def _(t):
    """Events that come in three batches over the same days: rows over a day behind go to the side table, none is lost."""
    paths = {name: fresh_dir(t.spark, name) for name in ("main", "side", "marks", "checkpoint")}

    def run(folder):
        streams.late_to_side_table(arriving(t, folder), paths["main"], paths["side"], paths["marks"], paths["checkpoint"], 86_400_000_000,
                                   availableNow=True).awaitTermination()

    arrivals(t, lambda events: events.withColumn("part", F.col("event_id") % 3), 3, run)
    kept = [t.spark.read.schema("event_id string, job_id string").parquet(paths[name]).withColumn("outcome", F.lit(outcome))
            for name, outcome in (("main", "on time"), ("side", "late"))]
    return kept[0].unionByName(kept[1]).select("event_id", "job_id", "outcome")


def scores_sql(source, delay):
    """Reviews with their scores of the day after, from the events of ``source``; the watermark stands ``delay`` behind."""
    return f"""
with r as (select event_id as review_id, job_id, ts from {source} where event_type = 'stage_completed'),
s as (select job_id, ts, seq from {source} where event_type = 'paper_processed'),
m as (select r.review_id, r.job_id, s.seq from r join s on s.job_id = r.job_id and s.ts >= r.ts and s.ts <= r.ts + interval 24 hour),
mark as (select least((select max(ts) from r), (select max(ts) from s)) - interval {delay} as w)
select review_id, job_id, cast(seq as double) as score, 'scored' as outcome from m
union all select review_id, job_id, null, 'quarantine' from r where review_id not in (select review_id from m) and ts + interval 24 hour < (select date_trunc('milliseconds', w) from mark)"""


def scored(events, again, delay):
    """Reviews joined with their late scores; both are events of one log."""
    made = events.filter("event_type = 'stage_completed'").select(F.col("event_id").alias("review_id"), "job_id", F.col("ts").alias("reviewed_at"))
    given = again.filter("event_type = 'paper_processed'").select("job_id", F.col("ts").alias("scored_at"), F.col("seq").cast("double").alias("score"))
    return streams.late_scores(made, given, delay, "24 hours")


@query("stream_late_scores", "log", sql=scores_sql("log", "2 hours"))
def _(t):
    return streams.run_to_table(scored(event_stream(t), event_stream(t), "2 hours"), "late-scores")


@query("stream_late_scores_in_batches", "log", sql=scores_sql("log", "2 hours"))
def _(t):
    """The same rows, although reviews and scores come in four batches, each out of order by up to an hour."""
    target, checkpoint = fresh_dir(t.spark, "late-scores"), fresh_dir(t.spark, "checkpoint")

    def run(folder):
        found = scored(arriving(t, folder), arriving(t, folder), "2 hours")
        found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target).awaitTermination()

    arrivals(t, shuffled_parts(t), 4, run)
    return t.spark.read.schema("review_id string, job_id string, score double, outcome string").parquet(target)


CTES["log_by_parts"] = (("log",), """
select p.*, part > 0 and epoch_us(ts) < (select max(epoch_us(newest)) from (select part, max(ts) as newest from (select ts, cast(event_id as bigint) % 3 as part from log) group by part) m
  where m.part < p.part) - 86400000000 as late
from (select *, cast(event_id as bigint) % 3 as part from log) p""")
CTES["log_on_time"] = (("log_by_parts",), "select * from log_by_parts where late is not true")


@query("stream_late_scores_side_table", "log_by_parts", "log_on_time", sql=f"""
select * from ({scores_sql("log_on_time", "1 day")})
union all select event_id, job_id, null, 'late' from log_by_parts where late and event_type in ('stage_completed', 'paper_processed')""")
def _(t):
    """Reviews and scores in three batches over the same days: what is over a day behind is in a table of its own, the rest is joined."""
    paths = {name: fresh_dir(t.spark, name) for name in ("main", "side", "marks", "checkpoint")}
    columns = None

    def run(folder):
        nonlocal columns
        stream = arriving(t, folder)
        columns = stream.schema
        streams.late_to_side_table(stream, paths["main"], paths["side"], paths["marks"], paths["checkpoint"], 86_400_000_000, availableNow=True).awaitTermination()

    arrivals(t, lambda events: events.withColumn("part", F.col("event_id") % 3), 3, run)

    def passed():
        return t.spark.readStream.schema(columns).option("recursiveFileLookup", "true").parquet(paths["main"])

    late = t.spark.read.schema(columns).parquet(paths["side"]).filter(F.col("event_type").isin("stage_completed", "paper_processed"))
    found = streams.run_to_table(scored(passed(), passed(), "1 day"), "late-scores")
    return found.unionByName(late.select(F.col("event_id").alias("review_id"), "job_id", F.lit(None).cast("double").alias("score"), F.lit("late").alias("outcome")))


@query("stream_job_states", "log", sql="""
with bounded as (select *, min(case when event_type = 'agent_error' and seq % 10 = 3 then seq end) over (partition by job_id) as stop from log),
kept as (select * from bounded where seq <= coalesce(stop, seq)),
st as (select job_id, coalesce(stage, '') as stage, arg_max(case event_type when 'stage_started' then 'running' else 'completed' end, seq) filter (where event_type in ('stage_started', 'stage_completed')) as state,
  count(distinct case when event_type = 'paper_processed' then item_id end) as done
  from kept where event_type in ('stage_started', 'stage_completed', 'paper_processed') group by 1, 2),
per as (select job_id, string_agg(stage || ':' || coalesce(state, 'pending') || ':' || done, '|' order by stage) as stages, least(1.0::double, count(*) filter (where state = 'completed') / 4.0::double) as progress from st group by job_id)
select k.job_id, case when max(k.stop) is not null then 'failed' when bool_or(k.event_type in ('stage_started', 'stage_completed', 'paper_processed')) then 'running' else 'pending' end as status,
  max(k.seq) as last_seq, coalesce(max(p.stages), '') as stages, coalesce(max(p.progress), 0.0) as progress from kept k left join per p using (job_id) group by k.job_id""")
def _(t):
    kind = F.when((F.col("event_type") == "agent_error") & (F.col("seq") % 10 == 3), "job_failed").otherwise(F.col("event_type"))
    changes = streams.run_to_table(streams.job_states(event_stream(t).withColumn("event_type", kind)), "job-states")
    latest = changes.groupBy("job_id").agg(F.max_by(F.struct("status", "stages", "progress"), "last_seq").alias("s"), F.max("last_seq").alias("last_seq"))
    return latest.select("job_id", "s.status", "last_seq", "s.stages", "s.progress")


@query("stream_fan_out", "log", sql="""
select 'all' as listener, event_type, count(*) as n from log group by 2 union all select 'errors', event_type, count(*) from log where event_type = 'agent_error' group by 2""")
def _(t):
    folder = fresh_dir(t.spark, "fan-out")

    def to(name, condition):
        def write(batch, batch_id):
            batch.filter(condition).select("event_id", "event_type").write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        return write

    listeners = {"all": to("all", F.lit(True)), "errors": to("errors", F.col("event_type") == "agent_error")}
    for running in streams.fan_out(event_stream(t), listeners, f"{folder}/checkpoints", availableNow=True).values():
        running.awaitTermination()
    seen = [t.spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("listener"), "event_type") for name in listeners]
    return seen[0].unionByName(seen[1]).groupBy("listener", "event_type").agg(F.count(F.lit(1)).alias("n"))
