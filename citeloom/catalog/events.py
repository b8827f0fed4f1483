"""Event-log, session and chat queries over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog.layout import listed
from citeloom.catalog.registry import query
from citeloom.catalog.stand_ins import CTES
from citeloom.operators import events as ops


@query("events_after", "log", sql="""
with markers as (select job_id, case when job_id::bigint % 5 = 0 then 'none' when job_id::bigint % 5 = 1 then null else min(seq)::varchar end as marker from log group by job_id),
starts as (select m.job_id, case when m.marker is null then -1 else l.seq end as after from markers m left join log l on l.job_id = m.job_id and l.event_id = m.marker
  where m.marker is null or l.seq is not null)
select job_id, event_id, seq, cast(rank as integer) as rank from (
  select l.job_id, l.event_id, l.seq, row_number() over (partition by l.job_id order by l.seq) as rank from log l join starts s on s.job_id = l.job_id and l.seq > s.after) where rank <= 20""")
def _(t):
    first = F.min("seq").cast("string")
    job = F.col("job_id").cast("long")
    markers = t.events.groupBy("job_id").agg(first.alias("first")).select(
        "job_id", F.when(job % 5 == 0, F.lit("none")).when(job % 5 == 1, F.lit(None)).otherwise(F.col("first")).alias("marker"))
    return ops.events_after(t.events, markers, 20).select("job_id", "event_id", "seq", "rank")


@query("agent_spans", "log", sql="""
with seen as (select *, max(case when event_type = 'agent_started' then seq end) over (partition by job_id order by seq) as started_seq
  from log where event_type in ('agent_started', 'agent_error'))
select e.event_id, e.started_seq, cast(floor((epoch_us(e.ts) - epoch_us(s.ts)) / 1000) as bigint) as elapsed_ms
from seen e left join log s on s.seq = e.started_seq where e.event_type = 'agent_error'""")
def _(t):
    return ops.agent_spans(t.events, ["job_id"], ["agent_started"], ["agent_error"]).select("event_id", "started_seq", "elapsed_ms")


@query("relative_time", "log", sql="""
with timed as (select event_id, (epoch_us(ts) - epoch_us(min(ts) over (partition by job_id))) / 1000000.0::double as e from log)
select event_id, round(e, 6) as elapsed, case when e < 0.1 then '0.0s' when e < 10 then printf('%.1fs', e)
  when e < 60 then cast(floor(e + 0.5) as bigint) || 's' else cast(floor(e / 60) as bigint) || 'm ' || cast(floor(e % 60 + 0.5) as bigint) || 's' end as shown from timed""")
def _(t):
    return ops.relative_time(t.events).select("event_id", F.round("elapsed", 6).alias("elapsed"), "shown")


@query("open_spans", "log", sql="""
select event_id, job_id, stage from log s where event_type in ('stage_started', 'agent_started') and not exists (
  select 1 from log e where e.job_id = s.job_id and e.stage is not distinct from s.stage and e.seq > s.seq and e.event_type in ('stage_completed', 'agent_error'))""")
def _(t):
    return ops.open_spans(t.events).select("event_id", "job_id", "stage")


@query("stage_counts", "log", sql="""
select job_id, stage, count(distinct item_id) as done from log where event_type = 'paper_processed' group by job_id, stage""")
def _(t):
    return ops.stage_counts(t.events)


def documents_by_item(t):
    """Papers by item id; every seventh has another key, so that its events find no paper."""
    key = F.when(F.col("paper_id") % 7 == 3, F.concat(F.lit("p"), F.col("paper_id").cast("string"))).otherwise(F.col("paper_id").cast("string"))
    return t.papers.select(key.alias("paper_id"),
                                                  F.when(F.col("paper_id") % 4 != 0, F.col("title")).otherwise("").alias("title"), "filename")


CTES["titled"] = (("log", "papers"), """
select l.*, case when p.paper_id % 4 <> 0 and p.title <> '' then p.title else p.filename end as title
from log l left join papers p on p.paper_id::varchar = l.item_id and p.paper_id % 7 <> 3""")


@query("event_titles", "titled", sql="select event_id, title from titled")
def _(t):
    return ops.event_titles(t.events, documents_by_item(t)).select("event_id", "title")


@query("last_item_per_stage", "titled", sql="""
select job_id, stage, arg_max(title, seq) as title from titled
where event_type = 'paper_processed' and stage <> '' and title <> '' group by job_id, stage""")
def _(t):
    return ops.last_item_per_stage(ops.event_titles(t.events, documents_by_item(t)))


@query("progress", "log", sql="""
with tracked as (select *, count(*) filter (where event_type = 'stage_completed') over w as completed_stages,
   count(*) filter (where event_type <> 'paper_processed') over w as epoch
   from log where event_type in ('stage_started', 'paper_processed', 'stage_completed') window w as (partition by job_id order by seq)),
done as (select *, count(*) filter (where event_type = 'paper_processed') over (partition by job_id, epoch order by seq) as done,
   coalesce(max(case when event_type = 'stage_started' then 1 + seq % 9 end) over (partition by job_id, epoch), 0) as stage_total from tracked)
select event_id, completed_stages, done, stage_total,
   round((completed_stages + case when stage_total > 0 then done / stage_total else 0 end) / 4.0::double, 9) as progress from done""")
def _(t):
    counted = t.events.withColumn("total", F.when(F.col("event_type") == "stage_started", 1 + F.col("seq") % 9))
    return ops.progress(counted).select("event_id", "completed_stages", "done", "stage_total", F.round("progress", 9).alias("progress"))


@query("until_terminal", "log", sql="""
select event_id from log l where seq <= coalesce((select min(seq) from log e where e.job_id = l.job_id and e.event_type = 'agent_error'), seq)""")
def _(t):
    return ops.until_terminal(t.events, ["agent_error"]).select("event_id")


@query("sessions", "log", sql="""
with gaps as (select job_id, epoch_us(ts) as us, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by job_id order by ts) <= 3600000000 then 0 else 1 end as starts from log),
numbered as (select *, sum(starts) over (partition by job_id order by us) as session_no from gaps)
select job_id, cast(session_no as bigint) as session_no, min(us) as first_us, max(us) as last_us, count(*) as accesses from numbered group by job_id, session_no""")
def _(t):
    return ops.sessions(t.events, "job_id")


@query("recent_turns", sql="""
with runs as (select *, count(*) filter (where role = 'user') over (partition by conv_id order by turn) as run from conversations)
select conv_id, turn, run from (select *, max(run) over (partition by conv_id) as hi from runs) where run > hi - 2""")
def _(t):
    return ops.recent_turns(t.turns, 2).select("conv_id", "turn", "run")


CTES["chat_events"] = ((), """
with words as (select conv_id, turn, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as k from conversations where role <> 'user')
select conv_id as session_id, turn * 100000 as seq, 'message' as kind, text as content from conversations where role = 'user'
union all select conv_id, turn * 100000 + 1, 'step', 'step ' || turn from conversations where role <> 'user'
union all select conv_id, turn * 100000 + 1 + k, 'token', w || ' ' from words
union all select conv_id, turn * 100000 + 50000, 'reference', 'ref ' || turn from conversations where role <> 'user'
union all select conv_id, turn * 100000 + 50001, case when turn % 3 = 0 then 'error' when conv_id % 10 = 0 then 'step' else 'done' end, 'bye' from conversations where role <> 'user'
union all select conv_id, turn * 100000 + 50002, 'token', 'late' from conversations where role <> 'user'""")


def chat_events(t):
    turns = t.turns
    base = F.col("turn") * 100000
    user = turns.filter("role = 'user'").select(F.col("conv_id").alias("session_id"), base.alias("seq"), F.lit("message").alias("kind"), F.col("text").alias("content"))
    words = F.transform(F.split("text", " "), lambda w, i: F.struct((i + 2).cast("long").alias("k"), F.lit("token").alias("kind"), F.concat(w, F.lit(" ")).alias("content")))

    def one(k, kind, content):
        return F.array(F.struct(F.lit(k).cast("long").alias("k"), kind.alias("kind"), content.alias("content")))

    last = F.when(F.col("turn") % 3 == 0, F.lit("error")).when(F.col("conv_id") % 10 == 0, F.lit("step")).otherwise(F.lit("done"))
    number = F.col("turn").cast("string")
    reply = F.concat(one(1, F.lit("step"), F.concat(F.lit("step "), number)), words,
                     one(50000, F.lit("reference"), F.concat(F.lit("ref "), number)),
                     one(50001, last, F.lit("bye")), one(50002, F.lit("token"), F.lit("late")))
    rest = turns.filter("role <> 'user'").select(F.col("conv_id").alias("session_id"), "turn", F.explode(reply).alias("e")).select(
        "session_id", (base + F.col("e.k")).alias("seq"), "e.kind", "e.content")
    return user.unionByName(rest)


@query("assemble_turns", "chat_events", sql="""
with numbered as (select *, count(*) filter (where kind = 'message') over (partition by session_id order by seq) as turn_no from chat_events),
bounded as (select *, min(case when kind in ('done', 'error') then seq end) over (partition by session_id, turn_no) as stop from numbered where kind <> 'message' and turn_no > 0),
kept as (select * from bounded where seq <= coalesce(stop, seq)),
joined as (select session_id, turn_no, coalesce(string_agg(content, '' order by seq) filter (where kind = 'token'), '') as text,
  coalesce(string_agg(content, '|' order by seq) filter (where kind = 'step'), '') as steps,
  coalesce(string_agg(content, '|' order by seq) filter (where kind = 'reference'), '') as refs,
  arg_max(kind, seq) as last_kind, arg_max(content, seq) as last_content from kept group by session_id, turn_no)
select session_id, turn_no, md5(case when last_kind <> 'error' then text when text <> '' then text || chr(10) || chr(10) || 'Error: ' || last_content else 'Error: ' || last_content end) as content,
  steps, case when last_kind = 'done' then refs else '' end as "references", case when last_kind in ('done', 'error') then last_kind else 'open' end as ended from joined""")
def _(t):
    turns = ops.assemble_turns(chat_events(t))
    return turns.select("session_id", "turn_no", F.md5("content").alias("content"), listed("steps").alias("steps"),
                        listed("references").alias("references"), "ended")


# job status ------------------------------------------------------------------------------------------

CTES["status_rows"] = (("log",), """
select job_id, case event_type when 'stage_started' then 'running' when 'paper_processed' then 'running' when 'stage_completed' then 'completed'
  when 'agent_started' then 'pending' else 'failed' end as status, stage, seq % 5 / 4.0::double as progress, cast(seq % 7 as bigint) as paper_count,
  epoch_us(ts) as created_at, epoch_us(ts) as updated_at from log""")
CTES["status_now"] = (("status_rows",), """
select job_id, arg_max(status, updated_at) as status, arg_max(coalesce(stage, ''), updated_at) as stage, arg_max(progress, updated_at) as progress,
  arg_max(paper_count, updated_at) as paper_count, max(updated_at) as updated_at, min(created_at) as created_at from status_rows group by job_id""")


def status_rows(t):
    status = F.when(F.col("event_type").isin("stage_started", "paper_processed"), "running").when(
        F.col("event_type") == "stage_completed", "completed").when(F.col("event_type") == "agent_started", "pending").otherwise("failed")
    us = F.unix_micros("ts")
    return t.events.select("job_id", status.alias("status"), "stage", (F.col("seq") % 5 / 4.0).alias("progress"),
                           (F.col("seq") % 7).alias("paper_count"), us.alias("created_at"), us.alias("updated_at"))


@query("current_status", "status_now", sql="select job_id, status, stage, progress, paper_count, updated_at, created_at from status_now")
def _(t):
    return ops.current_status(status_rows(t)).withColumn("stage", F.coalesce("stage", F.lit(""))).select(
        "job_id", "status", "stage", "progress", "paper_count", "updated_at", "created_at")


@query("recover_orphans", "status_now", sql="""
select job_id, 'failed' as status, stage, progress, paper_count, created_at, cast(9000000000000000 as bigint) as updated_at,
  'Pipeline server restarted — job was interrupted. Upload again to retry.' as error from status_now where status in ('pending', 'running')""")
def _(t):
    return ops.recover_orphans(status_rows(t), F.lit(9_000_000_000_000_000))


@query("fail_jobs", "status_now", sql="""
select job_id, 'failed' as status, '' as stage, 0.0::double as progress, 0 as paper_count, created_at, cast(9000000000000000 as bigint) as updated_at,
  'Pipeline failed. Check server logs for details.' as error from status_now where status = 'running'""")
def _(t):
    running = ops.current_status(status_rows(t)).filter("status = 'running'")
    return ops.fail_jobs(status_rows(t), running, F.lit(9_000_000_000_000_000))


# messages --------------------------------------------------------------------------------------------

CTES["agents"] = (("log",), """
select event_id, ['PaperAnalyzer', 'ThemeDedup', 'ThemeReviewer', 'Aggregator', 'Other'][seq % 5 + 1] as agent,
  ['agent_started', 'agent_completed', 'agent_error', 'agent_tool_call', 'agent_tool_result', 'agent_content', 'odd'][seq % 7 + 1] as kind,
  seq % 3 as ctx, seq, payload from log""")


def agents(t):
    names = F.array(*[F.lit(x) for x in ("PaperAnalyzer", "ThemeDedup", "ThemeReviewer", "Aggregator", "Other")])
    kinds = F.array(*[F.lit(x) for x in ("agent_started", "agent_completed", "agent_error", "agent_tool_call", "agent_tool_result", "agent_content", "odd")])
    return t.events.select("event_id", F.element_at(names, (F.col("seq") % 5 + 1).cast("int")).alias("agent"),
                           F.element_at(kinds, (F.col("seq") % 7 + 1).cast("int")).alias("kind"), (F.col("seq") % 3).alias("ctx"), "seq", "payload")


@query("step_messages", "agents", sql="""
select event_id, case when kind = 'agent_started' and agent <> 'Other' then
    case agent when 'PaperAnalyzer' then case ctx when 0 then 'Analyzing ...' when 1 then 'Analyzing ''T' || seq || '''...' else 'Analyzing ''{paper_title}''...' end
      when 'ThemeDedup' then case ctx when 0 then 'Deduplicating themes across papers...' when 1 then 'Deduplicating {theme_count} themes across papers...' else 'Deduplicating ' || seq || ' themes across papers...' end
      when 'ThemeReviewer' then case ctx when 0 then 'Reviewing themes...' when 1 then 'Reviewing {theme_count} themes...' else 'Reviewing ' || seq || ' themes...' end
      else case ctx when 0 then 'Synthesizing literature review from themes...' when 1 then 'Synthesizing literature review from {theme_count} themes...' else 'Synthesizing literature review from ' || seq || ' themes...' end end
  when kind = 'agent_completed' and agent <> 'Other' then case agent when 'PaperAnalyzer' then 'Analysis complete' when 'ThemeDedup' then 'Deduplication complete'
      when 'ThemeReviewer' then 'Theme review complete' else 'Literature review generated' end || case when ctx = 0 then '...' else '' end
  when kind = 'agent_error' and agent <> 'Other' then case agent when 'PaperAnalyzer' then 'Analysis failed' when 'ThemeDedup' then 'Deduplication failed'
      when 'ThemeReviewer' then 'Theme review failed' else 'Aggregation failed' end || case when ctx = 0 then '...' else '' end
  else case kind when 'agent_started' then 'Processing...' when 'agent_completed' then 'Complete' when 'agent_error' then 'Failed' when 'agent_tool_call' then 'Gathering information...'
      when 'agent_tool_result' then 'Information retrieved' when 'agent_content' then 'Generating response...' else 'Processing...' end end as message from agents""")
def _(t):
    number = F.col("seq").cast("string")
    context = F.when(F.col("ctx") == 1, F.create_map(F.lit("paper_title"), F.concat(F.lit("T"), number))).when(
        F.col("ctx") == 2, F.create_map(F.lit("theme_count"), number)).otherwise(F.create_map().cast("map<string,string>"))
    return agents(t).select("event_id", ops.step_message(F.col("agent"), F.col("kind"), context).alias("message"))


@query("technical_messages", "agents", sql="""
select event_id, concat_ws(' ', '[' || agent || ']', case ctx when 0 then 'search' when 1 then 'search(q' || seq || ')' end,
  case when ctx < 2 and seq % 2 = 0 then '→ ' || seq || ' chars' end, case when seq % 5 <> 0 then '(' || (seq % 100) || 'ms)' end, case when seq % 4 = 0 then 'ERROR: e' end) as message from agents""")
def _(t):
    n = F.col("seq")
    p = F.struct(F.when(F.col("ctx") < 2, F.lit("search")).alias("tool_name"),
                 F.when(F.col("ctx") == 1, F.concat(F.lit("q"), n.cast("string"))).alias("tool_args_preview"),
                 F.when(n % 2 == 0, n).alias("result_len"), F.when(n % 5 != 0, n % 100).alias("elapsed_ms"),
                 F.when(n % 4 == 0, F.lit("e")).alias("error"))
    return agents(t).select("event_id", ops.technical_message(F.col("agent"), F.col("kind"), p).alias("message"))


@query("human_messages", "log", sql="""
select event_id, case event_type when 'stage_started' then coalesce(stage, 'undefined') || ' started' when 'stage_completed' then coalesce(stage, 'undefined') || ' completed'
  when 'paper_processed' then 'Paper processed in ' || coalesce(stage, 'undefined') || ' (' || (seq % 9) || '/undefined)' else event_type end as message from log""")
def _(t):
    payload = F.to_json(F.struct("stage", (F.col("seq") % 9).alias("completed")))
    rows = t.events.withColumn("p", ops.payload_fields(payload))
    return rows.select("event_id", ops.human_message(F.col("event_type"), F.col("p")).alias("message"))


@query("payload_fields", "log", sql="""
select event_id, cast(json_extract(payload, '$.k') as bigint) as completed, stage from log""")
def _(t):
    payload = F.concat(F.lit('{"completed":'), F.get_json_object("payload", "$.k"), F.coalesce(F.concat(F.lit(',"stage":"'), F.col("stage"), F.lit('"')), F.lit("")), F.lit("}"))
    rows = t.events.withColumn("p", ops.payload_fields(payload))
    return rows.select("event_id", "p.completed", "p.stage")


@query("visible_tools", "agents", sql="""
select event_id from agents where case seq % 4 when 0 then 'delegate_task_to_member' when 1 then 'transfer_task_to_agent' else 'search_claims' end = 'search_claims'""")
def _(t):
    tool = F.when(F.col("seq") % 4 == 0, "delegate_task_to_member").when(F.col("seq") % 4 == 1, "transfer_task_to_agent").otherwise("search_claims")
    return agents(t).withColumn("tool", tool).filter(~ops.is_internal_tool(F.col("tool"))).select("event_id")
