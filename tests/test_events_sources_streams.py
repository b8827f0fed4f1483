import json
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from citeloom.operators import events as ops
from citeloom.operators import messages
from citeloom.runtime import LISTING_TASKS, configure, fresh_dir
from citeloom.sources import admission, entities, event_log
from citeloom.streaming import streams
from tests.conftest import SF

EVENTS = "event_id string, event_type string, ts timestamp, job_id string, seq long, stage string, item_id string, total long, payload string"


BASE = 1_700_000_000_000_000  # a day well after the epoch, where watermarks start


def log(spark, items):
    """items: (id, type, seconds, job, stage, item, total)"""
    rows = [(i, kind, BASE + int(sec * 1_000_000), job, n, stage, item, total, None) for n, (i, kind, sec, job, stage, item, total) in enumerate(items)]
    df = spark.createDataFrame(rows, EVENTS.replace("ts timestamp", "us long"))
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us").select(*[c.split()[0] for c in EVENTS.split(", ")])


RUN = [
    ("e0", "job_started", 0, "j", None, None, None), ("e1", "stage_started", 1, "j", "a", None, 2), ("e2", "agent_started", 2, "j", "a", None, None),
    ("e3", "paper_processed", 3, "j", "a", "p1", None), ("e4", "agent_started", 4, "j", "a", None, None), ("e5", "agent_completed", 4.5, "j", "a", None, None),
    ("e6", "paper_processed", 6, "j", "a", "p1", None), ("e7", "stage_completed", 65.2, "j", "a", None, None), ("e8", "stage_started", 66, "j", "b", None, 0),
    ("e9", "job_completed", 200, "j", None, None, None), ("f0", "stage_started", 10, "k", "a", None, 1)]


def test_markers(spark, rows):
    df = log(spark, RUN)
    markers = spark.createDataFrame([("j", "e7"), ("k", None)], "job_id string, marker string")
    assert rows(ops.events_after(df, markers), "event_id") == [("e8",), ("e9",), ("f0",)]
    assert rows(ops.events_after(df, markers, 0), "event_id") == [("e8",), ("f0",)]
    assert ops.events_after(df, spark.createDataFrame([("j", "zz"), ("j", "e9")], "job_id string, marker string")).count() == 0


def test_spans_progress_and_times(spark, rows):
    df = log(spark, RUN)
    spans = ops.agent_spans(df, ["job_id", "stage"], ["agent_started"], ["agent_completed", "agent_error"])
    assert rows(spans, "event_id", "started_seq", "elapsed_ms") == [("e5", 4, 500)]
    assert rows(ops.open_spans(df), "event_id") == [("e8",), ("f0",)]
    got = rows(ops.progress(df).filter("job_id = 'j'"), "event_id", "completed_stages", "done", "progress")
    assert got == [("e1", 0, 0, 0.0), ("e3", 0, 1, 0.125), ("e6", 0, 2, 0.25), ("e7", 1, 0, 0.25), ("e8", 1, 0, 0.25)]
    shown = dict(rows(ops.relative_time(df), "event_id", "shown"))
    assert shown["e0"] == "0.0s" and shown["e3"] == "3.0s" and shown["e7"] == "1m 5s" and shown["f0"] == "0.0s" and shown["e5"] == "4.5s"
    assert rows(ops.stage_counts(df)) == [("j", "a", 1)]
    assert ops.until_terminal(df).count() == len(RUN)
    assert rows(ops.until_terminal(df, ["stage_completed"]).filter("job_id = 'j'").agg(F.max("event_id")))[0] == ("e7",)


def test_sessions_gap_is_strict(spark, rows):
    hour = 3600
    items = [("a", "x", t, "u", None, None, None) for t in (0, hour, 2 * hour + 0.00001, 2 * hour + 10)]
    got = rows(ops.sessions(log(spark, items), "job_id"), "session_no", "accesses")
    assert got == [(1, 2), (2, 2)]


def test_recent_runs_and_replies(spark, rows):
    turns = spark.createDataFrame([(1, i, r) for i, r in enumerate(["assistant", "user", "assistant", "user", "assistant", "user"])], "conv_id long, turn long, role string")
    assert rows(ops.recent_turns(turns, 2), "turn") == [(3,), (4,), (5,)]
    assert ops.recent_turns(turns, 10).count() == 6
    chat = [("s", 0, "message", "hi"), ("s", 1, "step", "look"), ("s", 2, "token", "a"), ("s", 3, "reference", "r1"), ("s", 4, "token", "b"), ("s", 5, "done", ""), ("s", 6, "token", "late"),
            ("s", 7, "message", "again"), ("s", 8, "token", "x"), ("s", 9, "reference", "r2"), ("s", 10, "error", "boom"), ("s", 11, "message", "m"), ("s", 12, "error", "bad"), ("s", 13, "message", "m"), ("s", 14, "token", "part")]
    got = rows(ops.assemble_turns(spark.createDataFrame(chat, "session_id string, seq long, kind string, content string")), "turn_no", "content", "steps", "references", "ended")
    assert got == [(1, "ab", ["look"], ["r1"], "done"), (2, "x\n\nError: boom", [], [], "error"), (3, "Error: bad", [], [], "error"), (4, "part", [], [], "open")]


def test_status_and_recovery(spark, rows):
    updates = spark.createDataFrame([("a", "pending", None, 0.0, 1, 10, 10, None), ("a", "running", "s1", 0.5, 1, 11, 12, None), ("b", "completed", "s", 1.0, 2, 5, 6, None)],
                                    "job_id string, status string, stage string, progress double, paper_count int, created_at long, updated_at long, error string")
    assert rows(ops.current_status(updates), "job_id", "status", "created_at") == [("a", "running", 10), ("b", "completed", 5)]
    assert rows(ops.recover_orphans(updates, F.lit(99)), "job_id", "status", "stage", "progress", "created_at", "updated_at") == [("a", "failed", "s1", 0.5, 10, 99)]
    failed = ops.fail_jobs(updates, spark.createDataFrame([("b",), ("z",)], "job_id string"), F.lit(99))
    assert rows(failed, "job_id", "stage", "progress", "paper_count", "created_at") == [("b", "", 0.0, 0, 5), ("z", "", 0.0, 0, 99)]


def test_message_lines_make_the_message(spark):
    reviews = spark.createDataFrame([("j", 0, 0, "L", "S.", ["c"], [], ["g"])], "job_id string, batch long, at long, label string, review string, consensus array<string>, disagreements array<string>, gaps array<string>")
    kc = spark.createDataFrame([("j", 0, 0, 0, 1, "a", "p", "sum"), ("j", 0, 0, 1, 2, "zz", "q", "s2")], "job_id string, batch long, at long, kc_pos int, ref_number long, claim_id string, paper_id string, summary string")
    claims = spark.createDataFrame([("j", "a", 1, 3, 4)], "job_id string, claim_id string, pos long, page int, paragraph int")
    lines = messages.to_text_lines(messages.section_message(reviews, kc, claims)).orderBy(*messages.LINE_KEY).collect()
    assert "\n".join(r.line for r in lines) == "\n".join([
        "=== THEME REVIEWS ===", "", "--- THEME 1: L ---", "", "SYNTHESIS: S.", "", "CONSENSUS:", "  - c", "", "GAPS:", "  - g", "", "KEY CLAIMS:",
        "  [1] sum (paper: p, p.3,§4)", "  [2] s2 (paper: q, p.?,§?)", "", "", "=== CLAIM REGISTRY ===", "Use these [N] numbers for inline citations in your response.", "",
        "  [1] claim_id=a paper_id=p", "  [2] claim_id=zz paper_id=q"])


# sources -------------------------------------------------------------------------------------------

def test_manifest_and_admission(spark, rows, tmp_path):
    for job, name, body in (("j1", "a.pdf", b"%PDF-1.4 x"), ("j1", "b.PDF", b"nope"), ("j2", "c.txt", b"%PDF-1.4"), ("j3", "d.pdf", b"x")):
        (tmp_path / job).mkdir(exist_ok=True)
        (tmp_path / job / name).write_bytes(body)
    files = admission.admit_files(admission.read_manifest(spark, str(tmp_path)))
    got = {(r.job_id, os.path.basename(r.path)): (r.status, r.reason) for r in files.collect()}
    assert got == {("j1", "a.pdf"): ("accepted", None), ("j1", "b.PDF"): ("skipped", "invalid PDF magic bytes"),
                   ("j2", "c.txt"): ("refused", "Only PDF files accepted"), ("j3", "d.pdf"): ("refused", "No papers could be ingested")}
    many = spark.createDataFrame([("m", f"{i}.pdf", 1, "%PDF-") for i in range(51)], "job_id string, path string, length long, magic string")
    assert rows(admission.admit_files(many).select("reason").distinct()) == [("Too many files: 51 exceeds limit of 50",)]


def test_scan_lists_empty_and_hidden_files(spark, tmp_path):
    (tmp_path / "j").mkdir()
    for name, body in (("a b.pdf", b"%PDF-1"), ("empty.pdf", b""), ("_u.pdf", b"%PDF-1"), (".h.pdf", b"no"), *((f"{i}.pdf", b"%PDF-") for i in range(46))):
        (tmp_path / "j" / name).write_bytes(body)
    found = admission.admit_files(admission.read_manifest(spark, str(tmp_path))).collect()
    got = {os.path.basename(r.path): (r.status, r.length) for r in found}
    assert len(found) == 50 and got["a b.pdf"] == ("accepted", 6) and got["empty.pdf"] == ("skipped", 0)
    assert got["_u.pdf"] == ("accepted", 6) and got[".h.pdf"] == ("skipped", 2)
    (tmp_path / "j" / "more.pdf").write_bytes(b"")
    assert {r.reason for r in admission.admit_files(admission.read_manifest(spark, str(tmp_path))).collect()} == {"Too many files: 51 exceeds limit of 50"}


def test_files_in_sub_folders_belong_to_their_job(spark, tmp_path):
    for name in ("j/a.pdf", "j/sub/deep/b.pdf", "k/.hidden/c.pdf", "top.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-1")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = {(r.job_id, r.path.split(str(tmp_path))[1], r.length, r.magic) for r in admission.read_manifest(spark, root).collect()}
        assert got == {("j", "/j/a.pdf", 6, "%PDF-"), ("j", "/j/sub/deep/b.pdf", 6, "%PDF-"), ("k", "/k/.hidden/c.pdf", 6, "%PDF-"), (tmp_path.name, "/top.pdf", 6, "%PDF-")}
    assert admission.read_manifest(spark, str(tmp_path / "none")).count() == 0


def test_a_hundred_thousand_files(spark, tmp_path):
    """A third of the files in one job; they are written, listed and opened in tasks."""
    doc = F.col("id")
    files = spark.range(100_000).select(F.when(doc % 3 == 0, "hot").otherwise((doc % 997).cast("string")).alias("job_id"), F.concat(doc.cast("string"), F.lit(".pdf")).alias("name"),
                                        F.when(doc % 2 == 0, "%PDF-x").otherwise("no").alias("body"))
    assert admission.write_files(files, str(tmp_path)) == 100_000
    found = admission.read_manifest(spark, str(tmp_path))
    assert found.agg(F.count("*"), F.count_distinct("path"), F.count_if(F.col("magic") == "%PDF-"), F.count_if(F.col("job_id") == "hot")).first() == (100_000, 100_000, 50_000, 33_334)
    assert found.filter(F.col("job_id") == "hot").select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("name", ["scan_uploads"])
def test_scan_equals_sql(spark, name):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = connection.execute(entry.oracle_sql()[name]).fetchall()
    got = entry.queries()[name](spark, SF).select("job_id", "name", "length", "status", "reason").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) > 100


def test_stored_names_skip_taken_ones(spark, rows):
    names = ["a.pdf", "x/a.pdf", "a_1.pdf", "a.pdf", ".pdf", ".pdf", "b.tar.pdf", "b.tar.pdf"]
    df = spark.createDataFrame([("j", i, n) for i, n in enumerate(names)], "job_id string, at int, filename string")
    assert [n for _, n in rows(admission.dedup_filenames(df), "at", "stored_name")] == ["a.pdf", "a_1.pdf", "a_1_1.pdf", "a_2.pdf", ".pdf", ".pdf_1", "b.tar.pdf", "b.tar_1.pdf"]


def test_replay_page_reads_its_files_only(spark, tmp_path):
    path = str(tmp_path / "replay")
    events = spark.range(4000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"), F.lit("x").alias("event_type"), F.timestamp_seconds("id").alias("ts"),
                                      F.when(F.col("id") % 4 != 0, "hot").otherwise((F.col("id") % 3).cast("string")).alias("job_id"), F.col("id").alias("seq"),
                                      *[F.lit(None).cast(k).alias(c) for c, k in (("stage", "string"), ("item_id", "string"), ("total", "long"), ("payload", "string"))])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        event_log.write_replay(events.filter("seq < 2000"), path)
        event_log.write_replay(events.filter("seq >= 1500 and seq % 2 = 1").filter("seq >= 2000"), path)
        event_log.write_replay(events.filter("seq >= 2000 and seq % 2 = 0"), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = len(list((tmp_path / "replay" / "rows").rglob("*.parquet")))
    hot = [i for i in range(4000) if i % 4]
    for after, limit in ((None, 10), (0, 500), (1999, 7), (2500, 900), (3990, 100), (9000, 5)):
        page = event_log.replay_page(spark, path, "hot", after, limit)
        assert [r.seq for r in page.collect()] == [i for i in hot if after is None or i > after][:limit]
        if limit <= 10:
            assert len(page.inputFiles()) <= 3 < files
    assert event_log.replay_page(spark, path, "none").count() == 0


def test_event_log_skips_bad_lines(spark, rows, tmp_path):
    df = log(spark, RUN)
    path = str(tmp_path / "log")
    event_log.write_events(df, path)
    with open(f"{path}/job_id=j/extra.json", "w") as f:
        f.write('\n{"event_id": \nnot json\n' + json.dumps({"event_id": "late", "event_type": "job_failed"}) + "\n")
    back = event_log.read_events(spark, path)
    assert back.count() == len(RUN) + 1 and event_log.corrupt_lines(spark, path).count() == 2
    assert rows(back.filter("event_id = 'e5'"), F.unix_micros("ts")) == [(BASE + 4_500_000,)]


def test_job_folders_are_listed_many_to_a_task(spark, tmp_path):
    path, sc = str(tmp_path / "log"), configure(spark).sparkContext
    one = log(spark, RUN).filter("event_id = 'e5'").drop("job_id")
    event_log.write_events(one.crossJoin(spark.range(150).select(F.concat(F.lit("j"), F.col("id").cast("string")).alias("job_id"))), path)
    sc.setJobGroup("listing", "folders of the log")
    assert event_log.read_events(spark, path).select("job_id").distinct().count() == 150
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= LISTING_TASKS


def test_entities_replace_jobs_only(spark, rows, tmp_path):
    root = str(tmp_path)
    assert entities.read_entity(spark, root, "theme_map").count() == 0
    df = spark.createDataFrame([("c", 0, "t", "j1"), ("d", 0, "t", "j2")], entities.SCHEMAS["theme_map"])
    entities.write_entity(df, root, "theme_map")
    entities.write_entity(df.filter("job_id = 'j1'").withColumn("theme_id", F.lit("new")), root, "theme_map")
    assert rows(entities.read_entity(spark, root, "theme_map"), "canonical_id", "theme_id", "job_id") == [("c", "new", "j1"), ("d", "t", "j2")]


def test_upsert_replaces_by_id(spark, rows, tmp_path):
    root = str(tmp_path)
    assert entities.read_collection(spark, root, "paper_themes") is None
    assert len(entities.ensure_collections(spark, root)) == 5 and entities.ensure_collections(spark, root) == []
    make = "id string, job_id string, text string, vec array<double>, paper_id string, name string, description string"
    entities.upsert(spark, root, "paper_themes", spark.createDataFrame([("1", "j", "a", [1.0], "p", "n", ""), ("2", "j", "b", [1.0], "p", "n", "")], make))
    entities.upsert(spark, root, "paper_themes", spark.createDataFrame([("2", "j", "B", [1.0], "p", "n", ""), ("3", "j", "c", [1.0], "p", "n", "")], make))
    assert rows(entities.read_collection(spark, root, "paper_themes"), "id", "text") == [("1", "a"), ("2", "B"), ("3", "c")]


# streams -------------------------------------------------------------------------------------------

def write_part(spark, folder, items, start=0):
    df = log(spark, items).withColumn("seq", F.col("seq") + start)
    df.coalesce(1).write.mode("append").option("timestampFormat", event_log.TIMESTAMP_FORMAT).json(folder)
    time.sleep(1.1)  # file times order the batches


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_replay_after_restart_drops_duplicates(spark, rows, tmp_path):
    folder, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def once():
        stream = streams.drop_replayed(streams.live_events(spark, folder), "1 day")
        run(stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target))

    write_part(spark, folder, RUN[:6])
    once()
    write_part(spark, folder, RUN[3:], start=3)
    once()
    assert rows(spark.read.parquet(target), "event_id") == sorted((r[0],) for r in RUN)


def test_job_states_over_restart(spark, tmp_path):
    folder, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def once():
        stream = streams.job_states(streams.live_events(spark, folder))
        run(stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target))

    write_part(spark, folder, RUN[:5])
    once()
    first = {r.job_id: (r.status, r.stages) for r in spark.read.parquet(target).collect()}
    assert first == {"j": ("running", "a:running:1")}
    write_part(spark, folder, RUN[5:] + [("g", "stage_started", 300, "j", "zz", None, 1)], start=5)
    once()
    latest = spark.read.parquet(target).groupBy("job_id").agg(F.max_by(F.struct("status", "stages", "progress"), "last_seq").alias("s"))
    got = {r.job_id: tuple(r.s) for r in latest.collect()}
    assert got == {"j": ("completed", "a:completed:1|b:running:0", 0.25), "k": ("running", "a:running:0", 0.0)}


def test_state_does_not_grow_with_finished_jobs(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    done = [(f"{kind}{j}", kind, j * 10 + i, f"j{j}", "a", f"i{j}" if kind == "paper_processed" else None, 1) for j in range(40)
            for i, kind in enumerate(("stage_started", "paper_processed", "job_completed"))]
    held = []

    def once(rows, start):
        write_part(spark, folder, rows, start=start)
        query = streams.job_states(streams.live_events(spark, folder), delay="1 hour", finished_for_ms=3_600_000).writeStream.outputMode("append").option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target)
        assert query.awaitTermination(120)
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    once([*done, ("x", "stage_started", 500, "open", "a", None, 1)], 0)
    once([("again", "paper_processed", 600, "j3", "a", "new", None), ("y", "paper_processed", 900_000, "open", "a", "i", None)], 500)
    once([("z", "paper_processed", 901_000, "open", "a", "i2", None)], 600)
    assert held[-1] <= 6 < held[0]
    latest = spark.read.parquet(target).groupBy("job_id").agg(F.max_by(F.struct("status", "stages"), "last_seq").alias("s"))
    got = {r.job_id: tuple(r.s) for r in latest.collect()}
    assert got["j3"] == ("completed", "a:running:1") and got["open"] == ("running", "a:running:2") and len(got) == 41


def test_written_log_streams_with_its_job_folders(spark, rows, tmp_path):
    folder = str(tmp_path / "log")
    event_log.write_events(log(spark, RUN), folder)
    got = streams.run_to_table(streams.live_events(spark, folder).select("event_id", "job_id"), "log-stream")
    assert rows(got, "event_id", "job_id") == sorted((r[0], r[3]) for r in RUN)


def test_late_rows_go_to_the_side_table(spark, rows, tmp_path):
    folder = str(tmp_path / "in")
    paths = {n: str(tmp_path / n) for n in ("main", "side", "marks", "cp")}

    def once():
        run(streams.late_to_side_table(streams.live_events(spark, folder), paths["main"], paths["side"], paths["marks"], paths["cp"], 10_000_000, availableNow=True))

    write_part(spark, folder, [("a", "x", 100, "j", None, None, None)])
    once()
    write_part(spark, folder, [("b", "x", 90, "j", None, None, None), ("c", "x", 89, "j", None, None, None), ("d", "x", 200, "j", None, None, None)])
    once()
    assert rows(spark.read.parquet(paths["main"]), "event_id") == [("a",), ("b",), ("d",)]
    assert rows(spark.read.parquet(paths["side"]), "event_id") == [("c",)]


def test_one_failing_listener_does_not_stop_the_other(spark, rows, tmp_path):
    folder, good = str(tmp_path / "in"), str(tmp_path / "good")
    write_part(spark, folder, RUN)

    def fail(batch, batch_id):
        raise RuntimeError("listener failed")

    queries = streams.fan_out(streams.live_events(spark, folder), {
        "bad": fail, "good": lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")}, str(tmp_path / "cp"), availableNow=True)
    with pytest.raises(Exception, match="listener failed"):
        queries["bad"].awaitTermination(120)
    run(queries["good"])
    assert spark.read.parquet(good).count() == len(RUN)


def test_late_score_is_quarantined(spark, rows, tmp_path):
    hour = 3600
    reviews, scores = str(tmp_path / "r"), str(tmp_path / "s")
    write_part(spark, reviews, [("r1", "x", 0, "a", None, None, None), ("r2", "x", 0, "b", None, None, None), ("r3", "x", 50 * hour, "c", None, None, None)])
    write_part(spark, scores, [("s1", "x", 0.5 * hour, "a", None, None, 7), ("s2", "x", 2 * hour, "b", None, None, 8), ("s3", "x", 50 * hour, "z", None, None, 9)])
    left = streams.live_events(spark, reviews).select(F.col("event_id").alias("review_id"), "job_id", F.col("ts").alias("reviewed_at"))
    right = streams.live_events(spark, scores).select("job_id", F.col("ts").alias("scored_at"), F.col("total").cast("double").alias("score"))
    got = rows(streams.run_to_table(streams.late_scores(left, right, "0 seconds"), "scores"), "review_id", "score", "outcome")
    assert got == [("r1", 7.0, "scored"), ("r2", None, "quarantine")]
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")
