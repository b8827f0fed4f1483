"""Registered queries against their SQL on the smallest data folder (all of them with FULL=1)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

SAMPLE = [
    "resolve_citations", "build_references", "similar_pairs_blocked", "reconcile_members", "merge_chunk_positions", "group_contradictions",
    "classify_headings", "words_to_paragraphs", "pack_under_budget", "scrub_pii", "grounding_verdict", "gate_chain", "sample_traces",
    "section_message", "theme_message", "title_abstract_message", "aggregate_outputs", "reader_outputs", "stream_late_rows", "stream_sessions_in_batches", "reference_fallback", "progress", "sessions", "assemble_turns", "stream_late_scores", "upsert_collection",
    "toxic_fields", "ordered_union", "dedup_themes", "tag_entities", "search_claims_batch"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FULL") else SAMPLE
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, cursor.fetchall())


def test_entry_and_registration(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 140
