"""The pipeline against a plain version of each stage, and the registration of all queries."""

from collections import Counter, defaultdict

from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from citeloom.llm import langid, mixing, pii
from tests.llm.test_similarity import made_documents, plain_classes

PROFANE = "mail me at a.b@example.org or +1 743 555 3824 now"


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = [(i, t if i % 9 else f"{t} {PROFANE}" if t else t, ("en", "de", None)[i % 3], "abc"[i % 3] if i % 5 else None) for i, t in made_documents(90)]
    rows.append((2000, "12 34 ...", "en", "a"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    letters = {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in kept.collect()} == letters and kept.filter("lang is null").count() == 0

    kept = corpus_pipeline.stage(kept, "kept")
    single = corpus_pipeline.stage(corpus_pipeline.near_duplicates(spark, kept, str(tmp_path)), "single")
    groups = plain_classes([(i, t) for i, t, *_ in rows if i in letters])
    assert sorted(r.doc_id for r in single.collect()) == sorted({g for g, _ in groups.values()})

    clean = corpus_pipeline.personal_data(spark, single, str(tmp_path))
    texts = {i: pii.redacted(t) for i, t, *_ in rows}
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {r.doc_id: (texts[r.doc_id], len(texts[r.doc_id])) for r in single.collect()}
    assert any("[EMAIL]" in r.text for r in clean.collect())

    clean = corpus_pipeline.stage(clean, "clean")
    mixed = corpus_pipeline.source_mix(spark, clean, str(tmp_path))
    assert mixed.columns == clean.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    planned = {r.doc_id: r for r in mixing.plan(mixing.measured(clean)).collect()}
    assert times == Counter({i: p.copies for i, p in planned.items() if p.copies})
    taken, longest = defaultdict(int), max(p.size for p in planned.values())
    for p in planned.values():
        taken[p.source] += p.copies * p.size
    assert all(abs(taken[p.source] - p.target) <= longest for p in planned.values())

    tokenizer = Tokenizer.from_file(corpus_pipeline.BYTE_BPE)
    last = corpus_pipeline.token_ids(spark, corpus_pipeline.stage(mixed, "mixed"), str(tmp_path)).collect()
    assert all(r.round_trip and r.ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids for r in last)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == times == Counter(r.doc_id for r in last)


def test_empty_documents_pass(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert langid.UNKNOWN == "und"
