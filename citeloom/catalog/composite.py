"""Composite jobs run end to end over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog import citations as cited
from citeloom.catalog.citations import RESOLVED, SUPPLIER_PAPERS, TIDY, sections, supplier_papers
from citeloom.catalog.layout import listed
from citeloom.catalog.reading import heads, job_papers
from citeloom.catalog.registry import query
from citeloom.catalog.stand_ins import CTES
from citeloom.catalog.themes import LOW, LOWER, buckets, chunk_inputs, tagged, theme_scores
from citeloom.catalog.verification import batch_claims, batch_key_claims, mail, reviews, runs
from citeloom.functions.vectors import with_pair_scores, with_vectors
from citeloom.operators import corpus, views
from citeloom.plans import jobs
from citeloom.runtime import fresh_dir
from citeloom.sources import entities

# ingestion: documents whose ids divide by seven have no usable spans, so their words are used ---------

CTES["kept_rows"] = (("classified", "word_rows", "papers"), """
select paper_id, page_idx + 1 as page, idx, text, record, bold_heading from classified where paper_id % 7 <> 0 and paper_id in (
  select c.paper_id from classified c join papers p using (paper_id) group by c.paper_id, p.page_count having sum(length(c.text)) / p.page_count >= 50)
union all
select paper_id, page_idx + 1, idx, text, record, bold_heading from word_rows where (paper_id % 7 = 0 or paper_id not in (
  select c.paper_id from classified c join papers p using (paper_id) group by c.paper_id, p.page_count having sum(length(c.text)) / p.page_count >= 50)) and paper_id in (
  select c.paper_id from word_rows c join papers p using (paper_id) group by c.paper_id, p.page_count having sum(length(c.text)) / p.page_count >= 50)""")


def ingested(t):
    blank = t.spans.withColumn("text", F.when(F.col("paper_id") % 7 != 0, F.col("text")).otherwise(""))
    return jobs.ingest(blank, t.words, t.papers.select("paper_id", "page_count"), threshold=300)


@query("ingest_contents", "kept_rows", sql=r"""
with clean as (select *, case when record then '# ' when bold_heading then '## ' else '' end || '[p.' || page || ',§' || idx || '] ' ||
  regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'),
    '(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\b\d{3}[ .-])\d{3}[ .-]\d{4}\b', '[PHONE]', 'g') as line from kept_rows),
sized as (select *, length(string_agg(line, chr(10) || chr(10)) over (partition by paper_id)) + 1 as n,
  greatest(sum(cast(bold_heading and not record as integer)) over (partition by paper_id order by page, idx) - 1, 0) as c from clean),
placed as (select *, case when n // 4 <= 300 then 0 else c end as chunk from sized)
select paper_id, cast(chunk as bigint) as chunk, md5(string_agg(line, chr(10) || chr(10) order by page, idx) || chr(10)) as content from placed group by paper_id, chunk""")
def _(t):
    return ingested(t).contents.withColumn("content", F.md5("content"))


@query("aggregate_sections", "sections", "citations", "claims", sql=f"""
with {RESOLVED.replace('from citations c left join claims k using', 'from citations c join claims k using')},
valid as (select c.job_id, c.ref_number, c.claim_id from citations c semi join claims k on c.job_id = k.job_id and c.claim_id = k.claim_id),
cites as (select job_id, review_pos, unnest(citation_refs) as ref_number, generate_subscripts(citation_refs, 1) as k_at from sections),
ids as (select job_id, review_pos, string_agg(claim_id, ',' order by k_at) as claim_ids, string_agg(ref_number::varchar, ',' order by k_at) as refs
  from cites join valid using (job_id, ref_number) group by 1, 2)
select g.job_id, g.theme_id, {TIDY} as content, coalesce(claim_ids, '') as claim_ids, coalesce(refs, '') as citation_refs
from glued g left join ids using (job_id, review_pos)""")
def aggregated_sections(t):
    done = jobs.aggregate(sections(t), t.section_citations, t.claims, supplier_papers(t)).sections
    return done.select("job_id", "theme_id", "content", F.array_join("claim_ids", ",").alias("claim_ids"),
                       cited.numbers("citation_refs").alias("citation_refs"))


def outputs(**frames):
    """Several outputs of a stage as one table: (output, job_id, key, value)."""
    whole = None
    for name, (df, key, value) in frames.items():
        rows = df.select(F.lit(name).alias("output"), "job_id", key.alias("key"), value.alias("value"))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def text(*columns):
    return F.concat_ws("/", *[F.col(c).cast("string") for c in columns])


@query("aggregate_outputs", "sections", "citations", "claims", sql=f"""
with valid as (select c.* from citations c semi join claims k on c.job_id = k.job_id and c.claim_id = k.claim_id),
found as (select distinct job_id, theme_id, unnest(regexp_extract_all(content, '\\[(\\d+)\\]', 1))::bigint as ref_number from sections),
placed as (select c.job_id, c.paper_id, c.ref_number, c.claim_id, coalesce(p.title, '') as title, coalesce(k.page, 0) as page, coalesce(k.paragraph, 0) as paragraph,
  min(c.ref_number) over (partition by c.job_id, c.paper_id) as first_ref
  from valid c left join claims k using (job_id, claim_id) left join {SUPPLIER_PAPERS} p on p.paper_id = c.paper_id)
select 'orphans' as output, f.job_id, theme_id as key, string_agg(ref_number::varchar, '/' order by ref_number) as value
  from found f where not exists (select 1 from citations c where c.job_id = f.job_id and c.ref_number = f.ref_number) group by f.job_id, theme_id
union all select 'citations', job_id, ref_number::varchar, concat_ws('/', claim_id, paper_id, title, page, paragraph) from placed
union all select 'references', job_id, concat_ws('/', paper_id, ref_number), concat_ws('/', title, first_ref, page, paragraph) from placed""")
def _(t):
    """What aggregation returns besides the sections: orphaned numbers, placed citations, references."""
    done = jobs.aggregate(sections(t), t.section_citations, t.claims, supplier_papers(t))
    return outputs(
        orphans=(done.orphans, F.col("theme_id"), F.array_join(F.transform("missing", lambda n: n.cast("string")), "/")),
        citations=(done.citations, text("ref_number"), text("claim_id", "paper_id", "paper_title", "page", "paragraph")),
        references=(done.references, text("paper_id", "ref_number"), text("paper_title", "first_ref", "page", "paragraph")))


@query("reader_outputs", "sections", "citations", "claims", sql=f"""
with {RESOLVED.replace('from citations c left join claims k using', 'from citations c join claims k using')},
valid as (select c.job_id, c.ref_number, c.claim_id from citations c semi join claims k on c.job_id = k.job_id and c.claim_id = k.claim_id),
cites as (select job_id, review_pos, unnest(list_distinct(citation_refs)) as ref_number from sections),
texts as (select job_id, review_pos, {TIDY} as content from glued)
select 'cited_in' as output, v.job_id, v.ref_number::varchar as key, coalesce(c.review_pos::varchar, '') as value from valid v left join cites c using (job_id, ref_number)
union all select 'markdown', job_id, (review_pos // 1000)::varchar, md5(string_agg('## Theme ' || review_pos || chr(10) || chr(10) || content, chr(10) || chr(10) order by review_pos)) from texts group by job_id, review_pos // 1000
union all select 'markdown', job_id, '-1', md5('*About ' || job_id || '*') from (select distinct job_id from claims)
union all select 'stats', job_id, '', concat_ws('/', count(distinct paper_id), count(distinct theme_id), count(*)) from claims group by job_id
union all select 'colours', job_id, theme_id, (row_number() over (partition by job_id order by min(pos)) - 1)::varchar from claims group by job_id, theme_id""")
def _(t):
    """The reader's tables from an aggregated review."""
    papers = supplier_papers(t).withColumn("filename", F.lit(None).cast("string"))
    done = jobs.aggregate(sections(t), t.section_citations, t.claims, papers)
    view = jobs.reader_view(heads(t), done, job_papers(t).join(papers, "paper_id", "left"), t.claims.withColumn("summary", F.lit(None).cast("string")), t.claims)
    return outputs(
        cited_in=(view["cited_in"], text("ref_number"), text("section_pos")),
        markdown=(view["markdown"], text("part"), F.md5("text")),
        stats=(view["stats"], F.lit(""), text("papers", "themes", "claims")),
        colours=(view["colours"], F.col("theme_id"), text("colour_index")))


@query("bucket_themes", "vec_pairs", "jobs2", sql=f"""
with recursive near as (select job_id, a, b from vec_pairs where cosine >= {LOW} or (shared and cosine >= {LOWER})),
spread(job_id, pos, label) as (select job_id, pos, pos from jobs2 union
  select s.job_id, case when n.a = s.pos then n.b else n.a end, s.label from spread s join near n on n.job_id = s.job_id and (n.a = s.pos or n.b = s.pos)),
labels as (select job_id, pos, min(label) as component from spread group by job_id, pos)
select job_id, component, count(*) as n from labels group by job_id, component""")
def _(t):
    parts = jobs.bucket_themes(tagged(t), threshold=LOW, shared=LOWER)
    return parts.groupBy("job_id", "component").agg(F.count(F.lit(1)).alias("n"))


@query("map_themes_problems", "members", "theme_scores", sql="""
with best as (select a, b, max(contradiction) as c from theme_scores group by a, b)
select x.bucket, x.group_no, 'contradiction' as kind, count(*) as n
from members x join members y on x.bucket = y.bucket and x.group_no = y.group_no and x.idx < y.idx
join best f on f.a = x.theme_id and f.b = y.theme_id join best r on r.a = y.theme_id and r.b = x.theme_id
where f.c >= 0.5 and r.c >= 0.5 group by 1, 2
union all select bucket, group_no, 'range', count(*) from members where not known group by 1, 2""")
def _(t):
    _built, offenders, contradicting = jobs.map_themes(*buckets(t), theme_scores(t))
    both = contradicting.select("bucket", "group_no", F.lit("contradiction").alias("kind")).unionByName(
        offenders.select("bucket", "group_no", F.lit("range").alias("kind")))
    return both.groupBy("bucket", "group_no", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("analyse_claims", "chunk_remap", "claims", sql="""
select r.paper_id, c.claim_id, r.canonical_id as theme_id from claims c join chunk_remap r on r.theme_id = c.theme_id
where r.paper_id <> 'Brand#3' and c.discount >= 0.05""")
def _(t):
    chunk_themes, positions, claims = chunk_inputs(t)
    papers = t.raw("part").groupBy(F.col("p_brand").alias("paper_id")).agg(F.count(F.lit(1)).alias("n")).select(
        "paper_id", F.lit(1).alias("page_count"), F.when(F.col("paper_id") != "Brand#3", F.lit("t")).otherwise("").alias("title"),
        F.array(F.lit("a")).alias("authors"), F.repeat(F.lit("x"), F.lit(100)).alias("content"))
    scores = t.claims.select("claim_id", (F.col("discount") * 13).alias("score"))
    return jobs.analyse(papers, chunk_themes, positions, claims.join(scores, "claim_id"), 0.649)[3].select("paper_id", "claim_id", "theme_id")


# verified reviews, reader entries, evaluation ----------------------------------------------------------

CTES["theme_scored"] = (("claims",), """
select theme_id, paragraph % 3 as sentence_pos, 'Sentence ' || (paragraph % 3) as sentence, pos as claim_pos, claim_id,
  round((1.0::double - discount * 10) * least(1.0::double, tax * 12), 6) as contradiction, round(discount * 10, 6) as entailment from claims""")
CTES["theme_judged"] = (("theme_scored",), """
select theme_id, sentence_pos, sentence, case when max(entailment) >= 0.7 then 'grounded' when max(contradiction) >= 0.7 then 'contradicted' else 'borderline' end as verdict
from theme_scored group by all""")


def reviewed(t):
    """Theme reviews through naming, redaction, verification and grounding."""
    told = reviews(t).withColumn("review_no", F.col("theme_id").cast("long")).withColumn(
        "theme_name", F.concat(F.lit("theme__"), "theme_id")).withColumn("batch", F.floor(F.col("review_no") / 5)).drop("theme_id")
    named = t.themes.select(F.floor(F.col("pos") / 5).alias("batch"), "pos", "theme_id", F.concat(F.lit("Theme "), "theme_id").alias("name"))
    labels = t.themes.select("theme_id", F.lit("CONSENSUS").alias("kind"), F.explode(F.array(F.lit(0), F.lit(2))).alias("at"), F.lit("CONSENSUS").alias("label"))
    entail = F.round(F.col("discount") * 10, 6)
    scores = t.claims.select(
        "theme_id", (F.col("paragraph") % 3).alias("sentence_pos"), F.concat(F.lit("Sentence "), (F.col("paragraph") % 3).cast("string")).alias("sentence"),
        F.col("pos").alias("claim_pos"), "claim_id", F.round((F.lit(1.0) - F.col("discount") * 10) * F.least(F.lit(1.0), F.col("tax") * 12), 6).alias("contradiction"),
        entail.alias("entailment"), F.lit(0.0).alias("neutral"))
    second = t.themes.select("theme_id", F.explode(F.array(F.lit("Sentence 0"), F.lit("Sentence 1"))).alias("sentence"),
                             F.when(F.col("pos") % 2 == 0, "ENTAILED").otherwise("NEUTRAL").alias("label"))
    return jobs.review_themes(told, named, batch_key_claims(t), batch_claims(t), t.claims, labels, scores, second)


@query("review_themes", "reviews", "claims", sql=f"""
select theme_id, 'Theme ' || theme_id as label, {mail('review')} as review,
  case when theme_id in (select theme_id from claims) then consensus[1] || '|' || consensus[3] else array_to_string(list_transform(consensus, lambda c: {mail('c')}), '|') end as consensus,
  case when theme_id in (select theme_id from claims) then concat_ws('|', gaps[1], 'Not verified as consensus: ' || {mail('consensus[2]')}, 'Not verified as disagreement: ' || disagreements[1]) else gaps[1] end as gaps
from reviews""")
def _(t):
    return reviewed(t).reviews.select("theme_id", "label", "review", listed("consensus").alias("consensus"), listed("gaps").alias("gaps"))


@query("review_themes_grounding", "theme_judged", sql="""
select theme_id, sentence_pos, case when verdict = 'borderline' and sentence_pos < 2 then case when theme_id::bigint % 2 = 0 then 'grounded' else 'contradicted' end else verdict end as verdict,
  case when verdict = 'borderline' and sentence_pos < 2 then 'llm_as_nli' else 'deberta' end as resolved_by from theme_judged""")
def _(t):
    return reviewed(t).grounding.select("theme_id", "sentence_pos", "verdict", "resolved_by")


@query("reader_entries", "citations", "claims", sql=f"""
select c.job_id, c.ref_number as index, coalesce(p.title, '') as title, 'p.' || k.page || ', §' || k.paragraph as position, k.text
from citations c join claims k using (job_id, claim_id) left join {SUPPLIER_PAPERS} p on p.paper_id = c.paper_id""")
def _(t):
    papers = supplier_papers(t).withColumn("filename", F.lit(None).cast("string"))
    done = jobs.aggregate(t.unwritten_sections, t.section_citations, t.claims, papers)
    claims = t.claims.withColumn("summary", F.lit(None).cast("string"))
    entries = views.review_reader(done.citations, job_papers(t).join(papers, "paper_id", "left"), claims)
    return entries.select("job_id", "index", "title", "position", "text")


@query("evaluate_regressions", "runs", sql="""
select replace(lower(metric), ' ', '_') as metric, round(avg(score), 9) as score, avg(score) >= 0.72::double * 0.95 as passed from runs where score is not null group by 1""")
def _(t):
    scores = runs(t)
    baseline = scores.select(F.replace(F.lower("metric"), F.lit(" "), F.lit("_")).alias("metric")).distinct().withColumn("baseline", F.lit(0.72))
    traces = scores.select(F.col("case_id").alias("trace_id"), F.col("metric").alias("input"), F.col("metric").alias("output"), F.array("metric").alias("retrieved_contexts"))
    return jobs.evaluate(scores, baseline, scores, scores, traces)["regressions"].select("metric", F.round("score", 9).alias("score"), "passed")


@query("evaluate_outputs", sql="""
with scores as (select doc_id::varchar as case_id, 'faithfulness' as metric, 0.4::double + quality * 0.5::double as score from labels
  union all select doc_id::varchar, 'Citation Accuracy', 0.35::double + doc_id % 5 * 0.2::double from labels),
cases as (select distinct case_id from scores),
sampled as (select case_id from cases order by md5('0' || case_id), case_id limit (select greatest(1, cast(floor(count(*) * 0.1::double) as bigint)) from cases))
select 'averages' as output, '' as case_id, replace(lower(metric), ' ', '_') as metric, round(avg(score), 9) as value from scores group by 3
union all select 'regressions', '', replace(lower(metric), ' ', '_'), case when avg(score) >= 0.72::double * 0.95 then 1.0 else 0.0 end from scores group by 3
union all select 'concordance', case_id, metric, round(abs(score - score * 0.5::double), 9) from scores
union all select 'sampled', case_id, '', 1.0 from sampled
union all select 'misses', case_id, metric, round(score, 9) from scores where metric = 'faithfulness' and score < 0.7""")
def _(t):
    """Everything an evaluation returns."""
    scores = t.raw("labels").select(F.col("doc_id").cast("string").alias("case_id"), F.explode(F.array(
        F.struct(F.lit("faithfulness").alias("metric"), (F.lit(0.4) + F.col("quality") * 0.5).alias("score")),
        F.struct(F.lit("Citation Accuracy").alias("metric"), (F.lit(0.35) + F.col("doc_id") % 5 * 0.2).alias("score")))).alias("m")).select("case_id", "m.*")
    baseline = scores.select(F.replace(F.lower("metric"), F.lit(" "), F.lit("_")).alias("metric")).distinct().withColumn("baseline", F.lit(0.72))
    traces = scores.select(F.col("case_id").alias("trace_id")).distinct().select(
        "trace_id", F.lit("q").alias("input"), F.lit("a").alias("output"), F.array(F.lit("c")).alias("retrieved_contexts"))
    done = jobs.evaluate(scores, baseline, scores, scores.withColumn("score", F.col("score") * 0.5), traces)
    nothing = F.lit("")

    def rows(name, case, metric, value):
        return done[name].select(F.lit(name).alias("output"), case.alias("case_id"), metric.alias("metric"), F.round(value, 9).alias("value"))

    whole = rows("averages", nothing, F.col("metric"), F.col("score"))
    for more in (rows("regressions", nothing, F.col("metric"), F.col("passed").cast("double")),
                 rows("concordance", F.col("case_id"), F.col("metric"), F.col("abs_diff")),
                 rows("sampled", F.col("trace_id"), nothing, F.lit(1.0)),
                 rows("misses", F.col("case_id"), F.col("metric"), F.col("score"))):
        whole = whole.unionByName(more)
    return whole


# hooks and set operations ------------------------------------------------------------------------------

def _length_ratio(left, right):
    import pandas as pd

    a, b = left.str.len(), right.str.len()
    entail = pd.concat([a, b], axis=1).min(axis=1) / pd.concat([a, b], axis=1).max(axis=1)
    return pd.DataFrame({"contradiction": (1 - entail) / 2, "entailment": entail, "neutral": (1 - entail) / 2})


@query("with_pair_scores", sql="""
select p_partkey as pos, round(least(length(p_name), length(p_type)) / greatest(length(p_name), length(p_type)), 9)::double as entailment from part""")
def _(t):
    scored = with_pair_scores(t.themes, "name", "description", _length_ratio)
    return scored.select("pos", F.round("scores.entailment", 9).alias("entailment"))


def _merge_pages(pages):
    import pandas as pd

    return pd.DataFrame({"paper_id": [pages["paper_id"].iloc[0]], "chunks": [pages["page"].nunique()], "chars": [int(pages["n"].sum())]})


@query("merge_chunks_with", "paragraphs", sql="""
select paper_id, count(distinct page) as chunks, cast(sum(length(text)) as bigint) as chars from paragraphs group by paper_id""")
def _(t):
    lines = t.paragraphs.select("paper_id", "page", F.length("text").alias("n"))
    return corpus.merge_chunks_with(lines, _merge_pages, "paper_id bigint, chunks bigint, chars bigint")


@query("refs_set_operations", "sections", sql="""
select s.job_id, s.theme_id, cast(len(list_distinct(citation_refs)) as integer) as refs,
  cast(len(list_filter(list_distinct(citation_refs), lambda r: r < 1000000)) as integer) as inner_refs, list_has_any(citation_refs, [1, 2, 3]) as early from sections s""")
def _(t):
    """Ordered distinct, difference and overlap of the reference lists."""
    low = F.filter(F.array_distinct("citation_refs"), lambda r: r < 1000000)
    rest = F.array_except("citation_refs", F.filter("citation_refs", lambda r: r >= 1000000))
    first = F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])
    return sections(t).select("job_id", "theme_id", F.size(F.array_distinct("citation_refs")).alias("refs"),
                              F.size(F.array_intersect(low, rest)).alias("inner_refs"), F.arrays_overlap("citation_refs", first).alias("early"))


@query("ordered_union", "claims", sql="""
select claim_id, row_number() over (order by case job_id when 'R' then 0 when 'A' then 1 else 2 end, pos) - 1 as "at" from claims""")
def _(t):
    """Claims of one job after another, each in its order."""
    frames = [t.claims.filter(F.col("job_id") == job) for job in ("R", "A")] + [t.claims.filter(~F.col("job_id").isin("R", "A"))]
    return corpus.ordered_union([f.select("claim_id", "pos") for f in frames], "pos").select("claim_id", "at")


# corpus search ------------------------------------------------------------------------------------------

@query("corpus_search", sql=r"""
with points as (select p_partkey::varchar as id, p_name || ': ' || p_type as text from part),
asked as (select p_partkey as query_id, case when p_partkey % 400 = 0 then repeat(p_name, 2000) else p_name end as query,
  least(100, greatest(1, case p_partkey % 3 when 0 then 0 when 1 then 500 else 10 end)) as lim from part where p_partkey % 50 = 0),
words as (select 'c' as side, id, unnest(regexp_split_to_array(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '[ \t\r\n]+')) as w from points
  union all select 'q', query_id::varchar, unnest(regexp_split_to_array(trim(lower(query), ' ' || chr(9) || chr(10) || chr(13)), '[ \t\r\n]+')) from asked where length(query) <= 10000),
slots as (select side, id, cast(('0x' || substr(md5(w), 1, 8))::ubigint % 64 as integer) as slot, count(*)::double as n from words where w <> '' group by all),
sized as (select side, id, sqrt(sum(n * n)) as size from slots group by all),
scored as (select q.id::bigint as query_id, c.id, sum(q.n * c.n) / any_value(a.size * b.size) as score
  from slots q join slots c on q.side = 'q' and c.side = 'c' and c.slot = q.slot join sized a on a.side = 'q' and a.id = q.id join sized b on b.side = 'c' and b.id = c.id group by q.id, c.id),
ranked as (select s.*, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from scored s where round(score, 9) >= 0.3)
select query_id, round(score, 9) as score, count(*) as n, null as error from ranked join asked using (query_id) where rank <= lim group by all
union all select query_id, null, 1, 'Query too long (' || length(query) || ' chars). Max is 10000.' from asked where length(query) > 10000""")
def _(t):
    """Stored themes searched by part names: how many points each query finds at each score, and the queries refused."""
    root = fresh_dir(t.spark, "collections")
    entities.ensure_collections(t.spark, root)

    def embed(rows):
        return with_vectors(rows, "text", length=64)

    entities.upsert(t.spark, root, "paper_themes", embed(entities.theme_points(t.themes.withColumn("job_id", F.lit("j")))))
    key = F.col("p_partkey")
    asked = t.raw("part").filter(key % 50 == 0).select(
        key.cast("long").alias("query_id"), F.when(key % 400 == 0, F.repeat("p_name", F.lit(2000))).otherwise(F.col("p_name")).alias("query"),
        F.when(key % 3 == 0, 0).when(key % 3 == 1, 500).alias("limit"))
    found, refused = jobs.search_corpus(t.spark, root, "paper_themes", asked, embed)
    counted = found.groupBy("query_id", F.round("score", 9).alias("score")).agg(F.count(F.lit(1)).alias("n")).withColumn("error", F.lit(None).cast("string"))
    return counted.unionByName(refused.select("query_id", F.lit(None).cast("double").alias("score"), F.lit(1).cast("long").alias("n"), "error"))


# theme deduplication, end to end ------------------------------------------------------------------------

def spread(own, near, pos="pos"):
    """SQL: one more step of the labels of ``own`` over ``near(job_id, a, b)``."""
    return f"""select s.job_id, case when n.a = s.{pos} then n.b else n.a end, s.label from {own} s join {near} n on n.job_id = s.job_id and (n.a = s.{pos} or n.b = s.{pos})"""


DEDUP_SQL = f"""
with recursive near as (select job_id, a, b from vec_pairs where cosine >= {LOW} or (shared and cosine >= {LOWER})),
spread(job_id, pos, label) as (select job_id, pos, pos from jobs2 union {spread("spread", "near")}),
labels as (select job_id, pos, min(label) as component from spread group by job_id, pos),
sized as (select *, count(*) over (partition by job_id, component) as n from labels),
big as (select s.*, v.vec from sized s join jobs2 v using (job_id, pos) where n > 20),
dims as (select job_id, component, d, avg(x) as x from (select job_id, component, unnest(vec) as x, generate_subscripts(vec, 1) as d from big) group by all),
mid as (select job_id, component, list(x order by d) as centre from dims group by all),
ranked as (select b.job_id, b.pos, b.component, b.n, row_number() over (partition by b.job_id, b.component
  order by list_cosine_similarity(b.vec, m.centre) desc, b.pos) - 1 as rank from big b join mid m using (job_id, component)),
bucketed as (select job_id, pos, component, 0::bigint as sub from sized where n <= 20
  union all select job_id, pos, component, rank % cast(ceil(n / 20.0) as bigint) from ranked),
grouped as (select job_id, component, sub, pos % 3 as group_no, list(pos order by pos) as sources, min(pos) as first from bucketed group by all),
canon as (select g.*, v.vec, row_number() over (partition by g.job_id order by component, sub, group_no) - 1 as cpos from grouped g join jobs2 v on v.job_id = g.job_id and v.pos = g.first),
near2 as (select a.job_id, a.cpos as a, b.cpos as b from canon a join canon b on a.job_id = b.job_id and a.cpos < b.cpos where list_cosine_similarity(a.vec, b.vec) >= {LOW}),
spread2(job_id, cpos, label) as (select job_id, cpos, cpos from canon union {spread("spread2", "near2", "cpos")}),
labels2 as (select job_id, cpos, min(label) as component from spread2 group by job_id, cpos)
select l.job_id, 'group ' || arg_min(c.group_no, c.cpos) as name, arg_min(c.first, c.cpos)::varchar as description, count(*) as n,
  md5(string_agg(array_to_string(c.sources, ','), ',' order by c.cpos)) as sources, sum(len(c.sources))::bigint as n_sources
from labels2 l join canon c on c.job_id = l.job_id and c.cpos = l.cpos group by l.job_id, l.component"""


@query("dedup_themes", "vec_pairs", "jobs2", sql=DEDUP_SQL)
def _(t):
    """Themes to canonical themes, end to end: the grouping model puts every third theme of a bucket together, and a group has the
    vector of its first theme."""
    vectors = tagged(t)
    pos = F.col("pos")
    found = vectors.select("job_id", "pos", pos.cast("string").alias("theme_id"), F.concat(F.lit("t"), pos.cast("string")).alias("name"),
                           F.lit("d").alias("description"), (pos % 5).cast("string").alias("paper_id"))

    def group(placed):
        own = placed.groupBy("bucket", (pos % 3).alias("group_no")).agg(F.array_sort(F.collect_list("idx")).alias("member_indices"), F.min("pos").alias("first"))
        return own.select("bucket", "group_no", F.concat(F.lit("group "), F.col("group_no").cast("string")).alias("canonical_name"),
                          F.col("first").cast("string").alias("description"), "member_indices")

    def embed(canonical):
        return canonical.join(vectors.select("job_id", pos.cast("string").alias("description"), "vec"), ["job_id", "description"])

    none = t.spark.createDataFrame([], "a string, b string, contradiction double")
    done = jobs.dedup_themes(found, vectors, group, embed, none, threshold=LOW, shared=LOWER, reconcile=LOW)
    # members of one group are at most a bucket; lists of a merged theme are cut by group before they are joined
    source = done.members.filter("kind = 'source'").groupBy("job_id", "canonical_id").agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", "value"))), lambda s: s["value"]), ",")).alias("sources"))
    return done.themes.join(source, ["job_id", "canonical_id"]).select("job_id", "name", "description", "n", "sources", "n_sources")
