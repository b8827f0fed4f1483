"""Queries of the collections, reader views, message texts and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog.citations import SUPPLIER_PAPERS, sections, supplier_papers
from citeloom.catalog.registry import query
from citeloom.catalog.stand_ins import CTES
from citeloom.catalog.themes import buckets
from citeloom.catalog.layout import listed
from citeloom.catalog.verification import reviews
from citeloom.operators import checks, corpus, messages, views

# collections ---------------------------------------------------------------------------------------

PAGE = "(select *, count(*) over () > 200 as truncated from {rows} order by {key} limit 200)"


def named_claims(t):
    names = t.themes.select("theme_id", F.col("name").alias("theme_name"))
    return t.claims.join(names, "theme_id")


@query("get_paper_themes", "themes", sql="select paper_id, name, description, truncated from "
       + PAGE.format(rows="(select * from themes where paper_id = 'Brand#7')", key="theme_id"))
def _(t):
    return corpus.get_paper_themes(t.themes, "Brand#7")


@query("get_claims_by_theme", "claims", "themes", sql="""
select paper_id, theme_id, theme_name, text, page, paragraph, '' as deep, '' as summary, truncated from """ + PAGE.format(
    rows="(select c.*, t.name as theme_name from claims c join themes t using (theme_id) where t.name = 'red widget')", key="claim_id"))
def _(t):
    return corpus.get_claims_by_theme(named_claims(t), "red widget")


@query("get_theme_map", "members", sql="""
select name, description, truncated from """ + PAGE.format(
    rows="(select distinct md5(bucket || '|' || group_no) as canonical_id, canonical_name as name, description from groups)", key="canonical_id"))
def _(t):
    from citeloom.operators.themes import build_theme_map

    return corpus.get_theme_map(build_theme_map(*buckets(t))).select("name", "description", "truncated")


@query("get_theme_review", "reviews", sql="""
select theme_id, 'Theme 42' as label, review, array_to_string(consensus, '|') as consensus, array_to_string(gaps, '|') as gaps
from reviews where theme_id = '42'""")
def _(t):
    labelled = reviews(t).withColumn("label", F.concat(F.lit("Theme "), "theme_id"))
    found = corpus.get_theme_review(labelled, "Theme 42")
    return found.select("theme_id", "label", "review", listed("consensus").alias("consensus"), listed("gaps").alias("gaps"))


@query("get_literature_review", "sections", sql="""
select theme_id, label, content, '' as title, truncated from """ + PAGE.format(rows="(select * from sections where job_id = 'N')", key="theme_id"))
def _(t):
    return corpus.get_literature_review(sections(t).filter("job_id = 'N'")).select("theme_id", "label", "content", "title", "truncated")


@query("scroll", sql="""
select event_id, event_type, truncated from (select event_id, event_type, count(*) over () > 25 as truncated
from events where event_type = 'click' order by event_id limit 25)""")
def _(t):
    return corpus.scroll(t.raw("events"), "event_id", F.col("event_type") == "click", 25).select("event_id", "event_type", "truncated")


@query("collection_payload", "claims", sql="""
select paper_id, theme_id, '' as theme_name, text, page, paragraph, '' as deep, '' as summary from claims""")
def _(t):
    return corpus.payload(t.claims, "paper_claims")


@query("collection_health", sql="""
select name, points, case when points is null then 'not_found' else 'green' end as status from (
 select name, case name when 'paper_themes' then (select count(*) from part) when 'paper_claims' then (select count(*) from lineitem)
   when 'theme_map' then (select count(*) from nation) end as points
 from (select unnest(['paper_themes', 'paper_claims', 'theme_map', 'theme_reviews', 'literature_review']) as name))""".replace(
     "select name, points, case", "select name, coalesce(points, 0) as points, case"))
def _(t):
    return corpus.collection_health(t.spark, {"paper_themes": t.raw("part"), "paper_claims": t.raw("lineitem"), "theme_map": t.raw("nation")})


# totals --------------------------------------------------------------------------------------------

def job_papers(t):
    return t.claims.select("job_id", "paper_id").distinct()


@query("enriched_papers", "claims", "themes", sql="""
with items as (select paper_id, 'claim' as kind, claim_id as item_id, text from claims
  union all select (pos % 100)::varchar, 'theme', theme_id, name from themes)
select s.s_suppkey::varchar as paper_id, s_name as title, kind, item_id, text from supplier s left join items i on i.paper_id = s.s_suppkey::varchar""")
def _(t):
    papers = t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("paper_id"), F.col("s_name").alias("title"))
    themes = t.themes.withColumn("paper_id", (F.col("pos") % 100).cast("string"))
    return corpus.enriched_papers(papers, themes, t.claims)


@query("review_stats", "claims", sql="""
select job_id, count(distinct paper_id) as papers, count(distinct theme_id) as themes, count(*) as claims from claims group by job_id""")
def _(t):
    return corpus.review_stats(job_papers(t), t.claims, t.claims)


@query("corpus_counts", "claims", "sections", sql="""
select job_id, count(distinct paper_id) as paper_count, count(distinct theme_id) as theme_count, count(*) as claim_count,
  (select count(*) from sections s where s.job_id = c.job_id) as section_count from claims c group by job_id""")
def counts(t):
    themes = t.claims.select("job_id", "theme_id").distinct()
    return corpus.corpus_counts(job_papers(t), themes, t.claims, sections(t))


@query("claims_per_paper", "claims", sql="""
select theme_id, paper_id, count(*) as paper_claims, min(pos) as first_pos,
  count(*) over (partition by theme_id) as papers, cast(sum(count(*)) over (partition by theme_id) as bigint) as claims
from claims group by theme_id, paper_id""")
def _(t):
    return corpus.claims_per_paper(t.claims)


CTES["chunk_runs"] = (("paragraphs",), """
select job_id, paper_id, page as chunk, bool_or(length(text) % 2 = 0) as failed from paragraphs group by all""")


def chunk_runs(t):
    return t.paragraphs.groupBy("job_id", "paper_id", F.col("page").alias("chunk")).agg(
        F.bool_or(F.length("text") % 2 == 0).alias("failed"))


@query("failed_papers", "chunk_runs", sql="""
select job_id, paper_id, bool_and(failed) as paper_failed, count(*) filter (where failed) as failed_chunks, count(*) as chunks
from chunk_runs group by job_id, paper_id""")
def _(t):
    return corpus.failure_policy(chunk_runs(t))[0]


@query("failed_stages", "chunk_runs", sql="""
select job_id, count(*) filter (where not f) as successful, count(*) filter (where f) as failed, bool_and(f) as stage_failed
from (select job_id, paper_id, bool_and(failed) as f from chunk_runs group by all) group by job_id""")
def _(t):
    return corpus.failure_policy(chunk_runs(t))[1]


@query("load_chunks", "paragraphs", "papers", sql="""
select p.paper_id, coalesce(c.chunk, 0) as chunk, coalesce(c.content, '') as content from papers p left join (
 select paper_id, page as chunk, string_agg(text, '/' order by i) as content from paragraphs where paper_id % 2 = 0 group by paper_id, page
 union all select paper_id, 0, title from papers where paper_id % 2 = 1 and paper_id % 5 <> 0) c using (paper_id)""")
def _(t):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"])
    even = F.when(F.col("paper_id") % 2 == 0, F.col("paper_id")).otherwise(-F.col("paper_id") - 1)
    chunks = t.paragraphs.withColumn("paper_id", even).groupBy("paper_id", F.col("page").alias("chunk")).agg(F.array_join(rows, "/").alias("content"))
    known = F.when((F.col("paper_id") % 5 != 0) | (F.col("paper_id") % 2 == 0), F.col("paper_id")).otherwise(-F.col("paper_id") - 1)
    whole = t.papers.select(known.alias("paper_id"), F.col("title").alias("content"))
    return corpus.load_chunks(t.papers, chunks, whole)


# reader views --------------------------------------------------------------------------------------

@query("cited_in", "citations", "sections", sql="""
select c.job_id, c.ref_number, c.claim_id, s.review_pos as section_pos, s.label from citations c
left join (select job_id, review_pos, label, unnest(list_distinct(citation_refs)) as ref_number from sections) s using (job_id, ref_number)""")
def _(t):
    return views.cited_in(t.citations, sections(t))


@query("review_reader", "citations", "claims", sql=f"""
select c.job_id, c.ref_number as index, c.claim_id,
  case when p.paper_id is null then 'Paper ' || c.paper_id when p.paper_id::bigint % 2 = 0 then 'Paper ' || c.paper_id else p.title end as title,
  coalesce(p.authors[1], '') as authors,
  case when coalesce(k.page, 0) > 0 then 'p.' || k.page || ', §' || coalesce(k.paragraph, 0) else '' end as position,
  case when k.paragraph % 2 = 0 then 'short ' || c.claim_id else coalesce(k.text, '') end as text,
  coalesce(k.page, 0) as page, coalesce(k.paragraph, 0) as paragraph
from citations c left join claims k using (job_id, claim_id) left join {SUPPLIER_PAPERS} p on p.paper_id = c.paper_id""")
def _(t):
    cited = t.citations.withColumn(
        "paper_title", F.concat(F.lit("Paper "), "paper_id")).withColumn("page", F.lit(None).cast("int")).withColumn("paragraph", F.lit(None).cast("int"))
    odd = F.when(F.col("paper_id").cast("long") % 2 != 0, F.col("title"))
    papers = supplier_papers(t).withColumn("filename", F.lit("f.pdf")).withColumn("title", odd)
    claims = t.claims.withColumn("summary", F.when(F.col("paragraph") % 2 == 0, F.concat(F.lit("short "), "claim_id")))
    return views.review_reader(cited, papers, claims)


@query("reference_fallback", "citations", "sections", sql="""
with needed as (select * from citations where job_id <> 'A'),
papers as (select job_id, paper_id, row_number() over (partition by job_id order by min(ref_number), paper_id) as index from needed group by job_id, paper_id),
cites as (select job_id, label, unnest(citation_refs) as ref_number from sections),
labels as (select distinct n.job_id, n.paper_id, r.label from needed n join cites r using (job_id, ref_number))
select p.job_id, p.index, p.paper_id, 'Paper ' || p.paper_id as title, l.label from papers p left join labels l using (job_id, paper_id)""")
def _(t):
    merged = t.citations
    firsts = merged.groupBy("job_id", "paper_id").agg(F.min("ref_number").alias("first_ref"))
    references = merged.join(firsts, ["job_id", "paper_id"]).withColumn("paper_title", F.concat(F.lit("Paper "), "paper_id"))
    return views.reference_fallback(references, merged.filter("job_id = 'A'"), sections(t))


def heads(t):
    jobs = t.claims.select("job_id").distinct()
    return jobs.select("job_id", F.concat(F.lit("Review "), "job_id").alias("title"), F.concat(F.lit("About "), "job_id").alias("abstract"))


TEXT = """
with heads as (select distinct job_id from claims)
select job_id, cast(-1 as bigint) as part, md5({first}) as text from heads
union all select job_id, review_pos // 1000, md5(string_agg('## ' || label || {gap} || content, chr(10) || chr(10) order by review_pos)) from sections group by 1, 2"""


@query("review_text", "claims", "sections", sql=TEXT.format(
    first="'# Review ' || job_id || chr(10) || chr(10) || 'About ' || job_id", gap="chr(10)"))
def _(t):
    return views.review_text(heads(t), sections(t)).withColumn("text", F.md5("text"))


@query("review_markdown", "claims", "sections", sql=TEXT.format(first="'*About ' || job_id || '*'", gap="chr(10) || chr(10)"))
def _(t):
    return views.review_markdown(heads(t), sections(t)).withColumn("text", F.md5("text"))


@query("theme_colours", "claims", sql="""
select job_id, theme_id, min(pos) as pos, row_number() over (partition by job_id order by min(pos)) - 1 as colour_index from claims group by job_id, theme_id""")
def _(t):
    return views.theme_colours(t.claims)


# message texts ---------------------------------------------------------------------------------------

CTES["batched_kc"] = (("key_claims", "refs"), """
select k.job_id, k.review_pos // 5 as batch, k.review_pos % 5 as slot, k.kc_pos, r.ref_number, k.claim_id, k.paper_id, 's' || k.claim_id as summary
from key_claims k join refs r using (job_id, claim_id)""")
CTES["batched_reviews"] = (("key_claims",), """
select distinct job_id, review_pos // 5 as batch, review_pos % 5 as slot, review_pos from key_claims""")


@query("section_message", "batched_kc", "batched_reviews", "reviews", "claims", sql="""
with full_reviews as (select b.*, coalesce(r.review, '') as review, coalesce(r.consensus, []) as consensus, coalesce(r.gaps, []) as gaps
  from batched_reviews b left join reviews r on r.theme_id = b.review_pos::varchar),
body as (select job_id, batch, slot, ['--- THEME ' || (slot + 1) || ': ' || case when review_pos % 13 = 0 then 'Theme ' || (slot + 1) else 'T' || review_pos end || ' ---', '']
   || case when review <> '' then ['SYNTHESIS: ' || review, ''] else [] end
   || case when len(consensus) > 0 then ['CONSENSUS:'] || list_transform(consensus, lambda x: '  - ' || x) || [''] else [] end
   || case when len(gaps) > 0 then ['GAPS:'] || list_transform(gaps, lambda x: '  - ' || x) || [''] else [] end as ls from full_reviews),
batches as (select distinct job_id, batch from batched_reviews)
select job_id, batch, 0 as part, 0 as a, 0 as b, k as c, case k when 0 then '=== THEME REVIEWS ===' else '' end as line from batches, (select unnest([0, 1]) as k)
union all select job_id, batch, 1, slot, 0, generate_subscripts(ls, 1) - 1, unnest(ls) from body
union all select distinct job_id, batch, 1, slot, 1, 0, 'KEY CLAIMS:' from batched_kc
union all select k.job_id, k.batch, 1, k.slot, 2, k.kc_pos, '  [' || k.ref_number || '] ' || case when k.ref_number % 9 = 4 then '' else k.summary end || ' (paper: ' || case when k.ref_number % 7 = 3 then '' else k.paper_id end || ', p.' || coalesce(c.page::varchar, '?') || ',§' || coalesce(c.paragraph::varchar, '?') || ')'
  from batched_kc k left join claims c using (job_id, claim_id)
union all select distinct job_id, batch, 1, slot, 3, 0, '' from batched_kc
union all select job_id, batch, 1, slot, 4, 0, '' from batched_reviews
union all select job_id, batch, 2, 0, 0, k, case k when 0 then '=== CLAIM REGISTRY ===' when 1 then 'Use these [N] numbers for inline citations in your response.' else '' end from batches, (select unnest([0, 1, 2]) as k)
union all select distinct job_id, batch, 3, ref_number, 0, 0, '  [' || ref_number || '] claim_id=' || claim_id || ' paper_id=' || case when ref_number % 7 = 3 then '' else paper_id end from batched_kc""".replace(
    "0 as part, 0 as a, 0 as b, k as c", "cast(0 as bigint) as part, cast(0 as bigint) as a, cast(0 as bigint) as b, cast(k as bigint) as c"))
def _(t):
    kc = t.numbered.select(
        "job_id", F.floor(F.col("review_pos") / 5).alias("batch"), (F.col("review_pos") % 5).alias("at"), "kc_pos", "ref_number",
        "claim_id", F.when(F.col("ref_number") % 7 != 3, F.col("paper_id")).alias("paper_id"),
        F.when(F.col("ref_number") % 9 != 4, F.concat(F.lit("s"), "claim_id")).alias("summary"))
    told = reviews(t).withColumn("review_pos", F.col("theme_id").cast("long"))
    none = F.array().cast("array<string>")
    rows = t.key_claims.select("job_id", "review_pos").distinct().join(told, "review_pos", "left").select(
        "job_id", F.floor(F.col("review_pos") / 5).alias("batch"), (F.col("review_pos") % 5).alias("at"),
        F.when(F.col("review_pos") % 13 != 0, F.concat(F.lit("T"), F.col("review_pos").cast("string"))).alias("label"), F.coalesce("review", F.lit("")).alias("review"),
        F.coalesce("consensus", none).alias("consensus"), none.alias("disagreements"), F.coalesce("gaps", none).alias("gaps"))
    return messages.section_message(rows, kc, t.claims)


@query("theme_message", "claims", "themes", sql="""
with batched as (select '' as job_id, pos // 5 as batch, pos % 5 as slot, theme_id, case when pos % 7 = 2 then 'Unknown' else name end as name, name as alias, description from themes),
told as (select theme_id, pos, claim_id, case when pos % 11 = 5 then 'unknown' else paper_id end as paper_id, paragraph,
  case when pos % 6 = 1 then '?' else page::varchar end as shown_page, case when pos % 10 = 3 then '?' else paragraph::varchar end as shown_paragraph,
  case when pos % 4 = 1 then 'short ' || claim_id when pos % 13 = 0 then '' else text end as shown from claims),
papers as (select theme_id, paper_id, min(pos) as first, count(*) as m from told group by all),
totals as (select theme_id, count(*) as papers, sum(m) as claims from papers group by theme_id),
opened as (select b.*, ['<theme id="' || theme_id || '" name="' || name || '">', 'DESCRIPTION: ' || description]
  || case when slot % 2 = 0 then ['ALIASES: ' || alias || ', x'] else [] end
  || ['PAPERS: ' || coalesce(papers, 0) || ' paper(s), ' || coalesce(claims, 0) || ' claims', ''] as ls from batched b left join totals using (theme_id))
select job_id, batch, cast(0 as bigint) as part, cast(0 as bigint) as a, cast(0 as bigint) as b, cast(k as bigint) as c,
  case k when 0 then 'Analyze the following ' || n || ' themes:' else '' end as line
  from (select job_id, batch, count(*) as n from batched group by all), (select unnest([0, 1]) as k)
union all select job_id, batch, 1, slot * 3, 0, generate_subscripts(ls, 1) - 1, unnest(ls) from opened
union all select job_id, batch, 1, slot * 3 + 1, first, -1, '  Paper: ' || paper_id from papers join batched using (theme_id)
union all select job_id, batch, 1, slot * 3 + 1, first, 4611686018427387904, '' from papers join batched using (theme_id)
union all select batched.job_id, batched.batch, 1, slot * 3 + 1, first, c.pos * 2, '  <claim id="' || claim_id || '" paper="' || paper_id || '" page="' || shown_page || '" paragraph="' || shown_paragraph || '">' || shown || '</claim>'
  from told c join papers using (theme_id, paper_id) join batched using (theme_id)
union all select batched.job_id, batched.batch, 1, slot * 3 + 1, first, c.pos * 2 + 1, '      Context: excerpt of ' || claim_id
  from told c join papers using (theme_id, paper_id) join batched using (theme_id) where paragraph % 2 = 0
union all select job_id, batch, 1, slot * 3 + 2, 0, k, case k when 0 then '</theme>' else '' end from batched, (select unnest([0, 1]) as k)""")
def _(t):
    """Themes without a name; claims without paper, page, paragraph or text, some with a summary."""
    alias = F.when(F.col("pos") % 5 % 2 == 0, F.array(F.col("name"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    themes = t.themes.select(F.lit("").alias("job_id"), F.floor(F.col("pos") / 5).alias("batch"), (F.col("pos") % 5).alias("at"),
                             F.col("theme_id").alias("canonical_id"), F.when(F.col("pos") % 7 != 2, F.col("name")).alias("name"), "description", alias.alias("aliases"))
    pos = F.col("pos")
    told = t.claims.withColumns({
        "deep": F.when(F.col("paragraph") % 2 == 0, F.concat(F.lit("excerpt of "), "claim_id")),
        "summary": F.when(pos % 4 == 1, F.concat(F.lit("short "), "claim_id")), "paper_id": F.when(pos % 11 != 5, F.col("paper_id")),
        "page": F.when(pos % 6 != 1, F.col("page")), "paragraph": F.when(pos % 10 != 3, F.col("paragraph")), "text": F.when(pos % 13 != 0, F.col("text"))})
    return messages.theme_message(themes, told.withColumnRenamed("theme_id", "canonical_id"))


@query("title_abstract_message", "sections", sql="""
select distinct job_id, cast(0 as bigint) as batch, cast(0 as bigint) as part, cast(0 as bigint) as a, cast(0 as bigint) as b, cast(k as bigint) as c,
  case k when 0 then '=== SECTIONS ===' else '' end as line from sections, (select unnest([0, 1]) as k)
union all select job_id, 0, 1, review_pos, 0, k, case k when 0 then '--- ' || case when review_pos % 13 = 0 then '' else label end || ' ---' when 1 then content else '' end
  from sections, (select unnest([0, 1, 2]) as k)""")
def _(t):
    label = F.when(F.col("review_pos") % 13 != 0, F.col("label"))
    return messages.title_abstract_message(t.sections.withColumn("section_pos", F.col("review_pos")).withColumn("label", label))


# checks ----------------------------------------------------------------------------------------------

@query("check_non_empty", "paragraphs", "papers", sql="""
select 'paragraph' as table_name, paper_id || '/' || i as key, 'text is empty' as rule from paragraphs where length(text) = 0 or length(text) % 50 = 1
union all select 'paper', paper_id::varchar, 'title is empty' from papers where title = '' or paper_id % 9 = 0
union all select 'paper', paper_id::varchar, 'authors is empty' from papers where paper_id % 7 = 0""")
def _(t):
    lines = t.paragraphs.select(F.concat_ws("/", F.col("paper_id").cast("string"), F.col("i").cast("string")).alias("key"),
                                F.when(F.length("text") % 50 != 1, F.col("text")).alias("text"))
    papers = t.papers.withColumn("title", F.when(F.col("paper_id") % 9 != 0, F.col("title"))).withColumn(
        "authors", F.when(F.col("paper_id") % 7 != 0, F.col("authors")).otherwise(F.array().cast("array<string>")))
    return checks.all_of(checks.non_empty(lines, "paragraph", "key", ["text"]),
                         checks.non_empty(papers, "paper", "paper_id", ["title", "authors"]))


@query("check_group_membership", "groups", "bucketed", sql="""
with listed as (select bucket, unnest(member_indices) as idx from groups where group_no <> 2 union all select bucket, unnest(member_indices) from groups where group_no = 1)
select b.bucket, b.idx, count(l.idx) as n from bucketed b left join listed l on l.bucket = b.bucket and l.idx = b.idx group by b.bucket, b.idx having count(l.idx) <> 1""")
def _(t):
    groups, themes = buckets(t)
    return checks.group_membership(groups.filter("group_no <> 2").unionByName(groups.filter("group_no = 1")), themes)


@query("check_acceptance", "claims", "sections", sql="""
with n as (select job_id, count(distinct paper_id) as papers, count(distinct theme_id) as themes, count(*) as claims,
  (select count(*) from sections s where s.job_id = c.job_id) as sections from claims c group by job_id)
select job_id, unnest(list_filter([
  case when papers <> 7 then 'expected 7 papers, got ' || papers end,
  case when themes < 10 then 'expected >= 10 themes, got ' || themes end,
  case when claims < 1000000000 then 'expected >= 1000000000 claims, got ' || claims end,
  case when sections < 5 then 'expected >= 5 sections, got ' || sections end], lambda x: x is not null)) as failure from n""")
def _(t):
    expected = t.claims.select("job_id").distinct().select(
        "job_id", F.lit(7).alias("expect_paper_count"), F.lit(10).alias("expect_theme_count_min"),
        F.lit(1000000000).alias("expect_claim_count_min"), F.lit(5).alias("expect_review_sections_min"), F.lit(True).alias("expect_review_has_citations"))
    cited = sections(t).groupBy("job_id").agg(F.bool_or(checks.has_citation(F.col("content"))).alias("has_citations"))
    return checks.acceptance(counts(t), expected, cited)


@query("check_chat", sql="""
select conv_id || '/' || turn as case_id, unnest(list_filter([
  case when not contains(lower(text), 'the') then 'expected response to contain ''The''' end,
  case when contains(lower(text), 'tion') then 'response should not contain ''tion''' end,
  case when turn < 2 then 'expected >= 2 steps, got ' || turn end,
  case when role <> 'user' then 'expected tool ''user'' not called' end], lambda x: x is not null)) as failure from conversations""")
def _(t):
    cases = t.turns.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), F.col("text").alias("content"),
        F.col("turn").alias("n_steps"), F.array("role").alias("tools"), F.array(F.lit("The")).alias("expect_contains"),
        F.array(F.lit("tion")).alias("expect_not_contains"), F.lit(2).alias("expect_steps_min"), F.array(F.lit("user")).alias("expect_tools"))
    return checks.chat_expectations(cases)


@query("check_message_limits", sql="""
select doc_id, reason from (select doc_id, case when length(trim(text, ' ' || chr(10) || chr(9))) = 0 then 'Message cannot be empty'
  when length(trim(text, ' ' || chr(10) || chr(9))) > 10000 then 'Message too long (max 10000 characters)' end as reason from documents) where reason is not null""")
def _(t):
    return checks.message_limits(t.documents).select("doc_id", "reason")


@query("check_label_domain", "log", sql="""
select 'event' as table_name, event_id as key, 'event_type outside event_type: ' || kind as rule
from (select event_id, case when seq % 40 = 0 then 'odd' else event_type end as kind from log) where kind = 'odd'""")
def _(t):
    odd = F.when(F.col("seq") % 40 == 0, F.lit("odd")).otherwise(F.col("event_type"))
    return checks.label_domain(t.events.withColumn("event_type", odd), "event", "event_id", "event_type", "event_type")
