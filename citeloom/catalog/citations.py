"""Citation queries over line items (claims), parts (themes) and suppliers (papers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog.registry import query
from citeloom.operators import citations as ops



def supplier_papers(t):
    """Suppliers as the cited papers; every third one has another key, so that its citations find no paper."""
    key = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")).otherwise(-F.col("s_suppkey") - 1)
    nations = t.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t.raw("supplier").join(nations, "s_nationkey", "left").select(
        key.cast("string").alias("paper_id"), F.col("s_name").alias("title"),
        F.array("n_name").alias("authors"))


SUPPLIER_PAPERS = """(select s_suppkey::varchar as paper_id, s_name as title, [n_name] as authors
 from supplier left join nation on s_nationkey = n_nationkey where s_suppkey % 3 <> 0)"""


def sections(t):
    return t.sections.withColumn("section_pos", F.col("review_pos"))


def numbers(name):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",")


@query("assign_ref_numbers", "refs", sql="select job_id, claim_id, ref_number from refs")
def _(t):
    return ops.assign_ref_numbers(t.key_claims)


@query("merge_citations", "citations", sql="select job_id, ref_number, claim_id, paper_id from citations")
def _(t):
    return ops.merge_citations(t.section_citations)


@query("citation_positions", "citations", "claims", sql=f"""
select job_id, ref_number, claim_id, c.paper_id, coalesce(p.title, '') as paper_title,
       coalesce(k.page, 0) as page, coalesce(k.paragraph, 0) as paragraph
from citations c left join claims k using (job_id, claim_id)
left join {SUPPLIER_PAPERS} p on p.paper_id = c.paper_id""")
def _(t):
    return ops.position_lookup(t.citations, t.claims, supplier_papers(t))


@query("orphan_refs", "sections", "citations", sql=r"""
with found as (select distinct job_id, review_pos, theme_id,
                      unnest(regexp_extract_all(content, '\[(\d+)\]', 1))::bigint as ref_number from sections)
select job_id, theme_id, string_agg(ref_number::varchar, ',' order by ref_number) as missing
from found f where not exists (select 1 from citations c where c.job_id = f.job_id and c.ref_number = f.ref_number)
group by job_id, theme_id""")
def _(t):
    found = ops.orphan_refs(sections(t), t.citations)
    return found.select("job_id", "theme_id", numbers("missing").alias("missing"))


@query("strip_invalid_citations", "sections", "citations", "claims", sql="""
with valid as (select c.job_id, c.ref_number from citations c semi join claims k
               on c.job_id = k.job_id and c.claim_id = k.claim_id),
cited as (select job_id, review_pos, unnest(citation_refs) as ref_number,
                generate_subscripts(citation_refs, 1) as k_at from sections)
select s.job_id, s.theme_id,
       coalesce((select string_agg(r.ref_number::varchar, ',' order by r.k_at) from cited r
                 where r.job_id = s.job_id and r.review_pos = s.review_pos
                   and exists (select 1 from valid v where v.job_id = r.job_id and v.ref_number = r.ref_number)),
                '') as citation_refs
from sections s""")
def _(t):
    kept, _valid = ops.strip_invalid_citations(sections(t), t.citations, t.claims)
    return kept.select("job_id", "theme_id", numbers("citation_refs").alias("citation_refs"))


@query("citation_integrity", "sections", "citations", "claims", sql="""
with cited as (select job_id, review_pos, unnest(citation_refs) as ref_number,
                generate_subscripts(citation_refs, 1) - 1 as k_at from sections)
select job_id, 'sections.' || review_pos || '.citation_refs.' || k_at as path,
       'citation_refs contains [' || ref_number || '], which has no matching citations[].ref_number' as reason
from cited r where not exists (select 1 from citations c where c.job_id = r.job_id and c.ref_number = r.ref_number)
union all
select job_id, 'citations.' || ref_number || '.claim_id',
       'citation claim_id=''' || claim_id || ''' does not exist in the claim registry'
from citations c where not exists (select 1 from claims k where k.job_id = c.job_id and k.claim_id = c.claim_id)""")
def _(t):
    return ops.citation_integrity(sections(t), t.citations, t.claims)


RESOLVED = r"""
labelled as (select c.job_id, c.ref_number,
  case when k.claim_id is null then '?' else 'p.' || k.page || ',§' || k.paragraph end as label
  from citations c left join claims k using (job_id, claim_id)),
pieces as (select job_id, review_pos, theme_id,
  unnest(string_split_regex(content, '\[\d+\]')) as text,
  generate_subscripts(string_split_regex(content, '\[\d+\]'), 1) as k_at,
  regexp_extract_all(content, '\[(\d+)\]', 1) as nums from sections),
linked as (select p.*, try_cast(p.nums[p.k_at] as bigint) as n from pieces p),
glued as (select l.job_id, l.review_pos, l.theme_id,
  string_agg(l.text || coalesce('[' || n || '](cite:' || n || ' "' || x.label || '")', ''), '' order by l.k_at) as content
  from linked l left join labelled x on x.job_id = l.job_id and x.ref_number = l.n group by all)
"""
TIDY = r"regexp_replace(regexp_replace(content, '[ \t]{2,}', ' ', 'g'), '[ \t]+([.,;:])', '\1', 'g')"


@query("resolve_citations", "sections", "citations", "claims",
       sql=f"with {RESOLVED} select job_id, theme_id, {TIDY} as content from glued")
def resolve(t):
    done = ops.resolve_citations(sections(t), t.citations, t.claims)
    return done.select("job_id", "theme_id", "content")


@query("collect_claim_ids", "sections", "citations", sql="""
with cited as (select job_id, review_pos, unnest(citation_refs) as ref_number,
                generate_subscripts(citation_refs, 1) as k_at from sections),
ids as (select r.job_id, r.review_pos, string_agg(c.claim_id, ',' order by r.k_at) as claim_ids
        from cited r join citations c using (job_id, ref_number) group by 1, 2)
select s.job_id, s.theme_id, coalesce(claim_ids, '') as claim_ids from sections s left join ids using (job_id, review_pos)""")
def _(t):
    got = ops.collect_claim_ids(sections(t), t.citations)
    return got.select("job_id", "theme_id", F.array_join("claim_ids", ",").alias("claim_ids"))


@query("build_references", "citations", "claims", sql=f"""
select c.job_id, c.paper_id, coalesce(p.title, '') as paper_title,
       coalesce(p.authors[1], '') as authors,
       min(c.ref_number) over (partition by c.job_id, c.paper_id) as first_ref, c.ref_number,
       coalesce(k.page, 0) as page, coalesce(k.paragraph, 0) as paragraph
from citations c left join claims k using (job_id, claim_id)
left join {SUPPLIER_PAPERS} p on p.paper_id = c.paper_id""")
def _(t):
    refs = ops.build_references(t.citations, t.claims, supplier_papers(t))
    return refs.withColumn("authors", F.array_join("authors", ","))
