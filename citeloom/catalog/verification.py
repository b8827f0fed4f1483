"""Grounding, gate and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog.layout import EMAIL, PHONE, PLACES, contents, listed, place_terms, placed_texts
from citeloom.catalog.registry import query
from citeloom.catalog.stand_ins import CTES
from citeloom.operators import evals, gates, grounding

# claims with evidence: a vector and a mixture of it with the next one --------------------------------

CTES["evidence"] = (("vectors",), """
select a.pos as claim_pos, (a.pos % 10)::varchar as theme_id,
  round(list_cosine_similarity(a.vec, list_transform(list_zip(a.vec, b.vec), lambda z: z[1] + z[2] * (a.pos % 3))), 9) as score
from vectors a join vectors b on b.pos = a.pos + 1""")


def evidence(t):
    after = t.vectors.select((F.col("pos") - 1).alias("pos"), F.col("vec").alias("next"))
    mixed = F.zip_with("vec", "next", lambda x, y: x + y * (F.col("pos") % 3))
    both = t.vectors.join(after, "pos").withColumn("deep_vec", mixed)
    return both.select(F.col("pos").alias("claim_pos"), (F.col("pos") % 10).cast("string").alias("theme_id"),
                       F.round(grounding.grounding_score("vec", "deep_vec"), 9).alias("score"))


def label_themes(t):
    return t.themes.select("theme_id")


@query("grounding_score", "evidence", sql="select claim_pos, theme_id, score from evidence")
def _(t):
    return evidence(t)


@query("provenance_kept", "evidence", sql="select claim_pos, theme_id, score from evidence where score >= 0.65")
def _(t):
    return grounding.provenance_filter(label_themes(t), evidence(t))[1]


@query("provenance_themes", "evidence", "themes", sql="""
select t.theme_id, count(e.claim_pos) filter (where e.score >= 0.65) as n_claims
from themes t left join evidence e using (theme_id) group by t.theme_id""")
def _(t):
    return grounding.provenance_filter(label_themes(t), evidence(t))[0]


CTES["reviews"] = ((), """
select p_partkey::varchar as theme_id, p_size as size,
  'The ' || p_name || ' is of type ' || p_type || '. It has size ' || p_size || '! Was it made by ' || p_brand || '? Ask ' || p_brand || '@mail.org now.' as review,
  [p_name || ' agrees', 'mail x' || p_partkey || '@lab.org on ' || p_type, p_type || ' holds'] as consensus,
  [p_brand || ' differs'] as disagreements, ['gap ' || p_size] as gaps from part""")


def reviews(t):
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("The "), name, F.lit(" is of type "), kind, F.lit(". It has size "), size, F.lit("! Was it made by "),
                    brand, F.lit("? Ask "), brand, F.lit("@mail.org now."))
    return t.raw("part").select(
        key.alias("theme_id"), F.col("p_size").alias("size"), text.alias("review"),
        F.array(F.concat(name, F.lit(" agrees")), F.concat(F.lit("mail x"), key, F.lit("@lab.org on "), kind),
                F.concat(kind, F.lit(" holds"))).alias("consensus"),
        F.array(F.concat(brand, F.lit(" differs"))).alias("disagreements"), F.array(F.concat(F.lit("gap "), size)).alias("gaps"))


@query("sentence_claim_pairs", "reviews", "claims", sql=r"""
with split as (select theme_id, string_split(regexp_replace(review, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as ss from reviews),
sentences as (select theme_id, unnest(ss) as sentence, cast(generate_subscripts(ss, 1) - 1 as integer) as sentence_pos from split)
select c.claim_id, sentence_pos, sentence from claims c join sentences s using (theme_id)""")
def _(t):
    return grounding.sentence_claim_pairs(reviews(t), t.claims).select("claim_id", "sentence_pos", "sentence")


CTES["verdicts"] = (("pair_scores",), """
select sentence_pos, verdict, case when verdict = 'contradicted' then c.claim_id else e.claim_id end as best_claim_id,
  case when verdict = 'contradicted' then c.contradiction else e.contradiction end as contradiction,
  case when verdict = 'contradicted' then c.entailment else e.entailment end as entailment,
  case when verdict = 'contradicted' then c.neutral else e.neutral end as neutral
from (select sentence_pos, e, c, case when e.entailment >= 0.7 then 'grounded' when c.contradiction >= 0.7 then 'contradicted' else 'borderline' end as verdict
      from (select sentence_pos,
              arg_max({'claim_id': claim_id, 'contradiction': contradiction, 'entailment': entailment, 'neutral': neutral}, (entailment, -claim_pos)) as e,
              arg_max({'claim_id': claim_id, 'contradiction': contradiction, 'entailment': entailment, 'neutral': neutral}, (contradiction, -claim_pos)) as c
            from pair_scores group by sentence_pos))""")


def verdicts(t):
    return grounding.grounding_verdict(t.pair_scores, ["sentence_pos"])


@query("grounding_verdict", "verdicts", sql="select *, 'deberta' as resolved_by from verdicts")
def _(t):
    return verdicts(t)


CTES["texts_judged"] = (("verdicts",), """
select sentence_pos, (sentence_pos % 100)::varchar as theme_id, 'Sentence ' || (sentence_pos % 3000) as sentence, verdict, 'deberta' as resolved_by from verdicts""")
CTES["resolved"] = (("texts_judged",), """
select j.sentence_pos, j.theme_id, j.sentence,
  case when d.label = 'ENTAILED' then 'grounded' when d.label is not null then 'contradicted' else j.verdict end as verdict,
  case when d.label is not null then 'llm_as_nli' else j.resolved_by end as resolved_by
from texts_judged j left join (
  select theme_id, sentence, max(label) as label
  from (select (o_orderkey % 100)::varchar as theme_id, 'Sentence ' || (o_orderkey % 3000) as sentence,
               case o_orderstatus when 'F' then 'ENTAILED' when 'O' then 'CONTRADICTED' else 'NEUTRAL' end as label
        from orders where o_orderkey % 2 = 0)
  where (theme_id, sentence) in (select theme_id, sentence from texts_judged where verdict = 'borderline')
  group by theme_id, sentence) d using (theme_id, sentence)""")


def resolved(t):
    judged = verdicts(t).select(
        "sentence_pos", (F.col("sentence_pos") % 100).cast("string").alias("theme_id"),
        F.concat(F.lit("Sentence "), (F.col("sentence_pos") % 3000).cast("string")).alias("sentence"), "verdict", "resolved_by")
    status = F.when(F.col("o_orderstatus") == "F", "ENTAILED").when(F.col("o_orderstatus") == "O", "CONTRADICTED").otherwise("NEUTRAL")
    labels = t.raw("orders").select(  # of every other order a label for a theme that is not there
        F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 100).cast("string")).otherwise("none").alias("theme_id"),
        F.concat(F.lit("Sentence "), (F.col("o_orderkey") % 3000).cast("string")).alias("sentence"), status.alias("label"))
    return grounding.resolve_borderline(judged, labels)


@query("resolve_borderline", "resolved", sql="select sentence_pos, theme_id, sentence, verdict, resolved_by from resolved")
def _(t):
    return resolved(t).select("sentence_pos", "theme_id", "sentence", "verdict", "resolved_by")


@query("verify_sections", "reviews", "claims", sql="""
with evidenced as (select distinct theme_id from claims where theme_pos % 5 <> 0),
items as (select theme_id, 'CONSENSUS' as kind, unnest(consensus) as entry, generate_subscripts(consensus, 1) - 1 as k from reviews
          union all select theme_id, 'DISAGREEMENT', unnest(disagreements), generate_subscripts(disagreements, 1) - 1 from reviews),
checked as (select i.*, e.theme_id is null or (i.theme_id::bigint + k) % 3 = 0 as holds from items i left join evidenced e using (theme_id)),
lists as (select theme_id, string_agg(entry, '|' order by k) filter (where holds and kind = 'CONSENSUS') as consensus,
   string_agg(entry, '|' order by k) filter (where holds and kind = 'DISAGREEMENT') as disagreements,
   string_agg('Not verified as ' || lower(kind) || ': ' || entry, '|' order by kind, k) filter (where not holds) as failed
   from checked group by theme_id)
select r.theme_id, coalesce(l.consensus, '') as consensus, coalesce(l.disagreements, '') as disagreements,
       concat_ws('|', r.gaps[1], l.failed) as gaps from reviews r left join lists l using (theme_id)""")
def _(t):
    rows = reviews(t)
    both = rows.select("theme_id", F.posexplode(F.array(F.lit("CONSENSUS"), F.lit("DISAGREEMENT"))).alias("n", "kind"), "consensus", "disagreements")
    items = both.select("theme_id", "kind", F.posexplode(F.when(F.col("n") == 0, F.col("consensus")).otherwise(F.col("disagreements"))).alias("at", "entry"))
    labels = items.select("theme_id", "kind", "at", F.when((F.col("theme_id").cast("long") + F.col("at")) % 3 == 0, F.col("kind")).otherwise("NEITHER").alias("label"))
    done = grounding.verify_sections(rows, labels, t.claims.withColumn(
        "theme_id", F.when(F.col("theme_pos") % 5 != 0, F.col("theme_id")).otherwise(F.concat(F.lit("other "), "theme_id"))))
    return done.select("theme_id", *[listed(c).alias(c) for c in ("consensus", "disagreements", "gaps")])


def batch_key_claims(t):
    """Key claims of reviews; every seventh cites a claim of another batch."""
    off = F.when(F.col("review_pos") % 7 == 0, F.concat("claim_id", F.lit("?"))).otherwise(F.col("claim_id"))
    return t.key_claims.select(
        F.concat_ws("/", "job_id", F.floor(F.col("review_pos") / 5).cast("string")).alias("batch"),
        F.concat(F.lit("Theme "), F.col("review_pos").cast("string")).alias("theme_name"), "kc_pos", off.alias("claim_id"))


def batch_claims(t):
    return t.claims.select(F.concat_ws("/", "job_id", F.floor(F.col("theme_pos") / 5).cast("string")).alias("batch"), "claim_id")


CTES["batch_kc"] = (("key_claims",), """
select job_id || '/' || (review_pos // 5) as batch, 'Theme ' || review_pos as theme_name, kc_pos,
       case when review_pos % 7 = 0 then claim_id || '?' else claim_id end as claim_id from key_claims""")
CTES["batch_ids"] = (("claims",), "select distinct job_id || '/' || (theme_pos // 5) as batch, claim_id from claims")


@query("valid_claims", "batch_kc", "batch_ids", sql="""
select batch, theme_name, kc_pos, claim_id from batch_kc semi join batch_ids using (batch, claim_id)""")
def _(t):
    return grounding.valid_claims(batch_key_claims(t), batch_claims(t))[0]


@query("invalid_claims", "batch_kc", "batch_ids", sql="""
select batch, theme_name, kc_pos, claim_id, count(*) over (partition by batch, theme_name) as n_invalid
from batch_kc anti join batch_ids using (batch, claim_id)""")
def _(t):
    return grounding.valid_claims(batch_key_claims(t), batch_claims(t))[1]


# gates: a document is a review, its lines are sections ------------------------------------------------

@query("topic_gate", "papers", "contents", sql="""
select paper_id, case when ok then 'accept' else 'reject' end as verdict, case when not ok then 'quality_or_metadata' end as reason
from (select paper_id, length(content) / page_count >= 50 and paper_id % 9 <> 0 and title <> '' and paper_id % 7 <> 0 as ok
      from papers join contents using (paper_id))""")
def _(t):
    papers = t.papers.withColumn("title", F.when(F.col("paper_id") % 9 == 0, F.lit("")).otherwise(F.col("title"))).withColumn(
        "authors", F.when(F.col("paper_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("authors")))
    return gates.topic_gate(papers.join(contents(t), "paper_id")).select("paper_id", "verdict", "reason")


def gate_inputs(t):
    docs, labels = t.documents, t.raw("labels")
    lines = F.split("text", "\n")
    heads = docs.select(F.col("doc_id").alias("job_id"), F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(lines[0]).alias("title"),
                        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("abstract"))
    sections = t.paragraphs.filter("i >= 2").select(
        F.col("paper_id").alias("job_id"), F.col("i").alias("section_pos"), F.col("i").cast("string").alias("theme_id"),
        F.when(F.col("i") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("L"), F.col("i").cast("string"))).alias("label"),
        F.col("text").alias("content"))
    none = F.lit(None).cast("long")
    combined = labels.select(F.col("doc_id").alias("job_id"), F.lit("combined").alias("field"), none.alias("section_pos"),
                             F.col("toxic").cast("double").alias("score"), (F.col("toxic") == 0).alias("passed"))
    parts = docs.select(F.col("doc_id").alias("job_id"), F.explode(F.array(
        F.struct(F.lit("title").alias("field"), (F.col("doc_id") % 3 != 0).alias("passed")),
        F.struct(F.lit("abstract").alias("field"), (F.col("doc_id") % 4 != 0).alias("passed")))).alias("f")).select(
        "job_id", "f.field", none.alias("section_pos"), F.lit(0.5).alias("score"), "f.passed")
    bodies = sections.select("job_id", F.lit("section").alias("field"), "section_pos", F.lit(0.5).alias("score"),
                             (F.length("content") % 4 != 0).alias("passed"))
    judged = labels.select(F.col("doc_id").alias("job_id"), F.explode(F.array(
        F.struct(F.lit("faithfulness").alias("metric"), (F.lit(0.4) + F.col("quality") * 0.5).alias("score")),
        F.struct(F.lit("citation_accuracy").alias("metric"), (F.lit(0.35) + F.col("doc_id") % 5 * 0.2).alias("score")))).alias("m")).select("job_id", "m.*")
    return heads, sections, combined.unionByName(parts).unionByName(bodies), judged


CTES["toxic"] = (("paragraphs",), """
select d.doc_id as job_id, l.toxic::double as score,
  case when l.toxic = 0 then 'pass' else 'quarantine' end as verdict,
  case when l.toxic is null then 'toxic-gate service unreachable'
       when l.toxic = 1 then coalesce('toxic content detected in: ' || nullif(concat_ws(', ',
         case when d.doc_id % 3 = 0 and d.doc_id % 6 <> 0 and string_split(d.text, chr(10))[1] <> '' then 'title' end,
         case when d.doc_id % 4 = 0 and coalesce(string_split(d.text, chr(10))[2], '') <> '' then 'abstract' end,
         (select string_agg('section ''' || case when i % 3 = 0 then i::varchar else 'L' || i end || '''', ', ' order by i)
          from paragraphs p where p.paper_id = d.doc_id and i >= 2 and text <> '' and length(text) % 4 = 0)), ''), 'toxic content detected') end as reason
from documents d left join labels l using (doc_id)""")
CTES["judge"] = ((), """
select d.doc_id as job_id, l.quality is null as missing, 0.4::double + l.quality * 0.5::double as faithfulness, 0.35::double + d.doc_id % 5 * 0.2::double as citation_accuracy
from documents d left join labels l using (doc_id)""")
JUDGE_REASON = """case when missing then 'judge service unreachable'
  when faithfulness < 0.7 or citation_accuracy < 0.7 then 'judge gate failed rubric item(s): ' || concat_ws(', ',
    case when faithfulness < 0.7 then 'faithfulness' end, case when citation_accuracy < 0.7 then 'citation_accuracy' end) end"""


@query("toxic_gate", "toxic", sql="select job_id, verdict, reason, score from toxic")
def _(t):
    heads, sections, scores, _judged = gate_inputs(t)
    return gates.toxic_gate(heads, sections, scores)


@query("toxic_fields", "paragraphs", sql="""
with failed as (select d.doc_id, string_split(d.text, chr(10)) as lines from documents d join labels l using (doc_id) where l.toxic = 1)
select doc_id as job_id, -2 as "at", 'title' as field from failed where doc_id % 3 = 0 and doc_id % 6 <> 0 and lines[1] <> ''
union all select doc_id, -1, 'abstract' from failed where doc_id % 4 = 0 and coalesce(lines[2], '') <> ''
union all select f.doc_id, i, 'section ' || chr(39) || case when i % 3 = 0 then i::varchar else 'L' || i end || chr(39) from failed f join paragraphs p on p.paper_id = f.doc_id
  where i >= 2 and p.text <> '' and length(p.text) % 4 = 0""")
def _(t):
    heads, sections, scores, _judged = gate_inputs(t)
    return gates.toxic_fields(heads, sections, scores)


@query("judge_gate", "judge", sql=f"""
select job_id, case when reason is null then 'pass' else 'quarantine' end as verdict, reason
from (select job_id, {JUDGE_REASON} as reason from judge)""")
def _(t):
    heads, _sections, _scores, judged = gate_inputs(t)
    return gates.judge_gate(heads, judged)


@query("gate_chain", "toxic", "judge", sql=f"""
select t.job_id, case when t.verdict = 'quarantine' then 'toxic' when j.reason is not null then 'judge' end as gate,
  case when t.verdict = 'quarantine' then t.reason else j.reason end as reason,
  case when t.verdict = 'quarantine' or j.reason is not null then 'quarantined' else 'completed' end as status
from toxic t join (select job_id, {JUDGE_REASON} as reason from judge) j using (job_id)""")
def _(t):
    heads, sections, scores, judged = gate_inputs(t)
    return gates.gate_chain(heads, gates.toxic_gate(heads, sections, scores), judged).select("job_id", "gate", "reason", "status")


CTES["runs"] = ((), """
select doc_id::varchar as case_id, 'Faithful Ness' as metric, case when doc_id % 10 <> 0 then 0.4::double + quality * 0.5::double end as score from labels
union all select doc_id::varchar, 'Citation Accuracy', 0.35::double + doc_id % 5 * 0.2::double from labels""")


def runs(t):
    return t.raw("labels").select(F.col("doc_id").cast("string").alias("case_id"), F.explode(F.array(
        F.struct(F.lit("Faithful Ness").alias("metric"), F.when(F.col("doc_id") % 10 != 0, F.lit(0.4) + F.col("quality") * 0.5).alias("score")),
        F.struct(F.lit("Citation Accuracy").alias("metric"), (F.lit(0.35) + F.col("doc_id") % 5 * 0.2).alias("score")))).alias("m")).select("case_id", "m.*")


@query("score_average", "runs", sql="""
select replace(lower(metric), ' ', '_') as metric, round(avg(score), 9) as score from runs where score is not null group by 1""")
def _(t):
    return evals.score_average(runs(t)).withColumn("score", F.round("score", 9))


@query("regression_gate", "runs", sql="""
with base as (select replace(lower(metric), ' ', '_') as key, avg(score) as baseline from runs group by 1)
select case_id, key as metric, score, score >= baseline * 0.95 as passed
from runs join base on key = replace(lower(metric), ' ', '_') where score is not null""")
def _(t):
    baseline = evals.score_average(runs(t)).withColumnRenamed("score", "baseline")
    keyed = runs(t).filter("score is not null").withColumn("metric", F.replace(F.lower("metric"), F.lit(" "), F.lit("_")))
    return gates.regression_gate(keyed, baseline).select("case_id", "metric", "score", "passed")


@query("judge_concordance", sql="""
select case_id, metric, round(old_score, 9) as old_score, round(new_score, 9) as new_score, round(abs(old_score - new_score), 9) as abs_diff from (
  select doc_id::varchar as case_id, 'faithfulness' as metric, 0.4::double + quality * 0.5::double as old_score, 0.5::double + toxic * 0.25::double as new_score from labels)""")
def _(t):
    base = t.raw("labels").select(F.col("doc_id").cast("string").alias("case_id"), F.lit("faithfulness").alias("metric"), "quality", "toxic")
    old = base.withColumn("score", F.lit(0.4) + F.col("quality") * 0.5)
    new = base.withColumn("score", F.lit(0.5) + F.col("toxic") * 0.25)
    both = evals.judge_concordance(old, new)
    return both.select("case_id", "metric", *[F.round(c, 9).alias(c) for c in ("old_score", "new_score", "abs_diff")])


@query("residual_error", "resolved", sql="""
with per as (select p_partkey::varchar as theme_id,
  count(r.sentence_pos) as sentences, count(*) filter (where r.verdict = 'grounded') as grounded,
  count(*) filter (where r.verdict = 'contradicted') as contradicted,
  count(*) filter (where r.resolved_by = 'deberta') as by_deberta, count(*) filter (where r.resolved_by = 'llm_as_nli') as by_llm_as_nli,
  max(case when p_size % 3 = 0 then 1 else 0 end) as nli_downgrades
  from part left join resolved r on r.theme_id = p_partkey::varchar group by p_partkey),
alls as (select theme_id, 1 as themes, sentences, grounded, contradicted, by_deberta, by_llm_as_nli, nli_downgrades from per
 union all select null, count(*), sum(sentences), sum(grounded), sum(contradicted), sum(by_deberta), sum(by_llm_as_nli), sum(nli_downgrades) from per)
select theme_id, themes, sentences::bigint as sentences, grounded::bigint as grounded, contradicted::bigint as contradicted,
  by_deberta::bigint as by_deberta, by_llm_as_nli::bigint as by_llm_as_nli, nli_downgrades::bigint as nli_downgrades,
  round(coalesce(contradicted / nullif(sentences, 0), 0), 9)::double as contradicted_rate,
  case when contradicted > 0 or nli_downgrades > 0 then 'GO' else 'NO-GO' end as verdict from alls""")
def _(t):
    prefix = F.when(F.col("p_size") % 3 == 0, F.lit("Not verified as consensus: x")).otherwise(F.lit("open question"))
    gaps = t.raw("part").select(F.col("p_partkey").cast("string").alias("theme_id"), prefix.alias("entry"))
    return evals.residual_error(label_themes(t), resolved(t), gaps).withColumn("contradicted_rate", F.round("contradicted_rate", 9))


REVIEW_JSON = """
case when doc_id % 10 = 9 then 'x' else '' end || '{"title":"' || case when doc_id % 4 = 0 then '' else 't' || doc_id end || '","abstract":'
 || case when doc_id % 3 = 0 then 'null' else '"a"' end || ',"sections":[' || case doc_id % 3 when 0 then '' when 1 then '{"theme_id":"x","label":"","content":"c"}'
 else '{"theme_id":"x","label":"l","content":"c"},{"theme_id":0}' end || '],"citations":[' || case when doc_id % 2 = 0 then '' else '1' end || ']'
 || case when doc_id % 5 = 0 then '' else ',"references":{"n":' || n_chars || '}' end || '}'"""


@query("schema_completeness", sql=f"""
with docs as (select doc_id, {REVIEW_JSON} as j from documents),
parsed as (select doc_id, json_valid(j) as ok, case when json_valid(j) then j::json end as j from docs),
given as (select doc_id, ok, j,
  coalesce(json_extract(j, '$.title')::varchar not in ('null', '""'), false) as f1,
  coalesce(json_extract(j, '$.abstract')::varchar not in ('null', '""'), false) as f2,
  coalesce(json_extract(j, '$.sections')::varchar not in ('null', '[]'), false) as f3,
  coalesce(json_extract(j, '$.citations')::varchar not in ('null', '[]'), false) as f4,
  coalesce(json_extract(j, '$.references')::varchar not in ('null', '{{}}'), false) as f5 from parsed)
select doc_id, case when ok then round((f1::int + f2::int + f3::int + f4::int + f5::int) / 5.0::double * 0.6::double
   + case doc_id % 3 when 1 then 2.0::double / 3 when 2 then 0.5::double else 0 end * 0.4::double, 9) else 0.0 end as score,
  case when not ok then 'Output is not valid JSON' when f1 and f2 and f3 and f4 and f5 then 'All required fields present'
   else 'Missing fields: ' || concat_ws(', ', case when not f1 then 'title' end, case when not f2 then 'abstract' end, case when not f3 then 'sections' end,
     case when not f4 then 'citations' end, case when not f5 then 'references' end) end as reason from given""")
def _(t):
    docs = t.documents.select("doc_id", F.expr(REVIEW_JSON).alias("review_json"))
    return evals.schema_completeness(docs).select("doc_id", F.round("score", 9).alias("score"), "reason")


@query("tool_correctness", sql="""
select conv_id, turn, case when contains(lower(text), case when conv_id % 2 = 0 then 'the' else 'ein' end) then 1.0::double else 0.0::double end as score from conversations""")
def _(t):
    tool = F.when(F.col("conv_id") % 2 == 0, F.lit("The")).otherwise(F.lit("EIN"))
    return t.turns.select("conv_id", "turn", evals.tool_correctness(F.col("text"), tool).alias("score"))


@query("sample_traces", sql="""
select event_id from events order by md5('s1' || event_id), event_id
limit (select greatest(1, cast(floor(count(*) * 0.1::double) as bigint)) from events)""")
def _(t):
    return evals.sample_exact(t.raw("events").select("event_id"), "event_id", seed="s1")


@query("scoreable_traces", sql="""
select conv_id || '/' || turn as trace_id, role = 'assistant' as has_contexts from conversations where turn % 5 <> 0 and text <> ''""")
def _(t):
    traces = t.turns.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("trace_id"),
        F.when(F.col("turn") % 5 == 0, F.lit("")).otherwise(F.col("role")).alias("input"), F.col("text").alias("output"),
        F.when(F.col("role") == "assistant", F.split("text", "\n")).alias("retrieved_contexts"))
    return evals.scoreable_traces(traces).select("trace_id", "has_contexts")


@query("production_misses", "judge", sql="""
select job_id, 'faithfulness' as metric, round(faithfulness, 9) as score from judge where not missing and faithfulness < 0.7""")
def _(t):
    return evals.production_misses(gate_inputs(t)[3]).withColumn("score", F.round("score", 9))


@query("judge_contexts", "claims", sql="""
select job_id, claim_id, text, cast(rank as integer) as rank from (
  select job_id, claim_id, substr(text, 1, 5000) as text, row_number() over (partition by job_id order by pos) as rank from claims) where rank <= 50""")
def _(t):
    return evals.judge_contexts(t.claims, F.col("pos")).select("job_id", "claim_id", "text", "rank")


@query("latest_job", sql="""
select arg_max(user_id::varchar, ts) as job_id, epoch_us(max(ts)) as modified_at from events""")
def _(t):
    jobs = t.events.groupBy("job_id").agg(F.max(F.unix_micros("ts")).alias("modified_at"))
    return evals.latest_job(jobs)


# output-side redaction --------------------------------------------------------------------------------

def mail(x: str) -> str:
    return f"regexp_replace({x}, '{EMAIL}', '[EMAIL]', 'g')"



@query("scrub_reviews", "reviews", sql=f"""
select theme_id, {mail('review')} as review, array_to_string(list_transform(consensus, lambda c: {mail('c')}), '|') as consensus,
       array_to_string(gaps, '|') as gaps from reviews""")
def _(t):
    return gates.scrub_reviews(reviews(t))[0].select("theme_id", "review", listed("consensus").alias("consensus"), listed("gaps").alias("gaps"))


@query("scrub_reviews_audit", "reviews", sql="""
select 'theme_review' as stage, theme_id as key, 'EMAIL_ADDRESS' as entity_type from reviews""")
def _(t):
    return gates.scrub_reviews(reviews(t))[1]


@query("scrub_sections", "placed_texts", sql=f"""
select doc_id::varchar as theme_id, md5(regexp_replace(regexp_replace({mail('text')}, '{PHONE}', '[PHONE]', 'g'), {PLACES}, '[LOCATION]', 'g')) as content from placed_texts""")
def _(t):
    sections = placed_texts(t).select(F.col("doc_id").cast("string").alias("theme_id"), F.col("text").alias("content"))
    return gates.scrub_sections(sections, terms=place_terms(t))[0].withColumn("content", F.md5("content"))


@query("scrub_title_abstract_audit", "placed_texts", sql=f"""
with headed as (select string_split(text, chr(10))[1] as title, text as abstract from placed_texts),
cleaned as (select {mail('title')} as title, {mail('abstract')} as abstract, regexp_matches(title, '{EMAIL}') as t1, regexp_matches(abstract, '{EMAIL}') as a1 from headed)
select 'aggregation_reduce' as stage, key, entity_type, count(*) as n from (
  select 'title' as key, 'EMAIL_ADDRESS' as entity_type from cleaned where t1 union all select 'abstract', 'EMAIL_ADDRESS' from cleaned where a1
  union all select 'title', 'PHONE_NUMBER' from cleaned where regexp_matches(title, '{PHONE}') union all select 'abstract', 'PHONE_NUMBER' from cleaned where regexp_matches(abstract, '{PHONE}')
  union all select 'title', 'LOCATION' from cleaned where regexp_matches(title, {PLACES}) union all select 'abstract', 'LOCATION' from cleaned where regexp_matches(abstract, {PLACES})) group by all""")
def _(t):
    headed = placed_texts(t).select("doc_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("abstract"))
    audit = gates.scrub_title_abstract(headed, terms=place_terms(t), keys=["doc_id"])[1]
    return audit.groupBy("stage", "key", "entity_type").agg(F.count(F.lit(1)).alias("n"))
