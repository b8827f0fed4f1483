"""Ingestion queries: documents as papers, their lines as paragraphs, spans and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog.registry import query
from citeloom.catalog.stand_ins import CTES
from citeloom.functions import pii
from citeloom.functions import text as X
from citeloom.operators import chunking, layout


def listed(column):
    return F.array_join(column, "|")


# columns of text functions -------------------------------------------------------------------------

@query("normalize_text", sql="""
select doc_id, md5(text) as clean from documents""")
def _(t):
    """Typographic variants of every document fold back to the document itself."""
    fancy = F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("'"), F.lit("’"))
    fancy = F.replace(fancy, F.lit("ffl"), F.lit("ﬄ"))
    return t.documents.select("doc_id", F.md5(X.normalize_text(fancy)).alias("clean"))


@query("parse_authors", "paragraphs", sql="""
select paper_id, i, array_to_string(list_filter(list_transform(
  case when contains(text, ';') then string_split(text, ';') else string_split(text, ',') end, lambda x: trim(x)), lambda x: x <> ''), '|') as authors
from paragraphs""")
def _(t):
    return t.paragraphs.select("paper_id", "i", listed(X.parse_authors(F.col("text"))).alias("authors"))


@query("estimate_tokens", "paragraphs", sql="select paper_id, i, cast(length(text) // 4 as integer) as tokens from paragraphs")
def _(t):
    return t.paragraphs.select("paper_id", "i", X.estimate_tokens(F.col("text")).alias("tokens"))


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')"


@query("split_sentences", sql=f"""
select doc_id, cast(len({SENTENCES}) as integer) as n, md5(array_to_string({SENTENCES}, '|')) as sentences from documents""")
def _(t):
    pieces = X.split_sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(pieces).alias("n"), F.md5(listed(pieces)).alias("sentences"))


@query("slugify", "paragraphs", sql=r"""
select paper_id, i, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g') as slug from paragraphs""")
def _(t):
    return t.paragraphs.select("paper_id", "i", X.slugify(F.col("text")).alias("slug"))


@query("previews", "paragraphs", sql="""
select paper_id, i, substr(text, 1, 300) as context,
       case when length(text) > 200 then substr(text, 1, 197) || '...' else text end as preview from paragraphs""")
def _(t):
    return t.paragraphs.select("paper_id", "i", X.head(F.col("text")).alias("context"), X.preview(F.col("text")).alias("preview"))


@query("author_preview", "paragraphs", sql="""
select paper_id, i, array_to_string(string_split(text, ' ')[1:3], ', ') as shown
from paragraphs""")
def _(t):
    return t.paragraphs.select("paper_id", "i", X.author_preview(F.split("text", " ")).alias("shown"))


@query("point_ids", "claims", sql="""
with keyed as (select claim_id, case when paragraph % 2 = 0 then claim_id else
   concat_ws('-', substr(md5(claim_id), 1, 8), substr(md5(claim_id), 9, 4), substr(md5(claim_id), 13, 4),
             substr(md5(claim_id), 17, 4), substr(md5(claim_id), 21, 12)) end as given from claims)
select claim_id, regexp_matches(given, '^[0-9a-f]{8}-') as valid,
  case when regexp_matches(given, '^[0-9a-f]{8}-') then given else
   concat_ws('-', substr(md5(given), 1, 8), substr(md5(given), 9, 4), substr(md5(given), 13, 4),
             substr(md5(given), 17, 4), substr(md5(given), 21, 12)) end as point_id from keyed""")
def _(t):
    h = F.md5("claim_id")
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    keyed = t.claims.select("claim_id", F.when(F.col("paragraph") % 2 == 0, F.col("claim_id")).otherwise(made).alias("given"))
    return keyed.select("claim_id", X.is_uuid(F.col("given")).alias("valid"), X.point_id(F.col("given")).alias("point_id"))


@query("format_duration", sql="""
select event_id, case when cast(floor(value * 1000 / 1000 + 0.5) as bigint) < 60 then cast(floor(value + 0.5) as bigint) || 's'
  else (cast(floor(value + 0.5) as bigint) // 60) || 'm ' || (cast(floor(value + 0.5) as bigint) % 60) || 's' end as shown from events""")
def _(t):
    return t.raw("events").select("event_id", X.format_duration(F.col("value") * 1000).alias("shown"))


# redaction -----------------------------------------------------------------------------------------

CTES["placed_texts"] = ((), """
select d.doc_id, d.text || ' Seen in ' || n.n_name || '.' as text
from documents d join nation n on n.n_nationkey = d.doc_id % 25""")
EMAIL, PHONE = pii.EMAIL_PATTERN, pii.PHONE_PATTERN
PLACES = r"(select '\b(?:' || string_agg(n_name, '|' order by length(n_name) desc, n_name) || ')\b' from nation)"


def placed_texts(t):
    nations = t.raw("nation").select(F.col("n_nationkey").alias("k"), "n_name")
    docs = t.documents.withColumn("k", (F.col("doc_id") % 25).cast("int"))
    return docs.join(nations, "k").select("doc_id", F.concat("text", F.lit(" Seen in "), "n_name", F.lit(".")).alias("text"))


def place_terms(t):
    """The term table: nation names."""
    return t.raw("nation").select(F.lit("LOCATION").alias("kind"), F.col("n_name").alias("term"))


@query("scrub_pii", "placed_texts", sql=f"""
with one as (select doc_id, regexp_replace(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g'), '{PHONE}', '[PHONE]', 'g') as text,
   regexp_matches(text, '{EMAIL}') as mail, regexp_matches(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g'), '{PHONE}') as phone from placed_texts)
select doc_id, md5(regexp_replace(text, {PLACES}, '[LOCATION]', 'g')) as clean,
  concat_ws('|', case when mail then 'EMAIL_ADDRESS' end, case when phone then 'PHONE_NUMBER' end,
            case when regexp_matches(text, {PLACES}) then 'LOCATION' end) as found from one""")
def _(t):
    held = pii.with_terms(placed_texts(t), ["doc_id"], F.col("text"), place_terms(t), places="LOCATION")
    clean, found = pii.scrub(F.col("text"), pii.INPUT_SCOPE, locations=F.col("places"))
    return held.select("doc_id", F.md5(clean).alias("clean"), listed(found).alias("found"))


@query("tag_entities", "placed_texts", sql=r"""
select doc_id, array_to_string(list_distinct(regexp_extract_all(lower(text), '\bnation_\d+\b')), '|') as entities from placed_texts""")
def _(t):
    names = place_terms(t).withColumn("term", F.lower(F.trim("term")))
    held = pii.with_terms(placed_texts(t), ["doc_id"], F.lower("text"), names, names="LOCATION")
    return held.select("doc_id", listed(pii.entities(F.col("text"), F.col("names"))).alias("entities"))


# blocks, headings, title, authors --------------------------------------------------------------------

CTES["medians"] = (("spans",), """
select paper_id, coalesce(median(size) filter (where font not like '%Bold%' and trim(text) <> ''), 10.0) as body_size
from spans group by paper_id""")
CTES["blocks"] = (("spans",), """
select * from (select paper_id, page_idx, block_idx, trim(string_agg(text, chr(10) order by line_idx), ' ' || chr(10)) as text,
       max(size) as size, bool_or(font like '%Bold%') as bold from spans group by all) where text <> ''""")
CLASSIFIED = """
select *, page_idx = 0 and size > before as record,
       page_idx = 0 and not (size > before) and before > 0 and not bold_heading as byline
from (select b.paper_id, page_idx, block_idx, replace(text, chr(10), ' ') as text, size,
             bold and size > m.body_size + 1 as bold_heading,
             coalesce(max(size) over (w rows between unbounded preceding and 1 preceding), 0) as before,
             cast(row_number() over w as integer) as idx
      from {source} b join {medians} m using (paper_id) window w as (partition by b.paper_id, page_idx order by block_idx))"""
CTES["classified"] = (("blocks", "medians"), CLASSIFIED.format(source="blocks", medians="medians"))


@query("median_font", "medians", sql="select paper_id, body_size, body_size + 1 as heading_size from medians")
def _(t):
    return layout.median_font(t.spans)


@query("rollup_blocks", "blocks", sql="""
select paper_id, page_idx, block_idx, md5(text) as text, size, bold from blocks""")
def _(t):
    return layout.rollup_blocks(t.spans).withColumn("text", F.md5("text"))


@query("classify_headings", "classified", sql="""
select paper_id, cast(page_idx + 1 as integer) as page, idx as "index", md5(text) as text, (record or bold_heading) as is_heading,
       cast(case when record then 1 when bold_heading then 2 else 0 end as integer) as heading_level from classified""")
def _(t):
    rows = layout.classify_blocks(layout.rollup_blocks(t.spans), layout.median_font(t.spans))
    return rows.select("paper_id", "page", "index", F.md5("text").alias("text"), "is_heading", "heading_level")


HEADER = """
with split as (select *, list_filter(list_transform(case when contains(text, ';') then string_split(text, ';')
   else string_split(text, ',') end, lambda x: trim(x)), lambda x: x <> '') as names from {rows})
select paper_id, coalesce(arg_max(text, idx) filter (where record), '') as title,
       coalesce(array_to_string(arg_min(names, idx) filter (where byline and len(names) > 0), '|'), '') as authors
from split group by paper_id"""


@query("detect_title_and_authors", "classified", sql=HEADER.format(rows="classified"))
def _(t):
    rows = layout.classify_blocks(layout.rollup_blocks(t.spans), layout.median_font(t.spans))
    return layout.paper_header(rows).withColumn("authors", listed("authors"))


CTES["word_medians"] = (("words",), """
select paper_id, coalesce(median(size) filter (where font not like '%Bold%'), 10.0) as body_size from words group by paper_id""")
CTES["word_blocks"] = (("words", "word_medians"), """
select * from (
 select paper_id, page_idx, block_idx, trim(string_agg(text, ' ' order by line_top)) as text, max(size) as size, bool_or(bold) as bold
 from (select *, sum(starts) over (partition by paper_id, page_idx order by line_top) as block_idx
       from (select l.*, case when line_top - lag(line_top) over (partition by l.paper_id, page_idx order by line_top)
                              > body_size * 1.4 * 1.5 then 1 else 0 end as starts
             from (select paper_id, page_idx, cast(round_even(top, 0) as bigint) as line_top,
                          string_agg(text, ' ' order by x0, seq) as text, max(size) as size, bool_or(font like '%Bold%') as bold
                   from words group by all) l join word_medians using (paper_id)))
 group by all) where text <> ''""")
CTES["word_rows"] = (("word_blocks", "word_medians"), CLASSIFIED.format(source="word_blocks", medians="word_medians"))


def from_words(t):
    # documents are dealt by paper before they become words, so that texts are shuffled once and words never
    words = t.words_of(t.documents.repartition("doc_id"))
    medians = layout.median_font(words, skip_blank=False)
    return layout.classify_blocks(layout.words_to_blocks(words, medians))


@query("words_to_paragraphs", "word_rows", sql="""
select paper_id, cast(page_idx + 1 as integer) as page, idx as "index", md5(text) as text, (record or bold_heading) as is_heading,
       cast(case when record then 1 when bold_heading then 2 else 0 end as integer) as heading_level from word_rows""")
def _(t):
    return from_words(t).select("paper_id", "page", "index", F.md5("text").alias("text"), "is_heading", "heading_level")


@query("header_from_words", "word_rows", sql=HEADER.format(rows="word_rows"))
def _(t):
    return layout.paper_header(from_words(t)).withColumn("authors", listed("authors"))


# gates ---------------------------------------------------------------------------------------------

MIN_CHARS = 400  # above the library's 50, so that both outcomes occur in these documents
CTES["density"] = (("paragraphs", "papers"), """
select p.paper_id, p.page_count, coalesce(sum(length(g.text)), 0) as chars
from papers p left join paragraphs g using (paper_id) group by p.paper_id, p.page_count""")


@query("quality_gate", "density", sql=f"""
select paper_id, cast(chars as bigint) as chars from density where page_count > 0 and chars / page_count >= {MIN_CHARS}""")
def _(t):
    return layout.quality_gate(t.paragraphs, t.papers, MIN_CHARS).select("paper_id", "chars")


@query("select_extractor", "density", "paragraphs", "papers", sql=f"""
with first as (select paper_id, coalesce(sum(length(g.text)) filter (where not is_heading), 0) as chars, page_count
               from papers p left join paragraphs g using (paper_id) group by paper_id, page_count)
select f.paper_id, case when f.chars / f.page_count >= {MIN_CHARS} then 'primary'
                        when d.chars / d.page_count >= {MIN_CHARS} then 'fallback' else 'rejected' end as extractor
from first f join density d using (paper_id)""")
def _(t):
    body = t.paragraphs.filter(~F.col("is_heading"))
    chosen, rejected = layout.select_extractor((body, t.papers), (t.paragraphs, t.papers), MIN_CHARS)
    return chosen.select("paper_id", "extractor").unionByName(rejected.withColumn("extractor", F.lit("rejected")))


# chunks --------------------------------------------------------------------------------------------

CTES["by_heading"] = (("paragraphs",), """
select paper_id, i, page, idx, text, is_heading, heading_level,
       greatest(sum(cast(heading_level = 2 as integer)) over (partition by paper_id order by i) - 1, 0) as chunk from paragraphs""")
CTES["featured"] = (("by_heading",), """
select *, [cast(length(text) % 7 + 1 as double), cast(length(text) % 5 as double), cast(i % 3 as double)] as vec from by_heading""")
CTES["by_similarity"] = (("featured",), """
select paper_id, i, chunk as heading_chunk, sum(starts) over (partition by paper_id order by i) as chunk
from (select *, case when list_cosine_similarity(lag(vec) over (partition by paper_id order by i), vec) < 0.55 then 1 else 0 end as starts
      from featured)""")


def featured(t):
    """Paragraphs with a small vector made of their length and position."""
    vec = F.array((F.length("text") % 7 + 1).cast("double"), (F.length("text") % 5).cast("double"), (F.col("i") % 3).cast("double"))
    return t.paragraphs.withColumn("vec", vec)


@query("chunk_by_heading", "by_heading", sql="select paper_id, i, cast(chunk as bigint) as chunk from by_heading")
def _(t):
    return chunking.chunk_by_heading(t.paragraphs).select("paper_id", "i", "chunk")


@query("chunk_by_similarity", "by_similarity", sql="select paper_id, i, cast(chunk as bigint) as chunk from by_similarity")
def _(t):
    return chunking.chunk_by_similarity(featured(t)).select("paper_id", "i", "chunk")


@query("chunk_paper", "by_similarity", sql="""
select paper_id, i, cast(case when max(heading_chunk) over (partition by paper_id) > 0 then heading_chunk else chunk end as bigint) as chunk
from by_similarity""")
def _(t):
    return chunking.chunk_paper(featured(t)).select("paper_id", "i", "chunk")


CTES["marked"] = (("by_heading",), """
select *, case when is_heading then repeat('#', greatest(heading_level, 1)) || ' ' else '' end as mark,
       '[p.' || page || ',§' || idx || '] ' as tag from by_heading""")
CTES["contents"] = (("marked",), r"""
select paper_id, regexp_replace(string_agg(mark || tag || text, chr(10) || chr(10) order by i), '\n+$', '') || chr(10) as content
from marked group by paper_id""")


def contents(t):
    return chunking.to_markdown(t.paragraphs)


@query("annotated_markdown", "contents", sql="select paper_id, md5(content) as content from contents")
def _(t):
    return contents(t).withColumn("content", F.md5("content"))


@query("plain_markdown", "marked", sql=r"""
select paper_id, md5(regexp_replace(string_agg(mark || text, chr(10) || chr(10) order by i), '\n+$', '') || chr(10)) as content
from marked group by paper_id""")
def _(t):
    return chunking.to_markdown(t.paragraphs, annotated=False).withColumn("content", F.md5("content"))


@query("chunk_markdown", "marked", sql=r"""
select paper_id, cast(chunk as bigint) as chunk,
  md5(regexp_replace(string_agg(mark || tag || text, chr(10) || chr(10) order by i), '\n+$', '') || chr(10)) as content
from marked group by paper_id, chunk""")
def _(t):
    chunks = chunking.chunk_by_heading(t.paragraphs)
    return chunking.to_markdown(chunks, keys=("paper_id", "chunk")).withColumn("content", F.md5("content"))


@query("pack_under_budget", "marked", sql=r"""
with recursive lined as (select paper_id, i, mark || tag || text || case when i = max(i) over (partition by paper_id) then chr(10) else '' end as block from marked),
sized as (select paper_id, i, block, length(block) // 4 as tokens from lined),
packed(paper_id, i, part, used) as (
  select paper_id, i, 0, tokens from sized where i = 0
  union all
  select s.paper_id, s.i, case when p.used + s.tokens > 120 then p.part + 1 else p.part end,
         case when p.used + s.tokens > 120 then s.tokens else p.used + s.tokens end
  from packed p join sized s on s.paper_id = p.paper_id and s.i = p.i + 1)
select paper_id, cast(part as integer) as part, md5(string_agg(block, chr(10) || chr(10) order by i)) as content
from packed join sized using (paper_id, i) group by paper_id, part""")
def _(t):
    return chunking.pack_under_budget(contents(t), F.lit(120)).withColumn("content", F.md5("content"))


@query("size_trigger", "contents", sql="""
select paper_id, cast(length(content) // 4 as integer) as tokens, case when length(content) // 4 <= 300 then 'whole' else 'chunked' end as branch
from contents""")
def _(t):
    whole, chunked = chunking.size_trigger(contents(t), 300)
    return whole.select("paper_id", "tokens", F.lit("whole").alias("branch")).unionByName(
        chunked.select("paper_id", "tokens", F.lit("chunked").alias("branch")))
