"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.ordered import join_null_safe
from citeloom.llm import ann, bpe, hard_negatives, html_text, langid, mixing, neardup, pii, prefix_trie, sharding, topk, url_filter, vectors, wordpiece
from citeloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

OLD_SHARDS = 16


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    sizes = mixing.measured(table(spark, sf_dir, "documents"))
    taken = join_null_safe(sizes, mixing.plan(sizes), ["doc_id", "source", "size"])
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
                        "source", "copies")


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector."""
    return topk.search(table(spark, sf_dir, "embeddings"), vectors.every(50), 5)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document; a third of the documents teaches nothing."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    learned = langid.profiles(docs.filter(~F.col("held_out")))
    return langid.predict(docs, learned).select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes, from 16 shards by a hash of the text, with the fewest bytes moved."""
    rows = sharding.measured(table(spark, sf_dir, "documents"))
    old = F.pmod(F.xxhash64("content", F.lit(OLD_SHARDS)), F.lit(OLD_SHARDS))
    plan = sharding.reshard(rows, old, OLD_SHARDS, shards=24)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document's ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    both = bpe.with_ids_digest(bpe.decode(coded, path))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256",
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of each page."""
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html")).drop("html")
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document and its number of links to other texts."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, greedy word-piece tokens and unknown words of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest neighbours found for every 20th vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), vectors.every(20), 20)


@query
def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document: counts and a digest of the base kinds, and all spans."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.BASE_KINDS],
                        F.sha2(pii.span_list(base).cast("binary"), 256).alias("base_sha256"), pii.span_list(F.col("pii_spans")).alias("spans"))


RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
         url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/")]


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url: the longest rule's, else that of trees trained on the urls that rules decide."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector; every 7th label is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vectors.every(100), label=label)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations: heads of up to 8 turns come from the conversation of the next lower multiple of 5."""
    rows = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie.trie(*prefix_trie.grafted(rows, F.col("conv_id") - F.col("conv_id") % 5, heads, 8))


ORACLES["op2_exact_top_k"] = """
with whole as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from whole q join whole c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 5"""

ORACLES["op7_near_duplicates"] = r"""
with recursive worded as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
shingled as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s from worded),
sets as (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as copy from shingled group by doc_id),
classes as (select copy, min(doc_id) as rep, any_value(n) as n from sets group by copy),
reps as (select c.rep, c.n, s.s from classes c join shingled s on s.doc_id = c.rep),
common as (select a.rep as a, b.rep as b, count(*) as k, any_value(a.n) as m, any_value(b.n) as n from reps a join reps b on a.s = b.s and a.rep < b.rep group by 1, 2),
links as (select a, b from common where k >= 0.8 * (m + n - k)),
paired as (select a, b from links union all select b, a from links),
reach(rep, other) as (select rep, rep from classes union select r.rep, l.b from reach r join paired l on l.a = r.other),
named as (select rep, min(other) as class_id from reach group by rep),
degree as (select a as rep, count(*) as n_links from paired group by a)
select d.doc_id, coalesce(x.class_id, d.doc_id) as class_id, coalesce(c.rep, d.doc_id) as copy_id, coalesce(g.n_links, 0)::bigint as n_links
from documents d left join sets s using (doc_id) left join classes c using (copy) left join named x on x.rep = c.rep left join degree g on g.rep = c.rep"""

ORACLES["op12_hard_negatives"] = """
with whole as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_dot_product(a.e, c.e) as bigint) as score
  from whole a join whole c on c.vec_id <> a.vec_id and len(c.e) = len(a.e) where a.vec_id % 100 = 0),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as integer) as rank,
  n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and 80 * p.positive_score <= 100 * n.score and n.score <= p.positive_score
qualify rank <= 5"""

ORACLES["op13_prefix_trie"] = """
with said as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
convs as (select conv_id, count(*) as n, conv_id - conv_id % 5 as base, (xor(4294967295, list_reduce(
    list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint),
    lambda crc, b: list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(crc, b)),
    4294967295::bigint))) % 9 as h from said group by conv_id),
plan as (select c.*, least(c.h, coalesce(b.n, 0)) as taken from convs c left join convs b on b.conv_id = c.base),
turned as (
  select p.conv_id, s.pos, s.role, s.text from plan p join said s on s.conv_id = p.base and s.pos < p.taken
  union all select p.conv_id, s.pos - p.h + p.taken, s.role, s.text from plan p join said s on s.conv_id = p.conv_id and s.pos >= p.h),
listed as (select p.conv_id, coalesce(list(struct_pack(role := t.role, text := t.text) order by t.pos) filter (t.pos is not null), []) as seq
  from plan p left join turned t on t.conv_id = p.conv_id group by p.conv_id),
placed as (select conv_id as member, unnest(range(len(seq) + 1)) as depth, seq from listed),
named as (select member, depth, len(seq) = depth as ends, min(member) over (partition by depth, seq[1:depth]) as conv_id,
    case when depth = 0 then 0 else strlen(seq[depth].text) end as bytes from placed),
nodes as (select n.conv_id, n.depth, count(*) as n_convs, any_value(n.bytes) as bytes,
    sha256(coalesce(string_agg(n.member::varchar, ',' order by n.member) filter (n.ends), '')) as ends_sha256 from named n group by 1, 2),
tree as (select n.*, p.conv_id as parent_conv_id from nodes n left join named p on p.member = n.conv_id and p.depth = n.depth - 1),
kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from tree where depth > 0 group by 1, 2),
weighed as (select t.*, coalesce(k.n_children, 0) as n_children from tree t left join kids k using (conv_id, depth)),
sums as (select a.conv_id, a.depth, sum((w.n_children = 0)::int) as n_leaves, sum((w.n_convs - 1) * w.bytes) as saved_tokens
  from weighed w join named a on a.member = w.conv_id and a.depth <= w.depth group by 1, 2)
select w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, w.ends_sha256
from weighed w join sums s using (conv_id, depth)"""
