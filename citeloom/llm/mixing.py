"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words in proportion to its weight, at most ``most`` times what it has; the excess is
shared anew by weight until no source is above. A document of a source with the ratio r = target / size is
taken floor(r) times and once more with probability r - floor(r). These fractions are rounded dependently:
two documents meet and mass is moved from one to the other, at random and without bias, until one of the two is
integral; the words of the two together stay the same. The other goes on to meet the next. Documents
meet within blocks of about ``FAN``, the longest first, so that a short one is likely to be left over; what a block
leaves over (one document) meets in a block of blocks, and so on up a tree, so a source of any size is spread
over many tasks and ends within one document of its target.

Randomness is a hash of the documents that meet, so reruns agree. Only DataFrame functions are used.

Defined results: a null text has no words. A document without words carries no mass and is rounded
on its own. Null sources form a source of their own, the last. Rows that repeat (same id, source and size)
are one item: they are all taken equally often. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ordered import join_null_safe, with_position
from citeloom.llm.common import WORD, stage, uniform

FAN = 64
MOST = 3
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 20
ITEM = "struct<o:double,h:bigint,doc_id:{id},size:bigint,mass:double,p:double>"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, rows, target) for ``sizes(source, size)``: one row for each source.

    Sources in the order of their code points, null last, have the weights in turn. The level (words per unit of
    weight) rises as sources reach their limit; each step is one sum over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    placed = with_position(per, [], [F.col("source").isNull(), F.col("source")], "at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    placed = stage(placed.withColumn("weight", weight), "sources")
    total, units = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total or 0) / (units or 1), -1
    while True:
        above = F.lit(level) * F.col("weight") > F.col("source_size") * most
        count, fixed, free = placed.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if count <= full or free == 0:
            break
        level, full = (total - fixed) / free, count
    target = F.least(F.lit(level) * F.col("weight"), (F.col("source_size") * most).cast("double"))
    return placed.select("source", "source_size", "rows", target.alias("target"))


def _fold(items: Column, kind: str, level: int) -> Column:
    """Let the items of a block meet one after another: (cur: the one left over, out: the integral ones)."""
    done = "array<struct<doc_id:{id},size:bigint,up:boolean>>".format(id=kind)

    def meet(state: Column, x: Column) -> Column:
        c = state["cur"]
        ratio = x["mass"] / c["mass"]
        rise = F.least(1.0 - c["p"], x["p"] * ratio)          # of c, while x falls
        fall = F.least(c["p"], (1.0 - x["p"]) * ratio)        # of c, while x rises
        up = uniform(F.lit(SEED), F.lit(level), c["h"], x["h"]) * (rise + fall) < fall
        own = F.when(up, 1.0 - c["p"] <= x["p"] * ratio).otherwise(c["p"] <= (1.0 - x["p"]) * ratio)
        moved = F.when(up, rise).otherwise(-fall)

        def with_p(item: Column, p: Column) -> Column:
            return F.struct(item["o"].alias("o"), item["h"].alias("h"), item["doc_id"].alias("doc_id"), item["size"].alias("size"),
                            item["mass"].alias("mass"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

        left = F.when(own, with_p(x, x["p"] - moved / ratio)).otherwise(with_p(c, c["p"] + moved))
        gone = F.when(own, F.struct(c["doc_id"].alias("doc_id"), c["size"].alias("size"), up.alias("up"))).otherwise(
            F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), (~up).alias("up")))
        return F.struct(left.alias("cur"), F.concat(state["out"], F.array(gone)).alias("out"))

    start = F.struct(items[0].alias("cur"), F.array().cast(done).alias("out"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, meet)


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Copies of each distinct document of ``sizes(doc_id, source, size)``.

    Returns (doc_id, source, size, source_size, target, copies). ``sizes`` should be a stage table: it is read
    a few times.
    """
    kind = dict(sizes.dtypes)["doc_id"]
    item = ITEM.format(id=kind)
    per = targets(sizes, weights, most)
    largest = per.agg(F.max("rows")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    h = F.xxhash64(F.lit(SEED), "doc_id", "size")
    block = F.pmod(h, F.ceil(F.col("rows") / FAN).cast("long"))
    items = (
        join_null_safe(sizes.select("doc_id", "source", "size"), per, ["source"])
        .withColumn("block", block)
        .groupBy("source", "block", "doc_id", "size")
        .agg(F.count(F.lit(1)).alias("rows"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
             F.first(ratio).alias("ratio"))
        .withColumn("base", F.floor("ratio").cast("int")).withColumn("p", F.col("ratio") - F.floor("ratio")))
    items = stage(items, "items")
    alone = items.filter("size = 0").select("doc_id", "source", "size", (uniform(F.lit(SEED + 1), h) < F.col("p")).alias("up"))
    mass = (F.col("rows") * F.col("size")).cast("double")
    entry = F.struct((-mass).alias("o"), h.alias("h"), "doc_id", "size", mass.alias("mass"), "p").cast(item)
    left = items.filter("size > 0").select("source", "block", entry.alias("item"))
    rounded = [alone]
    blocks, level = max(1, -(-largest // FAN)), 0
    while True:
        met = left.groupBy("source", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
        met = stage(met.select("source", "block", _fold(F.col("items"), kind, level).alias("met")).select("source", "block", "met.*"), "met")
        rounded.append(met.select("source", F.explode("out").alias("o")).select("o.doc_id", "source", "o.size", "o.up"))
        if blocks == 1:
            break
        blocks, level = -(-blocks // FAN), level + 1
        left = met.select("source", F.floor(F.col("block") / FAN).cast("long").alias("block"), F.col("cur").alias("item"))
    last = met.select("cur.doc_id", "source", "cur.size", (uniform(F.lit(SEED + 2), F.col("cur.h")) < F.col("cur.p")).alias("up"))
    ups = last
    for part in rounded:
        ups = ups.unionByName(part)
    return join_null_safe(items, ups, ["source", "doc_id", "size"]).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("up").cast("int")).alias("copies"))


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size): what the plan needs of every row, as a stage table."""
    return stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")), "sizes")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (not at all, if 0 times); same columns."""
    copies = plan(measured(docs), weights, most).select("doc_id", "source", F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    taken = join_null_safe(docs.withColumn("__size", words(F.col("text"))), copies.filter("__copies > 0"), ["doc_id", "source", "__size"])
    again = taken.withColumn("__again", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
