"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path: it fits its host and all subdomains where the URL's path starts with the rule's; the
longest rule decides. URLs that a rule decides are also the labelled ones, unless the caller has others. From them the trees
learn what a URL looks like: length, depth of the path, share of digits, entropy of its characters, number of parameters,
labels and hyphens of the host, and two statistics of its suffix (the last two labels of the host): how many URLs have it, and the
share of blocked ones among the labelled, drawn towards the share over all.

Suffix statistics count every URL. The trees are fitted on about ``PER_CLASS`` different labelled URLs of each verdict, taken by
a hash of the URL, in one order, so that reruns agree; on smaller tables that is all of them.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and is judged like any other text (null: as
empty). Repeated rows have one verdict each. A URL of any length is read whole. Where no labelled URL is blocked, or all are,
there is nothing to learn: the only verdict known holds for all, ``allow`` if there is none. Other columns pass through, and
one named like an added column is replaced. No rows, no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import stage, uniform

ALLOW, BLOCK = "allow", "block"
PER_CLASS = 10_000
TREES, DEPTH, SEED = 20, 4, 7
PRIOR = 10.0
LEXICAL = "length double, depth double, digits double, entropy double, parameters double, labels double, hyphens double"
FEATURES = [*(f.split()[0] for f in LEXICAL.split(", ")), "suffix_urls", "suffix_blocked"]


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Model(NamedTuple):
    """What was learned: trees (None if there was one verdict only), suffix statistics, and their values for unknown suffixes."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame
    blocked: float
    only: str


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(own_host: Column, own_path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones a blocking one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.verdict == BLOCK)):
        fits = ((own_host == own.host) | F.endswith(own_host, F.lit(f".{own.host}"))) & F.startswith(own_path, F.lit(own.path))
        rule = F.when(fits, F.lit(own.host + own.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(own.verdict)).otherwise(verdict)
    return rule, verdict


def suffix(own_host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(own_host, ".", -2)


def lexical(url: str | None) -> tuple[float, ...]:
    """Features of one URL, as named in ``LEXICAL``."""
    url = url or ""
    _, _, rest = url.partition("://")
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    own, after = rest[:cut], rest[cut:].split("#")[0]
    steps, _, asked = after.partition("?")
    n, counts = len(url), Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return (float(n), float(sum(1 for s in steps.split("/") if s)), sum(counts[d] for d in "0123456789") / max(1, n), entropy,
            float(sum(1 for p in asked.split("&") if p)), float(own.count(".") + 1), float(own.count("-")))


def _lexical(urls: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lexical(u) for u in urls], columns=FEATURES[:-2], dtype=float)


def _described(urls: DataFrame, suffixes: DataFrame, blocked: float) -> DataFrame:
    """``urls(__url, __host)`` with the vector of its features; the statistics' table is small or split by adaptive execution."""
    joined = urls.withColumn("__suffix", suffix(F.col("__host"))).join(suffixes, "__suffix", "left").withColumn(
        "__lexical", F.pandas_udf(_lexical, LEXICAL)("__url"))
    columns = {name: F.col(f"__lexical.{name}") for name in FEATURES[:-2]} | {
        "suffix_urls": F.log1p(F.coalesce("__urls", F.lit(0))), "suffix_blocked": F.coalesce("__rate", F.lit(blocked))}
    named = joined.withColumns({f"__f_{name}": column for name, column in columns.items()})
    listed = [f"__f_{name}" for name in FEATURES]
    return VectorAssembler(inputCols=listed, outputCol="__features").transform(named).drop(*listed, "__lexical", "__urls", "__rate", "__suffix")


def train(labelled: DataFrame, urls: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from ``labelled(url, verdict)``; suffixes are counted over ``urls(url)``."""
    seen = urls.select(suffix(host(F.col("url"))).alias("__suffix"), F.lit(1).alias("u"), F.lit(0).alias("n"), F.lit(0).alias("b"))
    known = labelled.filter(F.col("verdict").isin(ALLOW, BLOCK))
    known = known.select("url", host(F.col("url")).alias("__host"), (F.col("verdict") == BLOCK).cast("int").alias("b"))
    told = known.select(suffix(F.col("__host")).alias("__suffix"), F.lit(0).alias("u"), F.lit(1).alias("n"), "b")
    counted = stage(seen.unionByName(told).groupBy("__suffix").agg(*[F.sum(c).alias(c) for c in "unb"]), "suffixes")
    n, b = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    blocked = b / n if n else 0.0
    rate = (F.col("b") + F.lit(PRIOR * blocked)) / (F.col("n") + F.lit(PRIOR))
    suffixes = counted.select("__suffix", F.col("u").alias("__urls"), rate.alias("__rate"))
    if not 0 < b < n:
        return Model(None, suffixes, blocked, BLOCK if b else ALLOW)
    # Copies of a URL are one example; a URL with both verdicts is one of each.
    share = F.when(F.col("b") == 1, F.lit(per_class / b)).otherwise(F.lit(per_class / (n - b)))
    sample = known.filter(uniform(F.col("url"), F.lit(SEED)) < share).dropDuplicates(["url", "b"])
    sample = _described(sample.withColumn("__url", F.col("url")), suffixes, blocked).select("url", "b", "__features")
    sample = stage(sample.repartition(1).sortWithinPartitions("url", "b"), "examples")
    trees = GBTClassifier(featuresCol="__features", labelCol="b", predictionCol="__guess", maxIter=TREES, maxDepth=DEPTH, seed=SEED,
                          checkpointInterval=-1).setRawPredictionCol("__raw").setProbabilityCol("__odds")
    return Model(trees.fit(sample.select("b", "__features")), suffixes, blocked, ALLOW)


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model | None = None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score (chance that it is blocked, by the trees) and verdict.

    Without a ``model``, one is trained from the URLs that the rules decide.
    """
    if model is None:
        own = pages.select(F.col(url).alias("url"))
        model = train(own.withColumn("verdict", matched(host(F.col("url")), path(F.col("url")), rules)[1]), own)
    named = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    rule, told = matched(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "verdict": told, "__url": F.col(url), "__host": F.col("host")})
    if model.trees is None:
        scored = named.withColumn("score", F.lit(1.0 if model.only == BLOCK else 0.0))
    else:
        scored = model.trees.transform(_described(named, model.suffixes, model.blocked)).withColumn("score", vector_to_array("__odds")[1])
    guess = F.when(F.col("score") > 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    return scored.withColumn("verdict", F.coalesce("verdict", guess)).select(*columns, "host", "path", "rule", "score", "verdict")
