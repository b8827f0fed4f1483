"""Document pipeline: language, near duplicates, personal data, source mix, token ids.

``run`` applies the stages to the documents one after another. What a stage keeps is written as Parquet to the
shared folder and read again by the next, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, langid, mixing, neardup, pii
from citeloom.llm.common import prepared, stage, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language; a missing language is filled in.

    A document is rejected if it is ``und`` (no text, no letters) or shares no n-gram at all with any profile.
    """
    prepared(spark)
    guessed = langid.predict(docs, langid.profiles(docs), lang_pred="__lang", score="__score")
    kept = guessed.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") > 0))
    lang = F.coalesce("lang", "__lang") if "lang" in docs.columns else F.col("__lang")
    return kept.withColumn("lang", lang).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest id.

    Documents without words and texts that no other is near stay. Of rows that repeat whole or share text and id one stays; of rows with
    a null id and the same text one stays. Null texts count as empty; long texts are compared whole.
    """
    prepared(spark)
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by placeholders; the number of characters follows.

    No document goes. A null text stays null, repeated rows are redacted alike, long texts are read whole.
    """
    prepared(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target weights.

    A null source is a source; null and empty texts have size 0 and are drawn with their source's ratio; rows that repeat whole are drawn
    together; no document, however long, is taken more than three times. Their number of rows is what the mix takes.
    """
    prepared(spark)
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding in the same task: (doc_id, lang, source, n_tokens, ids, round_trip).

    A null text counts as empty and has no ids; repeated rows each have theirs; long texts are encoded whole.
    """
    prepared(spark)
    coded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), BYTE_BPE, checked="round_trip")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Rank-order profiles, sketches and merge ranks have no SQL form: tests compare with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
