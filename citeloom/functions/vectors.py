"""Vector arithmetic on ``array<double>`` columns and the batch hooks for embeddings and pair scores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the vector length of the reference deployment.
VECTOR_LENGTH = 1536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either side is a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(scale, F.lit(0.0)))


def unit(a: Column) -> Column:
    """Vector scaled to length one; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length == 0.0, a).otherwise(F.transform(a, lambda x: x / F.nullif(length, F.lit(0.0))))


@F.pandas_udf(T.DoubleType())
def cosine_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow form of :func:`cosine` for long vectors, one matrix pass per batch."""
    if a.empty:
        return pd.Series([], dtype="float64")
    left, right = np.stack(a.to_numpy()), np.stack(b.to_numpy())
    scale = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    return pd.Series(np.where(scale == 0, 0.0, np.einsum("ij,ij->i", left, right) / np.where(scale == 0, 1, scale)))


def vector_length_violations(df: DataFrame, column: str, length: int) -> DataFrame:
    """Rows whose vector is missing or has another length."""
    return df.filter(F.col(column).isNull() | (F.size(column) != length))


_BLANKS = re.compile(r"[ \t\r\n]+")


def _lower(text: str) -> str:
    """Lower case character by character, as SQL has it: neither a sigma's place in its word nor the dot of a capital I counts."""
    return text.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()


def _hashed_words(texts: pd.Series, length: int) -> pd.Series:
    slots: dict[str, int] = {}
    vectors = []
    for text in texts.fillna(""):
        words = [w for w in _BLANKS.split(_lower(text)) if w]
        for word in words:
            if word not in slots:
                slots[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % length
        vectors.append(np.bincount([slots[w] for w in words], minlength=length).astype("float64"))
    return pd.Series(vectors)


def with_vectors(df: DataFrame, text_col: str, out: str = "vec", *, length: int = VECTOR_LENGTH,
                 embed: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Attach a vector per text, in Arrow batches.

    ``embed`` maps a batch of texts to a batch of vectors and is built once per task; the default
    counts words into hashed slots, so it needs no model and repeats exactly.
    """
    encode = embed or (lambda texts: _hashed_words(texts, length))

    @F.pandas_udf("array<double>")
    def encode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield encode(batch)

    return df.withColumn(out, encode_batches(F.col(text_col)))


def summed(df: DataFrame, keys: list[str], vec: str, length: int) -> DataFrame:
    """One row per ``keys`` with the sum of their vectors of ``length``, added up in the tasks first."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.col(vec)[i]).alias(f"__{i}") for i in range(length)])
    return sums.select(*keys, F.array(*[F.col(f"__{i}") for i in range(length)]).alias(vec))


def with_pair_scores(df: DataFrame, premise: str, hypothesis: str,
                     score: Callable[[pd.Series, pd.Series], pd.DataFrame]) -> DataFrame:
    """Attach contradiction/entailment/neutral per text pair through a batch scoring function."""

    @F.pandas_udf("contradiction double, entailment double, neutral double")
    def score_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            yield score(left, right)[["contradiction", "entailment", "neutral"]]

    return df.withColumn("scores", score_batches(F.col(premise), F.col(hypothesis)))
