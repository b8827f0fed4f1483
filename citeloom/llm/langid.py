"""Language identification by rank-order n-gram profiles.

A language's profile is its ``PROFILE`` most frequent letter n-grams (one to three letters, words padded by a
blank), by rank. A document's own profile is made from its whole text in the same way; its distance to a
language is the sum of how far each of its n-grams is out of place there, ``PROFILE`` for one that is
absent. The nearest language wins, a tie goes to the smaller name. The score is one less the share of the
largest possible distance.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is every text when nothing was
learned. Rows without a text or a language teach nothing. Repeated rows teach as often as they occur. N-grams
of equal frequency rank by code point.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
UNKNOWN = "und"
SLICE = 1 << 20
HELD = 1 << 20  # n-grams a task keeps before it hands its counts on

_BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or blank."""
    table = np.full(sys.maxunicode + 1, _BLANK, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with their total counts."""
    if len(codes) == 1:
        return codes[0], counts[0]
    every, weight = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])[: len(every)]
    return every[first], np.add.reduceat(weight, first) if len(first) else weight


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a letter) of the n-grams of the whole text, ascending, and how often each occurs."""
    letters = _letters()[np.frombuffer((text or "").encode("utf-32-le"), "<u4")]
    padded = np.concatenate(([_BLANK], letters, [_BLANK])).astype(np.int64)
    kept = padded[np.r_[True, (padded[1:] != _BLANK) | (padded[:-1] != _BLANK)]]
    codes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(kept) - 1, SLICE):
        part = kept[at:at + SLICE + 2]
        one, two = part[:-2] if len(part) > SLICE else part, part[:SLICE + 1]
        pairs = two[:-1] << 21 | two[1:]
        three = part[:-2] << 42 | part[1:-1] << 21 | part[2:]
        found = np.unique(np.concatenate((one[one != _BLANK], pairs, three[part[1:-1] != _BLANK])), return_counts=True)
        codes.append(found[0])
        counts.append(found[1])
    if len(codes) == 2:
        return codes[1], counts[1]
    return _summed(codes, counts)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, best first."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


def count_by_language(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}

        def handed(name: str) -> pa.RecordBatch:
            codes, counts = _summed(*held.pop(name))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                                              names=["lang", "gram", "n"])

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, counts = gram_counts(t.as_py())
                mine = held.setdefault(name, ([], []))
                mine[0].append(codes)
                mine[1].append(counts)
                if len(mine[0]) >= 256:
                    merged = _summed(*mine)
                    held[name] = ([merged[0]], [merged[1]])
                    if len(merged[0]) > HELD:
                        yield handed(name)
        for name in list(held):
            yield handed(name)

    taught = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.col(text))
    counted = taught.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, rank, gram): the ``size`` most frequent n-grams of each language."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranks = count_by_language(docs, text, lang).withColumn("rank", F.row_number().over(best))
    return ranks.filter(F.col("rank") <= size).select("lang", "rank", "gram")


class Profiles:
    """Profiles of all languages as one table: n-gram by language, ``size`` where the language lacks it."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[2] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        at = {name: i for i, name in enumerate(self.langs)}
        for name, rank, gram in rows:
            self.ranks[np.searchsorted(self.grams, gram), at[name]] = rank - 1

    def nearest(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        where = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[where] == own
        there = self.ranks[where[known]]
        apart = np.abs(there - np.flatnonzero(known)[:, None].astype(np.int32))
        apart[there < 0] = self.size
        total = apart.sum(0, dtype=np.int64) + self.size * int((~known).sum())
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (self.size * len(own))


def predict(docs: DataFrame, learned: DataFrame, text: str = "text", size: int = PROFILE,
            lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the nearest language of each whole text and its score; columns of those names are replaced.

    ``learned`` is what ``profiles`` returns: ``size`` rows for each language at most, whatever the corpus,
    which every task gets.
    """
    table = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in learned.select("lang", "rank", "gram").collect()], size))

    def run(texts: pa.Array) -> pa.Array:
        found = [table.value.nearest(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                          names=["lang", "score"])

    # Not to be repeated by each filter or expression that uses the guess.
    guess = F.arrow_udf(run, "struct<lang:string,score:double>").asNondeterministic()(F.col(text))
    kept = [c for c in docs.columns if c not in (lang_pred, score, "__guess")]
    return docs.withColumn("__guess", guess).select(*[F.col(f"`{c}`") for c in kept],
                                                     F.col("__guess.lang").alias(lang_pred), F.col("__guess.score").alias(score))


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that teaches nothing; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
