"""Redaction of e-mail addresses, phone numbers and listed places and people.

Places and people come from terms supplied by the caller (no language model runs here), so recall on unlisted names is
that of the terms. Terms are a table of any size, or a short list: :func:`with_terms` joins the words of the texts to the rarest
words of the terms, so that each text carries the few terms it may hold, and the pattern of a text is made of those alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from citeloom.functions.ordered import join_null_safe

EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\b\d{3}[ .-])\d{3}[ .-]\d{4}\b"

WORD = r"\w+"

# Entity types, their replacements, and the two scopes (input keeps author names).
REPLACEMENTS = {"EMAIL_ADDRESS": "[EMAIL]", "PHONE_NUMBER": "[PHONE]", "LOCATION": "[LOCATION]", "PERSON": "[PERSON]"}
INPUT_SCOPE = ["EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION"]
OUTPUT_SCOPE = ["EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION", "PERSON"]

# Cheap conditions every match meets, so that most texts skip the costly pattern.
_HINTS = {
    "EMAIL_ADDRESS": lambda text: F.contains(text, F.lit("@")),
    "PHONE_NUMBER": lambda text: F.rlike(text, F.lit(r"\d[ .-]\d{4}")),
}


def term_pattern(terms: Sequence[str] | Column) -> Column:
    """One alternation of whole terms, longest first. A column of terms is an array in that order, as :func:`with_terms` gives it."""
    if isinstance(terms, Column):
        quoted = F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
        return F.concat(F.lit(r"\b(?:"), F.array_join(quoted, "|"), F.lit(r")\b"))
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    return F.lit(r"\b(?:" + "|".join(re.escape(t) for t in ordered) + r")\b")


def with_terms(df: DataFrame, keys: Sequence[str], text: Column, terms: DataFrame, **columns: str) -> DataFrame:
    """``df`` with an array of terms for each of ``columns`` (name = kind): those of ``terms(kind, term)`` whose rarest word is in ``text``.

    Every word of a term is a whole word of the text that holds the term, so one of them is enough to join by; the one in the fewest terms brings
    the fewest together.
    ``text`` is a text or an array of texts. ``keys`` tell rows apart; rows that share them share their terms, which changes nothing: the
    pattern decides in the end. Terms without a letter or digit are left out.
    """
    found = text if isinstance(df.select(text).schema[0].dataType, ArrayType) else F.array(text)
    words = F.array_distinct(F.flatten(F.transform(found, lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(WORD), F.lit(0)))))
    wanted = terms.filter(F.col("kind").isin(*columns.values())).select("kind", "term").distinct()
    said = wanted.withColumn("__word", F.explode(F.array_distinct(F.regexp_extract_all("term", F.lit(WORD), F.lit(0)))))
    rare = said.join(said.groupBy("__word").agg(F.count(F.lit(1)).alias("n")), "__word")
    listed = rare.groupBy("kind", "term").agg(F.min(F.struct("n", (-F.length("__word")).alias("l"), "__word")).alias("best")).select(
        "kind", "term", F.col("best.__word").alias("__word"))
    met = df.select(*keys, F.explode(words).alias("__word")).join(listed, "__word")
    longest = F.sort_array(F.collect_set(F.struct((-F.length("term")).alias("n"), "term", "kind")))
    held = met.groupBy(*keys).agg(longest.alias("__held"))
    joined = join_null_safe(df, held, keys, "left")

    def of(kind: str) -> Column:
        return F.transform(F.filter(F.coalesce("__held", F.array()), lambda h: h["kind"] == kind), lambda h: h["term"])

    return joined.withColumns({name: of(kind) for name, kind in columns.items()}).drop("__held")


def _steps(scope: Sequence[str], **lists: Sequence[str] | Column) -> list[tuple[str, Callable[[Column], Column]]]:
    """What each entity type does to a text."""
    def replaced(kind: str, pattern: Column) -> Callable[[Column], Column]:
        return lambda text: F.regexp_replace(text, pattern, F.lit(REPLACEMENTS[kind]))

    def hinted(kind: str, pattern: str) -> Callable[[Column], Column]:
        return lambda text: F.when(_HINTS[kind](text), replaced(kind, F.lit(pattern))(text)).otherwise(text)

    def listed(kind: str, terms: Column) -> Callable[[Column], Column]:
        return lambda text: F.when(F.size(terms) > 0, replaced(kind, term_pattern(terms))(text)).otherwise(text)

    known = {"EMAIL_ADDRESS": hinted("EMAIL_ADDRESS", EMAIL_PATTERN), "PHONE_NUMBER": hinted("PHONE_NUMBER", PHONE_PATTERN)}
    for kind, terms in lists.items():
        if isinstance(terms, Column):
            known[kind] = listed(kind, terms)
        elif terms:
            known[kind] = replaced(kind, term_pattern(terms))
    return [(kind, known[kind]) for kind in REPLACEMENTS if kind in scope and kind in known]


def scrub(text: Column, scope: Sequence[str] = INPUT_SCOPE, *, locations: Sequence[str] | Column = (),
          persons: Sequence[str] | Column = ()) -> tuple[Column, Column]:
    """(redacted text, types found). E-mails go first, so a name inside one is not redacted twice.

    The state runs through arrays of one element, as a lambda's argument is evaluated once, however often it is used.
    """
    state = F.array(F.struct(text.alias("text"), F.array().cast("array<string>").alias("found")))
    for kind, replace in _steps(scope, LOCATION=locations, PERSON=persons):
        state = F.transform(F.transform(state, _changed(replace)), _noted(kind))
    return state[0]["text"], state[0]["found"]


def _changed(replace: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["text"].alias("before"), replace(s["text"]).alias("text"), s["found"].alias("found"))


def _noted(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        s["text"].alias("text"), F.when(s["before"] != s["text"], F.array_append(s["found"], F.lit(kind))).otherwise(s["found"]).alias("found"))


def scrub_list(texts: Column, scope: Sequence[str] = OUTPUT_SCOPE, *, locations: Sequence[str] | Column = (),
               persons: Sequence[str] | Column = ()) -> tuple[Column, Column]:
    """Redact every entry of an array; the types are the distinct ones over all entries."""
    done = F.transform(texts, lambda t: F.struct(*[c.alias(n) for n, c in zip(
        ("text", "found"), scrub(t, scope, locations=locations, persons=persons), strict=True)]))
    return F.transform(done, lambda d: d["text"]), F.array_distinct(F.flatten(F.transform(done, lambda d: d["found"])))


def entities(text: Column, terms: Sequence[str] | Column) -> Column:
    """Distinct terms that occur in a text, lower case, in order of appearance; a column of terms holds them in lower case."""
    if isinstance(terms, Column):
        return F.when(F.size(terms) > 0, F.array_distinct(F.regexp_extract_all(F.lower(text), term_pattern(terms), F.lit(0)))).otherwise(
            F.array().cast("array<string>"))
    return F.array_distinct(F.regexp_extract_all(F.lower(text), term_pattern([t.lower().strip() for t in terms]), F.lit(0)))
