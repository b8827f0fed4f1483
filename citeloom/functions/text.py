"""Text clean-up, theme-name keys, token estimates, sentence splitting, slugs, previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what they become.
LIGATURES = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl",
    "\ufb05": "ft", "\ufb06": "st",
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"',
    "\u2013": "-", "\u2014": "--", "\u2026": "...", "\u00a0": " ",
    "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "",
}


def normalize_text(text: Column) -> Column:
    """Ligatures, curly quotes, dashes, ellipsis, hard and zero-width spaces to plain text."""
    single = {k: v for k, v in LIGATURES.items() if len(v) == 1}
    gone = [k for k, v in LIGATURES.items() if not v]
    plain = F.translate(text, "".join([*single, *gone]), "".join(single.values()))
    several = {k: v for k, v in LIGATURES.items() if len(v) > 1}
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), several.items(), plain)


def parse_authors(line: Column) -> Column:
    """Author list of a line: split on ';' when there is one, else on ','; blanks dropped."""
    pieces = F.when(F.contains(line, F.lit(";")), F.split(line, ";")).otherwise(F.split(line, ","))
    return F.filter(F.transform(pieces, strip), lambda a: a != "")


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_theme_name(name: Column) -> Column:
    """Comparison key: lower case, trimmed, runs of whitespace, '_' and '-' become one blank."""
    return F.regexp_replace(strip(F.lower(name)), r"(?U)[\s_\-]+", " ")


def estimate_tokens(text: Column) -> Column:
    """About four characters per token, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def split_sentences(text: Column) -> Column:
    """Pieces after '.', '!' or '?' followed by whitespace, trimmed, blanks dropped."""
    pieces = F.split(strip(text), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def slugify(text: Column) -> Column:
    """Lower case, other characters become '-', one '-' trimmed at each end."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "(^-|-$)", "")


PREVIEW = 200
CONTEXT = 300


def preview(text: Column, length: int = PREVIEW) -> Column:
    """Whole text up to ``length`` characters, else cut to end with '...' at that length."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def head(text: Column, length: int = CONTEXT) -> Column:
    return F.substring(text, 1, length)


def theme_text(name: Column, description: Column) -> Column:
    """Text a theme is embedded by."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit(": "), F.coalesce(description, F.lit("")))


def metric_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def format_duration(ms: Column) -> Column:
    """'42s' or '3m 5s' from milliseconds, rounded half up to whole seconds."""
    seconds = F.floor(ms / 1000 + 0.5)
    short = F.concat(seconds.cast("string"), F.lit("s"))
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.pmod(seconds, F.lit(60)).cast("string"), F.lit("s"))
    return F.when(seconds < 60, short).otherwise(minutes)


def author_preview(authors: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(authors, 1, n), ", ")


def is_uuid(value: Column) -> Column:
    """True for a well-formed UUID text: 32 hex digits, dashes, braces and 'urn:uuid:' ignored."""
    digits = F.regexp_replace(F.regexp_replace(value, "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "")
    return F.coalesce(F.rlike(digits, F.lit("^[0-9a-fA-F]{32}$")), F.lit(False))


def point_id(value: Column) -> Column:
    """The value itself when it is a UUID, else one made from its hash, the same on every retry."""
    h = F.md5(F.coalesce(value, F.lit("")))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(is_uuid(value), value).otherwise(made)
