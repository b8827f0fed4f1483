r"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (always kept once their check passes): ``email``, ``ip`` (parts at most 255), ``card`` (14 to 19
digits, Luhn) and ``phone`` (+, 10 to 15 digits). Added kinds (kept from a score of ``MIN_SCORE``): ``iban``
(mod 97), ``ssn`` and ``tel`` (national numbers), the last two only near a context word. An added span
that overlaps a base span is dropped, so base spans never change.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows each get their own
spans; every other column is passed through. A column named like an output column is replaced.
Every pattern is linear in the text, so texts of any length are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "tel")
KINDS = BASE_KINDS + ADDED_KINDS
MIN_SCORE = 0.6
CONTEXT_CHARS = 48
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

# Score of a span before and after a context word is seen near it.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.95),
          "iban": (0.9, 1.0), "ssn": (0.35, 0.85), "tel": (0.4, 0.8)}
CONTEXT = {
    "email": "mail|contact|address|correo|kontakt",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|debit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|cell|telefon|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
    "tel": "phone|call|tel|mobile|cell|telefon|fax",
}
_NEAR = {kind: re.compile(rf"(?<![^\W\d_])(?:{words})", re.I) for kind, words in CONTEXT.items()}

# The look-behinds only skip starts that cannot begin a leftmost match: a run of digits matches from its first digit or not at all.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled; the digit sum must end in 0."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35, remainder 1 by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the part before an @ reaches back to the last character it may not hold."""
    done = 0
    for match in _AT.finditer(text):
        at = start = match.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = match.end()
            yield start, done


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each run that may be an IBAN, the longest part from its start that ends before a blank (or the run's end) and passes the check."""
    at = 0
    while m := _IBAN.search(text, at):
        run, at = m[0], m.start() + 1
        ends = [len(run), *(i for i in range(len(run) - 1, 0, -1) if run[i] == " ")]
        for end in ends:
            if len(bare := run[:end].replace(" ", "")) >= 15 and mod97(bare):
                at = m.start() + end
                yield m.start(), at
                break


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind in the order listed."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the added kinds, leftmost first, clear of the base spans and of each other."""
    taken = [(a, b) for _, a, b in base]
    proposed = [("iban", *span) for span in _ibans(text)]
    proposed += [(kind, *m.span()) for kind, p in (("ssn", _SSN), ("tel", _TEL)) for m in p.finditer(text)]
    found: list[tuple[str, int, int]] = []
    edges = iter([*sorted(taken), (len(text) + 1, len(text) + 1)])
    a, b = next(edges)
    reach = 0
    for kind, start, end in sorted(proposed, key=lambda s: (s[1], KINDS.index(s[0]))):
        while a < start:
            reach = max(reach, b)
            a, b = next(edges)
        if start >= reach and end <= a:
            found.append((kind, start, end))
            reach = end
    return found


def scored(text: str, span: tuple[str, int, int]) -> float:
    kind, start, end = span
    near = _NEAR[kind]
    hit = near.search(text, max(0, start - CONTEXT_CHARS), start) or near.search(text, end, end + CONTEXT_CHARS)
    return SCORES[kind][1 if hit else 0]


def spans_of(text: str | None) -> list[dict]:
    """All spans that are kept, by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    base = base_spans(text)
    rated = [(*s, scored(text, s)) for s in base]
    rated += [(*s, r) for s in added_spans(text, base) if (r := scored(text, s)) >= MIN_SCORE]
    rated.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [{"kind": k, "start": a, "end": b, "score": r} for k, a, b, r in rated]


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at, reach = [], 0, 0
    for span in spans_of(text):
        if span["start"] >= reach:
            out += [text[at:span["start"]], f"[{span['kind'].upper()}]"]
        reach = at = max(reach, span["end"])
    return text if not out else "".join([*out, text[at:]])


def _find(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    return pa.array((spans_of(t.as_py()) for t in texts), type=kind)


def _redact(texts: pa.Array) -> pa.Array:
    return pa.array((redacted(t.as_py()) for t in texts), type=pa.string())


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with ``out``: spans (kind, start, end in code points, score) of each whole text."""
    return docs.withColumn(out, F.arrow_udf(_find, SPANS)(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by placeholders; a null text stays null."""
    return docs.withColumn(text, F.arrow_udf(_redact, "string")(F.col(text)))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
