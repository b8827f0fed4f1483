r"""Byte-level BPE: a heap of merge ranks over a doubly linked list of symbols.

``encode`` gives the ids of each whole text, ``decode`` concatenates the vocabulary's strings again. The
vocabulary is a tokenizer file whose path is a parameter; the driver reads it and sends its text along
(a vocabulary is a few MB whatever the data).

Defined results: a null text counts as empty; an empty text has no ids; ids outside the vocabulary and null ids
are skipped on decoding; bytes that are no UTF-8 decode to U+FFFD. Repeated rows each get their ids; other
columns pass through, and one named like the output column is replaced. A text of any length is cut
at word boundaries into pieces, never shortened; a single word of any length costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 1 << 20
PIECE_WORDS = 1 << 17
CACHE_BYTES = 64 << 20  # of each of the three tables of words seen
ENTRY_BYTES = 100  # of a table's entry, besides its letters and ids
PAIR = 24  # bits of an id

# How a text is cut into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Letters and numbers that Unicode 16 added to version 15.1.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def _stand_ins() -> dict[int, str]:
    """Characters that the regex library puts in another class than Unicode 16, each with one of the right class."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    here = dict.fromkeys(regex.findall(r"\p{L}", every), "L") | dict.fromkeys(regex.findall(r"\p{N}", every), "N")
    meant = {c: k for c in every if (k := unicodedata.category(c)[0]) in "LN"}
    for kind, ranges in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
        meant |= {chr(c): kind for a, b in ranges for c in range(a, b + 1)}
    return {ord(c): {"L": "a", "N": "1", "": "!"}[meant.get(c, "")] for c in here.keys() | meant.keys() if here.get(c) != meant.get(c)}


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte: itself if printable, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class _Words(dict):
    """Ids of words seen, as little-endian bytes. At ``most`` / 2 bytes the table becomes the older one, whose words move over when they are
    met again, and the one before is forgotten: frequent words stay."""

    def __init__(self, ids_of: Callable[[str], bytes], most: int = CACHE_BYTES) -> None:
        super().__init__()
        self.ids_of, self.most, self.held, self.older = ids_of, most, 0, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self.ids_of(word)
        if len(word) < 64:
            self.held += ENTRY_BYTES + len(word) + len(ids)
            if self.held > self.most // 2:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[word] = ids
        return ids


class Decoder:
    """Decodes one list of ids at a time."""

    def __init__(self, spec: str) -> None:
        model, letters = json.loads(spec), _byte_letters()
        strings = {i: bytes(letters[c] for c in token) for token, i in model["model"]["vocab"].items()}
        strings |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; those outside the vocabulary are skipped."""
        known = ids[(ids >= 0) & (ids < len(self.strings))]
        return b"".join(map(self.strings.__getitem__, known.tolist())).decode("utf-8", "replace")


class Codec(Decoder):
    """Encodes and decodes one text at a time."""

    def __init__(self, spec: str) -> None:
        super().__init__(spec)
        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        self.of_byte = [vocab[c] for c, _ in sorted(_byte_letters().items(), key=lambda x: x[1])]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[left] << PAIR | vocab[right]] = rank
            self.made.append(vocab[left + right])
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
            raise ValueError("added tokens that strip or need word ends are not supported")
        self.added = {s: np.array([i], "<u4").tobytes() for s, i in added.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pattern = regex.compile(WORDS)
        self.stand_ins = _stand_ins()
        # Any character beyond U+FFFF counts as odd: one range is found fast, thousands of single characters are not.
        low = "".join(re.escape(chr(c)) for c in sorted(self.stand_ins) if c <= 0xFFFF)
        self.odd = [re.compile(f"[{c}]") for c in (low, "\U00010000-\U0010ffff") if c]
        self.loose = re.compile(r" (?=\s|\Z)")
        self.words = _Words(self._of_word)
        self.first = _Words(self._of_run)
        self.later = _Words(lambda run: self._of_run(" " + run))

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: always the lowest rank, leftmost first, until no neighbours merge."""
        rank_of, made, n = self.ranks.get, self.made, len(word)
        place = max(14, n.bit_length())  # small entries of the heap are quicker to compare
        places = (1 << place) - 1
        ids = [self.of_byte[b] for b in word]
        heap, last, i = [], ids[0], 0
        for x in ids[1:]:
            if (r := rank_of(last << PAIR | x)) is not None:
                heap.append(r << place | i)
            last = x
            i += 1
        if not heap:
            return ids
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ids.append(-1)
        while heap:
            top = pop(heap)
            i = top & places
            rank, left, j = top >> place, ids[i], after[i]
            if left < 0 or ids[j] < 0 or rank_of(left << PAIR | ids[j]) != rank:
                continue  # stale: one of the two was merged meanwhile
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(ids[i] << PAIR | ids[k])) is not None:
                    push(heap, r << place | i)
            k = before[i]
            if k >= 0 and (r := rank_of(ids[k] << PAIR | ids[i])) is not None:
                push(heap, r << place | k)
        return [i for i in ids if i >= 0]

    def _of_word(self, word: str) -> bytes:
        return np.array(self.merged(word.encode()), "<u4").tobytes()

    def _of_run(self, run: str) -> bytes:
        """Ids of what lies between blanks; one that is a single word is kept once, as a run."""
        found = self.pattern.findall(run)
        return self._of_word(run) if len(found) == 1 else b"".join(map(self.words.__getitem__, found))

    def _part(self, text: str) -> Iterator[bytes]:
        """Ids of a text without added tokens. A blank before a word always begins a word, so that a text can be
        cut there first; texts with other blanks, or with odd characters, are cut by the pattern."""
        if not text.isascii() and any(odd.search(text) for odd in self.odd):
            spans = (m.span() for m in self.pattern.finditer(text.translate(self.stand_ins)))
            found, ids_of = (text[a:b] for a, b in spans), self.words
        elif self.loose.search(text):
            found, ids_of = (m[0] for m in self.pattern.finditer(text)), self.words
        elif len(text) <= PIECE_CHARS:
            head, *rest = text.split(" ")
            yield self.first[head] + b"".join(map(self.later.__getitem__, rest))
            return
        else:
            found, ids_of = (m[0] for m in re.finditer(r" ?[^ ]+", text)), self.first
        while some := list(islice(found, PIECE_WORDS)):
            yield b"".join(map(ids_of.__getitem__, some))

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of the whole text as little-endian bytes, piece by piece."""
        at = 0
        for special in self.cut.finditer(text) if self.cut else ():
            yield from self._part(text[at:special.start()])
            yield self.added[special[0]]
            at = special.end()
        yield from self._part(text[at:] if at else text)


_kept: dict[type, tuple[str, Decoder]] = {}


def codec(spec: str, kind: type[Decoder] = Codec) -> Decoder:
    """One codec and one decoder per Python worker: those of the last vocabulary asked for."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if _kept.get(kind, ("",))[0] != key:
        _kept[kind] = key, kind(spec)
    return _kept[kind][1]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _encoded(own: Codec, texts: pa.Array, checked: bool) -> pa.Array:
    """Ids of a batch; if ``checked``, with a flag whether they decode to the text again."""
    parts, ends, same = [], [0], []
    for t in texts:
        text = t.as_py() or ""
        ids = b"".join(own.encode(text))
        parts.append(ids)
        ends.append(ends[-1] + len(ids) // 4)
        if checked:
            same.append(own.decode(np.frombuffer(ids, "<u4")) == text)
    ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
    return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], names=["ids", "same"]) if checked else lists


def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", checked: str | None = None) -> DataFrame:
    """``docs`` with ``out``: array<int>, the ids of each whole text. ``vocabulary``: path of a tokenizer file.

    ``checked`` names a column that tells whether the ids, decoded in the same task, are the text again.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = "struct<ids: array<int>, same: boolean>" if checked else "array<int>"
    flagged = checked is not None

    def run(texts: pa.Array) -> pa.Array:
        return _encoded(codec(spec.value), texts, flagged)

    # Not to be repeated by each expression that uses the ids.
    coded = docs.withColumn(out, F.arrow_udf(run, kind).asNondeterministic()(F.col(text)))
    return coded.withColumn(checked, F.col(f"{out}.same")).withColumn(out, F.col(f"{out}.ids")) if checked else coded


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the text that ``ids`` stand for, special tokens included."""
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(lists: pa.Array) -> pa.Array:
        own = codec(spec.value, Decoder)
        return pa.array((own.decode(x.values.drop_null().to_numpy()) if x.is_valid else "" for x in lists), type=pa.string())

    return docs.withColumn(out, F.arrow_udf(run, "string")(F.col(ids)))


def _ids_digest(lists: pa.Array) -> pa.Array:
    return pa.array((hashlib.sha256(x.values.drop_null().to_numpy().astype("<u4").tobytes() if x.is_valid else b"").hexdigest()
                     for x in lists), type=pa.string())


def with_ids_digest(docs: DataFrame, ids: str = "ids", out: str = "ids_sha256") -> DataFrame:
    """``docs`` with ``out``: SHA-256 of the ids as little-endian unsigned 32-bit integers."""
    return docs.withColumn(out, F.arrow_udf(_ids_digest, "string")(F.col(ids)))
