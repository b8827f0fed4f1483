"""Token counts by greedy longest match: a vocabulary trie with failure links and popped-token counts.

A word is cut into the longest piece of the vocabulary that begins it, then the longest piece that goes on, and so
forth. A word begins with the word mark, which may be a piece alone; a word that cannot be cut this way counts as one unknown token. The pieces are never built: every
node of the trie knows how many tokens are complete once its text cannot be extended, and the node of what remains of it
(the failure link), so a word is read once, letter by letter.

The vocabulary is a sentence-piece model whose path is a parameter: pieces that begin with the word mark begin words, all
others go on. The driver reads it and sends the pieces along (a vocabulary is a few MB whatever the data).

Defined results: null, empty and blank texts have no tokens. Words are runs without ASCII white space. Repeated rows each
get their counts; columns of the same names are replaced, others pass through. Texts and words of any length are
read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PIECE = 1 << 20
CACHED_WORDS = 500_000
_BLANK = re.compile(rb"\s")
COUNTS = "struct<words:bigint,tokens:bigint,unknown:bigint>"


class Automaton(dict):
    """Counts the tokens of a word; as a dict it keeps the counts of words seen (-1: cannot be cut)."""

    def __init__(self, pieces: list[str]) -> None:
        super().__init__()
        self.child: list[dict[str, int]] = [{}, {}]  # node 0: begin of a word, node 1: within a word
        ends = [False, False]
        alone = MARK in pieces
        for piece in pieces:
            begins = piece.startswith(MARK)
            node = 0 if begins else 1
            for letter in piece[1:] if begins else piece:
                after = self.child[node].get(letter)
                if after is None:
                    after = self.child[node][letter] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                node = after
            if node > 1:
                ends[node] = True
        self.fail, self.pops = self._links(ends, alone)

    def _links(self, ends: list[bool], alone: bool) -> tuple[list[int], list[int]]:
        """Failure link of each node (-1: none) and the tokens that are complete when it is followed, in order of depth."""
        fail, pops = [-1] * len(ends), [0] * len(ends)
        if alone:  # where no longer piece begins the word, the mark alone does
            fail[0], pops[0] = 1, 1
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for letter, node in self.child[parent].items():
                if ends[node]:
                    fail[node], pops[node] = 1, 1
                else:
                    link, popped = fail[parent], pops[parent]
                    while link >= 0 and letter not in self.child[link]:
                        popped += pops[link]
                        link = fail[link]
                    if link >= 0:
                        fail[node], pops[node] = self.child[link][letter], popped
                queue.append(node)
        return fail, pops

    def count(self, word: str) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        node, tokens = 0, 0
        for letter in word:
            while (after := child[node].get(letter)) is None:
                tokens += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = after
        while node != 1:
            tokens += pops[node]
            node = fail[node]
            if node < 0:
                return -1
        return tokens

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        tokens = self.count(word.decode())
        if len(word) < 64:
            self[word] = tokens
        return tokens

    def totals(self, text: str) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text; an unknown word is one token."""
        words = tokens = unknown = 0
        for part in parts(text.encode()):
            found = list(map(self.__getitem__, part.split()))
            bad = found.count(-1)
            words += len(found)
            unknown += bad
            tokens += sum(found) + 2 * bad
        return words, tokens, unknown


def parts(data: bytes) -> Iterator[bytes]:
    """A long text in pieces cut at white space."""
    at = 0
    while at < len(data):
        blank = _BLANK.search(data, at + PIECE)
        end = blank.start() if blank else len(data)
        yield data[at:end]
        at = end


_automata: dict[str, Automaton] = {}


def automaton(pieces: list[str], key: str) -> Automaton:
    """One automaton per Python worker and vocabulary."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(pieces)
    return _automata[key]


def read_pieces(path: str) -> list[str]:
    """The pieces of a model, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_tokens`` and ``n_unknown`` of each whole text."""
    pieces = read_pieces(vocabulary)
    key = hashlib.sha256("\n".join(pieces).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(texts: pa.Array) -> pa.Array:
        own = automaton(sent.value, key)
        found = [own.totals(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["words", "tokens", "unknown"])

    kept = [c for c in docs.columns if c not in ("n_words", "n_tokens", "n_unknown", "__counts")]
    counted = docs.withColumn("__counts", F.arrow_udf(run, COUNTS)(F.col(text)))
    return counted.select(*[F.col(f"`{c}`") for c in kept], F.col("__counts.words").alias("n_words"),
                          F.col("__counts.tokens").alias("n_tokens"), F.col("__counts.unknown").alias("n_unknown"))
