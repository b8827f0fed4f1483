"""Language, byte-level BPE, token counts, page text and personal data against plain versions of each."""

import hashlib
import random
import time
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from citeloom.llm import bpe, html_text, langid, pii, wordpiece
from tests.conftest import SF

BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(BPE))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def ids_of(codec, text):
    return np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()


def test_bpe_equals_the_library_on_random_texts(codec, tokenizer):
    draw = random.Random(5)
    pieces = [" "] * 6 + list("abcdest'RV") + ["'s", "'re", "\n", "\t", "  ", "1", "²", "é", "ß", "中", "\U0001f600", "Ᲊ", "\U000105c0", "\x1c",
                                            "\x85", "\xa0", "　", "<|endoftext|>", "<|endof", "!", "...", "՘", "\U00010d40", "_", "\r\n", "\x00", "Ⅷ"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 14)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids_of(codec, text) == want, repr(text)
        assert codec.decode(np.array(want, np.int32)) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_long_words_and_texts(codec, tokenizer):
    text = "a" * 50_000 + " word" * 300_000 + " \n" + "xyz" * 5
    assert ids_of(codec, text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_on_rows(spark, tokenizer):
    docs = spark.createDataFrame([(1, "It's here", 5), (2, None, 6), (3, "", 7), (1, "It's here", 5)], "doc_id long, text string, ids long")
    coded = bpe.encode(docs, BPE)
    rows = bpe.with_ids_digest(bpe.decode(coded, BPE)).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [tokenizer.encode("It's here", add_special_tokens=False).ids] * 2 + [[], []]
    assert [r.decoded for r in rows] == ["It's here"] * 2 + ["", ""]
    assert rows[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(docs.limit(0), BPE).count() == 0
    odd = spark.createDataFrame([([10**6, None, -1, 198],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, BPE).collect()] == ["\n", ""]


def test_token_counts_equal_greedy_longest_match():
    pieces = wordpiece.read_pieces(PIECES)
    known, own = set(pieces), wordpiece.Automaton(pieces)

    def greedy(word):
        """Longest piece from the left of the mark and the word."""
        whole, at, n = wordpiece.MARK + word, 0, 0
        while at < len(whole):
            end = next((e for e in range(len(whole), at, -1) if whole[at:e] in known and not (at and whole[at] == wordpiece.MARK)), None)
            if end is None:
                return -1
            at, n = end, n + 1
        return n

    for word in ("çtre", "êré", "日本語", "1234", "the", "zzzz"):
        assert own.count(word) == greedy(word) > 0, word
    draw = random.Random(1)
    for _ in range(5000):
        word = "".join(draw.choice("abtheing▁中é#") for _ in range(draw.randint(1, 12)))
        assert own.count(word) == greedy(word), word
    assert own.totals("the  cat\n\U0001f9ff") == (3, greedy("the") + greedy("cat") + 1, 1)
    assert own.totals("the cat " * 400_000)[0] == 800_000


def test_token_counts_on_rows(spark):
    docs = spark.createDataFrame([(1, "the cat", 9), (2, None, 9), (3, " \t", 9)], "doc_id long, text string, n_tokens long")
    rows = wordpiece.count_tokens(docs, PIECES).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_unknown) for r in rows] == [(2, 0), (0, 0), (0, 0)] and [r.n_tokens for r in rows[1:]] == [0, 0]
    assert wordpiece.count_tokens(docs.limit(0), PIECES).count() == 0


def plain_counts(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    found = {}
    for word in words:
        padded = f" {word} "
        grams = list(word) + [padded[i:i + 2] for i in range(len(padded) - 1)] + [padded[i:i + 3] for i in range(len(padded) - 2)]
        for g in grams:
            found[g] = found.get(g, 0) + 1
    return found


def gram(code):
    return "".join(chr(c) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


@pytest.mark.parametrize("text", ["Ab, ba b!", "x", "", " ", "Élan  vital 12", "ab" * 40, "\U00010400a"])
def test_gram_counts(text, monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 7)
    codes, counts = langid.gram_counts(text)
    got = {gram(int(c)): int(n) for c, n in zip(codes, counts, strict=True)}
    want = plain_counts(text)
    twice = {g: n for g, n in got.items() if want.get(g) != n}
    # A blank between two words belongs to both; as a pair it is counted once for each word, like here.
    assert not twice and got.keys() == want.keys()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", langid.held_out(langid.F.col("doc_id")))
    learned = langid.profiles(docs.filter("not held"))
    assert learned.groupBy("lang").count().agg({"count": "max"}).first()[0] <= langid.PROFILE
    rows = langid.predict(docs.filter("held"), learned).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_equals_plain_out_of_place_distances(spark):
    """Every document of the smallest table against a dictionary version of profiles and distances."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]

    def best(counts):
        return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:langid.PROFILE]

    totals = {}
    for _, text, lang in rows:
        if lang is not None and text is not None:
            own = totals.setdefault(lang, {})
            for g, n in plain_counts(text).items():
                own[g] = own.get(g, 0) + n
    ranks = {lang: {g: i for i, g in enumerate(best(counts))} for lang, counts in totals.items()}

    def plain(text):
        own = best(plain_counts(text or ""))
        if not own:
            return "und", 0.0
        far = {lang: sum(abs(i - known[g]) if g in known else langid.PROFILE for i, g in enumerate(own)) for lang, known in ranks.items()}
        lang = min(far, key=lambda x: (far[x], x))
        return lang, 1 - far[lang] / (langid.PROFILE * len(own))

    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.profiles(docs)).collect()}
    assert len(ranks) > 2 and got == {i: (lang, pytest.approx(score)) for i, text, _ in rows for lang, score in [plain(text)]}


def test_language_defined_results(spark):
    docs = spark.createDataFrame([(1, "der die das", "de", 1), (2, None, "de", 1), (3, "12 ...", None, 1), (4, "das", None, 1), (5, "中", None, 1)],
                                 "doc_id long, text string, lang string, score long")
    rows = {r.doc_id: r for r in langid.predict(docs, langid.profiles(docs)).collect()}
    assert [rows[i].lang_pred for i in range(1, 6)] == ["de", "und", "und", "de", "de"]
    assert rows[5].score == 0 and rows[2].score == 0
    nothing = langid.predict(docs, langid.profiles(docs.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def digits(m):
        return [int(c) for c in m[0] if c in "0123456789"]

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def test_base_spans_equal_the_patterns():
    draw = random.Random(3)
    pieces = list("aé.@-+%_ 0123456789") + ["4111 1111 1111 1111", "10.0.0.1", "+1 (743) 555-3824", "a.b@c.de", "..", "--", "256"]
    for _ in range(20_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 12)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)


def test_added_spans_need_checksum_or_context():
    def kinds(text):
        return [(s["kind"], text[s["start"]:s["end"]]) for s in pii.spans_of(text)]

    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("GB29 NWBK 6016 1331 9268 19 OK") == [("iban", "GB29 NWBK 6016 1331 9268 19")]
    assert kinds("DE89 3704 0044 0532 0130 00 GB29 NWBK 6016 1331 9268 19 EUR 50") == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB29 NWBK 6016 1331 9268 19")]
    assert kinds("ssn 123-45-6789") == [("ssn", "123-45-6789")] and kinds("part 123-45-6789") == []
    assert kinds("call (743) 555-3824") == [("tel", "(743) 555-3824")] and kinds("sum (743) 555-3824") == []
    assert pii.spans_of("mail a@b.cd")[0]["score"] > pii.spans_of("see a@b.cd")[0]["score"]
    assert pii.redacted("x a@b.cd y +1 743 555 3824") == "x [EMAIL] y [PHONE]"


def test_pii_long_and_odd_texts(spark):
    long = "9" * 200_000 + " " + "a" * 200_000 + " " + "1." * 100_000 + " z@y.xw"
    assert [s["kind"] for s in pii.spans_of(long)][-1] == "email"
    docs = spark.createDataFrame([(1, "a@b.cd", "k"), (2, None, "k"), (3, "", "k")], "doc_id long, text string, pii_spans string")
    rows = pii.find_pii(docs).orderBy("doc_id").collect()
    assert [len(r.pii_spans) for r in rows] == [1, 0, 0]
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["[EMAIL]", None, ""]
    assert pii.find_pii(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("html", "text"), [
    ("<p>a<p>b<div>c", "a\n\nb\n\nc"),
    ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>z", "- one\n- two\n  3. x\n  4. y\n\nz"),
    ("<table><caption>T</caption><tr><th>a<th>bb<tr><td>ccc<td>d</table>", "T\na    bb\nccc  d"),
    ("<table><tr><td rowspan=2>x<td>y<tr><td>z</table>", "x  y\n   z"),
    ("<p hidden>no</p><p style='display: none'>no</p><div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<head><title>t</title></head><script>var a='</p>'</script><p>a&amp;b<!-- c -->", "a&b"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("</p></table><b><i>w</b></i>  v", "w v"),
    ("", ""), (None, ""), ("<td>loose<li>", "loose"),
    ("<table><tr><td>a<table><tr><td>n<td>m</table><td>b</table>", "a     b\n\nn  m"),
    ("<table><tr><td><h1>T</h1><p>one<p>two<ul><li>x<li>y</ul><td>side<br>bar</table>end", "T    side\n     bar\none\n\ntwo\n\n- x\n- y\n\nend"),
    ("<table><tr><td>日本<td>a<tr><td>xxxxx<td>b</table>", "日本   a\nxxxxx  b"),
    ("<![ endif]>a<![<p>b<![*] c>d<!-->e<!--->f<?php x ?>g</ >h", "abdefgh"), ("a<![%x", "a"), ("1 < 2 &#99999999999; &#x41;", "1 < 2 \ufffd A"),
    ("a<b", "a"), ("<a href='x", ""), ("<p a=1 a=\"hidden\" / >x", "x"), ("<textarea><b>&amp;</textarea>x<title>no", "<b>&x"), ("<svg><text><![CDATA[a<b]]></text></svg>", "a<b"),
])
def test_page_text(html, text):
    assert html_text.page_text(html) == text


@pytest.mark.parametrize("html", [
    "<a " * 300_000, "<x><table><td>" + "<span>" * 80_000 + "</x>" * 100_000, "<!--" * 250_000, "<![ " * 250_000, "<ul><li>" * 100_000 + "x", "<" * 1_000_000,
    "<a b=\"" * 150_000, "&#" * 500_000, "&#" + "9" * 1_000_000, "<script>" * 120_000, "<table><tr><td>" * 50_000 + "x", "<td>" * 200_000, "<svg><p>" * 100_000])
def test_malformed_pages_take_linear_time(html):
    """A megabyte each; quadratic work would take minutes."""
    start = time.process_time()
    assert len(html_text.page_text(html)) <= len(html) + 200
    assert time.process_time() - start < 20


def test_any_mix_of_markup_gives_a_text():
    draw = random.Random(12)
    pieces = ["<", ">", "/", "!", "--", "[", "]", "'", '"', "=", "&", "#", ";", " ", "a", "p", "td", "table", "svg", "script", "<p>", "</p>", "<li>", "<![CDATA[", "]]>", "\0", "é"]
    for _ in range(4000):
        html_text.page_text("".join(draw.choice(pieces) for _ in range(draw.randint(1, 40))))


def test_pages_deep_and_on_rows(spark):
    assert html_text.page_text("<div>" * 100_000 + "x") == "x"
    pages = spark.createDataFrame([(1, "<p>a", "old"), (2, None, "old")], "page_id long, html string, text string")
    assert [r.text for r in html_text.extract(pages).orderBy("page_id").collect()] == ["a", ""]
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html, text", [
    ('<body><svg class="i"/><p>text</p></body>', "text"), ("<p>a <math/> b</p>", "a b"), ("<div/>inner", "inner"),
    ('<p>see</p><svg><g><path d="M0"/><circle r="1"/></g>no<text>one <tspan>two</tspan></text><text x="1">three</text></svg><p>end</p>', "see\n\none two\nthree\n\nend"),
    ("<svg><title>t</title><desc>d</desc><metadata>m</metadata><defs><text>f</text></defs><symbol><text>s</text></symbol><text display='none'>n</text></svg>after", "after"),
    ("<svg><foreignObject><p>html <b>in</b> it</p><div/>still</foreignObject></svg>x", "html in it\n\nstill\nx"),
    ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mspace/><mn>2</mn></mrow><annotation>tex</annotation></semantics></math> holds</p>", "so x=2 holds"),
    ("<svg><path><p>broke out</p>", "broke out"),
])
def test_svg_and_math(html, text):
    assert html_text.page_text(html) == text
    deep = html_text.page_text("<svg>" + "<g>" * 50_000 + "<path/>" * 50_000 + "<text>x")
    assert deep == "x"
