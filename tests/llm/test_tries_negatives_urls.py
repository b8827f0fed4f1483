"""Prefix trie, hard negatives and URL filter against brute force on small and hand-made tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import hard_negatives, prefix_trie, queries, url_filter, vectors
from tests.conftest import SF

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, bytes string, pos string"


def plain_sequences(rows):
    """conversation id -> its turns in order."""
    held = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(own)] for c, own in held.items()}


def plain_trie(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(seqs.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = Counter(n[:-1] for n in members if n)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), kids[node], sum(not kids[n] for n in below), saved,
                    hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return sorted(out)


def trie_rows(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made_conversations():
    draw = np.random.default_rng(8)
    rows = []
    for c in [*range(-7, 60), 4095, 4096, 9000, 1 << 40]:
        for t in range(int(draw.integers(1, 7))):
            rows.append((c, t, "user" if t % 2 else "system", f"téxt {draw.integers(0, 2)}", "x", "x", "x"))
    rows += [(70, None, "b", "two", "", "", ""), (70, None, "a", "one", "", "", ""), (70, None, "a", "one", "", "", ""), (70, 3, None, None, "", "", "")]
    rows += [(71, 1, "u", "b", "", "", ""), (71, 1, "u", "a", "", "", ""), (None, 1, "u", "lost", "", "", ""), (72, 0, "u", "long " * 50_000, "", "", "")]
    return rows


@pytest.mark.parametrize(("shard", "segment"), [(10, 64), (2, 2)])
def test_trie_equals_brute_force(spark, shard, segment):
    rows = made_conversations()
    table = spark.createDataFrame(rows, CONVERSATIONS)
    assert trie_rows(prefix_trie.prefix_trie(table, shard=shard, segment=segment)) == plain_trie(plain_sequences(rows))


def test_trie_of_chains_of_paths(spark):
    """Each conversation leaves the one before it a turn later: paths hang on paths, as deep as there are conversations."""
    rows = [(c, t, "u", f"{t}" if t < c else f"own {c}", "", "", "") for c in range(1, 14) for t in range(c + 1)]
    got = trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)))
    assert got == plain_trie(plain_sequences(rows)) and len(got) == 1 + 13 + 13


def test_one_very_long_conversation(spark):
    rows = [(5, t, "u", str(t % 3), "", "", "") for t in range(500)] + [(6, t, "u", str(t % 3), "", "", "") for t in range(300)] + [(7, 0, "u", "0", "", "", "")]
    got = trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)))
    assert got == plain_trie(plain_sequences(rows))


def test_empty_table_has_no_nodes(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_query_rebuilds_heads(spark, tmp_path):
    rows = [r for r in made_conversations() if r[0] is not None]
    spark.createDataFrame(rows, CONVERSATIONS).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    own = plain_sequences(rows)
    rebuilt = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + seq[h:]
    assert any(not s for s in rebuilt.values())
    assert trie_rows(queries.op13_prefix_trie(spark, str(tmp_path))) == plain_trie(rebuilt)


def plain_negatives(rows, each, positives, negatives):
    """Every pair scored in Python's integers."""
    usable = {(i, tuple(v), x) for i, v, x, *_ in rows if i is not None and x is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    whole = [(i, [int(math.floor(256 * c)) if abs(c) < 1e300 else int(c) * 256 for c in v], x) for i, v, x in sorted(usable)]
    out = []
    for a in whole:
        if a[0] % each:
            continue
        scored = [(-sum(p * q for p, q in zip(a[1], b[1], strict=True)), b[0], b[2]) for b in whole if b is not a and len(b[1]) == len(a[1])]
        for top, positive, _ in sorted(s for s in scored if s[2] == a[2])[:positives]:
            fit = sorted(s for s in scored if s[2] != a[2] and 80 * -top <= 100 * -s[0] <= 100 * -top)[:negatives]
            out += [(a[0], positive, r + 1, n, -top, -s) for r, (s, n, _) in enumerate(fit)]
    return sorted(out)


VECTOR = "vec_id long, embedding array<double>, label int, size string, scores string"


@pytest.mark.parametrize("bytes_", [4 << 20, 400])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, bytes_):
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BYTES", bytes_)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", bytes_)
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(3, 9))
    rows = [(i, (centres[i % 3] + draw.normal(size=9) * 0.7).tolist(), int(draw.integers(0, 3)), "", "") for i in range(120)]
    rows += [rows[3], (200, None, 1, "", ""), (201, [float("nan")] * 9, 1, "", ""), (202, [None] * 9, 1, "", ""), (203, [], 1, "", ""), (None, [1.0] * 9, 1, "", ""),
             (204, [1.0] * 9, None, "", ""), (205, [1.0, 2.0], 1, "", ""), (210, [0.0] * 9, 1, "", ""), (220, rows[7][1], 2, "", ""), (221, rows[7][1], 1, "", "")]
    table = spark.createDataFrame(rows, VECTOR)
    got = sorted(map(tuple, hard_negatives.mine(table, vectors.every(10), 3, 4).collect()))
    assert got == plain_negatives(rows, 10, 3, 4) and len(got) > 20
    assert hard_negatives.mine(table.limit(0), vectors.every(10)).count() == 0


def test_hard_negatives_of_huge_components(spark):
    rows = [(0, [1e308, 1.0], 0, "", ""), (1, [1e308, 0.0], 0, "", ""), (2, [1e308, 2.0], 1, "", ""), (3, [-1e308, 0.0], 1, "", ""), (4, [1.0, 1.0], 1, "", "")]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTOR), F.col("id") == 0).collect()
    assert [(r.positive_id, r.negative_id, r.positive_score, r.negative_score) for r in sorted(got, key=lambda r: r.rank)] == [(1, n, (1 << 63) - 1, (1 << 63) - 1) for n in (2, 4)]


def test_summaries_bound_scores_and_leave_few_pairs():
    draw = np.random.default_rng(4)
    smooth = np.repeat(draw.normal(size=(2000, 16)), 4, axis=1) * 256 + draw.normal(size=(2000, 64))
    rows = np.floor(smooth)
    summaries, left, right = hard_negatives.Summaries(rows), np.arange(20), np.arange(20, 2000)
    exact = rows[left] @ rows[right].T
    widths = []
    for level in range(len(summaries.levels)):
        low, high = summaries.bounds(level, left, right)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert len(widths) == 3 and widths[0] > widths[1] > widths[2]
    open_ = hard_negatives.narrowed(summaries, left, right, np.ones(exact.shape, bool), hard_negatives.best_allow(5))
    assert open_.sum() < 0.02 * open_.size
    for i in range(20):
        assert open_[i, np.argsort(-exact[i])[:5]].all()


def test_dot_exact_at_the_limits():
    left, right = np.array([[2.0**52, 1.0], [3.0, 4.0]]), np.array([[3.0, 5.0], [1e300, -1.0], [0.0, 0.0]])
    assert vectors.dot_exact(left, right).tolist() == [[3 * 2**52 + 5, (1 << 63) - 1, 0], [29, (1 << 63) - 1, 0]]
    assert vectors.whole(np.array([1e308, -1e308, 0.3])).tolist() == [np.finfo(float).max, np.finfo(float).min, 76.0]


URLS = [("http://A.ORG/x", "a.org", "/x", "org/", "allow"), ("https://www.example.org/es/1?q", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"), ("http://a.com/fr/?x#y", "a.com", "/fr/", "com/fr/", "allow"),
        ("x://b.a.com/de/#", "b.a.com", "/de/", "com/de/", "block"), ("http://org", "org", "", None, None), ("http://q.net?a=://b.org/x", "q.net", "", None, None),
        (None, "", "", None, None), ("no scheme.org/x", "", "", None, None), ("", "", "", None, None), ("http://É.com/de/\n", "É.com", "/de/\n", "com/de/", "block"),
        ("http://" + "a." * 200_000 + "org/" + "p/1" * 400_000, "a." * 200_000 + "org", "/" + "p/1" * 400_000, "org/", "allow")]


def test_rules_hosts_and_paths(spark):
    table = spark.createDataFrame([(i, u, "x", "y") for i, (u, *_) in enumerate(URLS)] * 2, "page_id long, url string, host string, score string")
    got = url_filter.judge(table, queries.RULES).collect()
    assert sorted(got[0].asDict()) == ["host", "page_id", "path", "rule", "score", "url", "verdict"] and len(got) == 2 * len(URLS)
    for r in got:
        _, own_host, own_path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (own_host, own_path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_one_verdict_or_none_is_nothing_to_learn(spark):
    table = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/")], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge(table, queries.RULES).collect()} == {"allow"}
    only = url_filter.judge(table, [url_filter.Rule("block", "org", "/")]).collect()
    assert {(r.page_id, r.verdict) for r in only} == {(1, "block"), (2, "block")}
    assert url_filter.judge(table.limit(0), queries.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(table, []).collect()} == {"allow"}


def test_features_of_an_url():
    length, depth, digits, entropy, parameters, labels, hyphens = url_filter.lexical("http://a-b.c.net/x/12//y.html?p=1&q&#z/9")
    assert (length, depth, parameters, labels, hyphens) == (40.0, 3.0, 2.0, 3.0, 1.0) and digits == 4 / 40
    counts = Counter("http://a-b.c.net/x/12//y.html?p=1&q&#z/9")
    assert entropy == pytest.approx(-sum(n / 40 * math.log2(n / 40) for n in counts.values()))
    assert url_filter.lexical(None)[:2] == (0.0, 0.0)


def test_trees_learn_held_out_urls_and_agree_on_reruns(spark):
    """Blocked: long digit-rich paths with parameters, under a few suffixes more often."""
    draw = np.random.default_rng(6)
    rows = []
    for i in range(1600):
        bad = i % 2 == 1
        name = "".join(draw.choice(list("abcdefghij"), 6))
        own = f"http://{name}.{'bad' if bad and i % 3 else 'good'}.net/" + ("/".join(str(draw.integers(1e6)) for _ in range(3)) + "?a=1&b=2" if bad else "read/me")
        rows.append((i, own, url_filter.BLOCK if bad else url_filter.ALLOW))
    table = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    told, held = table.filter("page_id < 800"), table.filter("page_id >= 800").withColumnRenamed("verdict", "truth")
    model = url_filter.train(told, table, per_class=200)
    got = url_filter.judge(held, [], model)
    assert got.filter("verdict = truth").count() > 0.97 * 800
    again = url_filter.judge(held.repartition(5), [], url_filter.train(told.repartition(3), table.repartition(2), per_class=200))
    assert {(r.page_id, r.score) for r in got.collect()} == {(r.page_id, r.score) for r in again.collect()}


def test_query_judges_every_page(spark):
    got = queries.op11_url_filter(spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert got.count() == pages.count() and got.filter("verdict is null or verdict not in ('allow', 'block')").count() == 0
