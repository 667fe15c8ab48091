"""Operators 11 to 13 against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrid.llm import queries, ranked_search, source_audit, url_filter
from tests.llm.brute import LOW

LONG = " ".join(f"w{i % 977}é" for i in range(30_000))


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# --- 11: URL filters

RULES = queries.URL_RULES
HUB = '<link href="https://hub.example.org/x" rel="canonical">'
PAGES = [
    (1, "https://A.b.NET/en/1?x#y", None),
    (2, "http://m.example.net/en/25#top", ""),
    (3, "http://example.com/de/1", "x"),
    (4, "http://notexample.com/de/1", HUB),
    (5, "https://other.example.com/x", '<head><LINK data-x=1 REL="alternate Canonical" HREF="http://example.com/de/9"></head>'),
    (6, "https://third.example.com/y?utm_source=a", "<meta http-equiv='refresh' content='0; url=https://other.example.com/x'>"),
    (7, "http://third.example.com:80/y", "plain"),
    (8, "http://x.example.org/fr/2", '<link rel=canonical href=http://spam.net/>'),
    (9, "http://y.example.org/de/2", '<!-- <link rel="canonical" href="http://spam.net/"> --><script>"<link rel=canonical href=http://spam.net/>"</script>'),
    (10, "http://z.example.org/a/b", '<link rel="canonical" href="/c"/>'),
    (11, "http://z.example.org/c", '<link rel="canonical" href="d?p=1&amp;q=2">'),
    (12, "http://z.example.org/d?p=1&q=2", '<link rel="canonical" href="//spam.net/q">'),
    (13, None, '<link rel="canonical" href="http://spam.net/">'),
    (14, "no scheme/net/", None),
    (15, "", None),
    (15, "", None),
    (16, "http://spam.net", None),
    (17, "http://www.mirror.org/p", '<link rel="canonical" href="mailto:x@y.net">'),
    (18, "http://mirror.org/p", '<link rel="canonical" href="http://bad.net/p">'),
    (19, "http://user@allowed.org:8080/fr/", " " * 10000 + '<link rel="canonical" href="http://bad.net/p">'),
    (20, "ftp://chain.org/1", '<link rel="canonical" href="http://chain.org/2">'),
    (21, "http://chain.org/2", '<link rel="canonical" href="http://chain.org/3">'),
    (22, "http://chain.org/3", '<link rel="canonical" href="http://chain.org/1">'),
    (23, "https://two.org/?a://b/net/", None),
    *((100 + i, f"http://copy{i}.org/x", HUB) for i in range(30)),
]
WANT = {
    1: ("net/", "block", "rule"), 2: ("example.net/en/", "allow", "rule"), 3: ("example.com/de/", "block", "rule"), 4: (None, "allow", "none"), 5: (None, "block", "alias"), 6: (None, "block", "alias"),
    7: (None, "block", "alias"), 8: ("org/fr/", "allow", "rule"), 9: (None, "allow", "none"), 10: (None, "block", "alias"), 11: (None, "block", "alias"), 12: (None, "block", "alias"),
    13: (None, "allow", "none"), 14: (None, "allow", "none"), 15: (None, "allow", "none"), 16: (None, "block", "alias"), 17: (None, "block", "alias"), 18: (None, "block", "alias"),
    19: (None, "allow", "alias"), 20: (None, "allow", "none"), 21: (None, "allow", "none"), 22: (None, "allow", "none"), 23: (None, "allow", "none"),
}


@pytest.fixture(scope="module")
def pages(spark):
    d = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    return d.withColumns({c: F.lit(0) for c in ("host", "path", "node", "rule", "Verdict", "h", "p", "own", "id", "a", "label", "bad", "same", "by")}).cache()


@pytest.mark.parametrize("literals, broadcast", [(500, 10), (0, 10), (0, 0)])
def test_urls(spark, pages, literals, broadcast):
    got = url_filter.judge(pages, RULES, most_literals=literals, most_broadcast=broadcast).collect()
    assert len(got) == len(PAGES)
    for r in got:
        assert (r["rule"], r["verdict"], r["by"]) == WANT.get(r["page_id"], (None, "allow", "none")), r
    by = {r["page_id"]: (r["host"], r["path"]) for r in got}
    assert by[1] == ("a.b.net", "/en/1") and by[13] == by[14] == by[15] == ("", "") and by[19] == ("user@allowed.org:8080", "/fr/") and by[23] == ("two.org", "/") and by[16] == ("spam.net", "")


def test_urls_with_known_redirects(spark, pages):
    links = spark.createDataFrame([("https://hub.example.org/x?gclid=1", "http://bad.net/z"), (None, "http://x.org/"), ("http://copy1.org/x", None)], "source string, target string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, RULES, links).collect()}
    assert {got[100 + i] for i in range(30)} == {"block"} and got[4] == "block" and got[9] == "allow"
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert rows(url_filter.judge(pages, RULES, html_col=None).where("by = 'alias'"), "page_id") == [(16,), (19,)]
    assert url_filter.judge(pages, [*RULES, ("block", "org", "/fr/")]).where("page_id = 8").first()["verdict"] == "allow"


# --- 12: ranked search

DOCS = [
    (1, "Alpha beta gamma"), (2, "alpha ALPHA beta; delta-alpha"), (3, None), (4, ""), (5, "..."), (6, LONG), (7, "alpha beta gamma"), (7, "alpha beta gamma"), (None, "alpha beta gamma"),
    (8, "ÉA éa alpha"), (9, "beta " * 50), *((100 + i, f"filler{i % 7} beta word{i}") for i in range(60)), *((300 + i, "copy of beta and gamma") for i in range(40)),
]
ITEMS = [(1, "alpha beta"), (1, "alpha beta"), (2, "beta beta GAMMA copy"), (3, None), (4, "--"), (5, "absent words"), (None, "w5é w5é éa"), (6, " ".join(f"w{i}é" for i in range(900)) + " alpha")]


def searched(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    N, L, df = len(counts), sum(n for _, _, n in counts), Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        said = Counter(terms(text))
        found = []
        for d, c, n in counts:
            m = 25 + 75 * n * N // L
            score = sum(q * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in said.items() if c[t])
            found.append((-score, d is None, d, score))
        out += [(item, r + 1, d, s) for r, (_, _, d, s) in enumerate(sorted((f for f in found if f[3] > 0), key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment, block_chars", [(4096, 4_000_000), (16, 100)])
def test_search(spark, segment, block_chars):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(4).withColumns({c: F.lit("x") for c in ("n", "id", "rank", "score", "terms", "digest", "query")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("x") for c in ("digest", "query", "Score")})
    got = ranked_search.search(docs, items, segment=segment, block_chars=block_chars)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == searched(DOCS, ITEMS)
    assert rows(ranked_search.search(docs, items, k=3, segment=segment)) == searched(DOCS, ITEMS, 3)
    assert ranked_search.search(docs.limit(0), items).count() == ranked_search.search(docs, items.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 11), max_size=25), min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 9)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(1, 4), st.integers(0, 40))
def test_threshold_algorithm(texts, query, k, floor):
    """Whatever is read before the stop, the best are those of a full reading, ties included."""
    cells = [(d, t, n) for d, x in enumerate(texts) for t, n in Counter(x).items()]
    doc, term, impact = (np.array([c[i] for c in cells], np.int64) for i in range(3))
    index = ranked_search.Segment(doc, term, impact, len(texts), np.arange(12))
    terms, weights = (np.array(x, np.int64) for x in zip(*query, strict=True))
    for _ in range(2):
        at, scores, read = index.best(terms, weights, floor, k, first=1)
        whole = index.forward[:, terms].astype(np.int64) @ weights
        best = sorted((-s, d) for d, s in enumerate(whole.tolist()) if s >= max(floor, 1))[:k]
        assert sorted((-s, d) for d, s in zip(at.tolist(), scores.tolist(), strict=True))[:k] == best
        assert read <= len(cells)


def test_search_stops_early():
    """Where one document leads by far, few entries of long lists are read."""
    n = 4000
    doc, term = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    impact = np.where(doc < 10, 900_000, 1000 + doc % 7)
    index = ranked_search.Segment(doc, term, impact, n, np.arange(2))
    at, _, read = index.best(np.array([0, 1]), np.array([5, 7]), 1, 10)
    assert sorted(at.tolist()) == list(range(10)) and read < 200


# --- 13: source audit

WORDS = [f"t{'abcdefghij'[i % 10]}{'klmno'[i // 10]}" for i in range(50)]
AUDITED = [(["en", "de", None][i % 3], f"s{(i * i) % 7}" if i % 11 else None, " ".join(WORDS[(i * k + k * k) % 50] for k in range(1, 30)) + (f" Ünï{i % 2} 12x" if i % 5 else "")) for i in range(240)]
AUDITED += [("en", "silent", None), ("en", "Silent", ""), ("fr", "few", "one word"), ("fr", "none", "12 34"), ("it", "alone", "x"), ("en", "s1", LONG), ("en", "s1", LONG)]


def audited(docs, least=10, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    counts, df, one = defaultdict(Counter), defaultdict(Counter), 10**9
    for lang, source, text in docs:
        counts[lang or "", source or ""].update(words := terms(text))
        df[lang or ""].update(set(words))
    out = []
    for lang in df:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        share = lambda c: {t: 1 + one * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), "pair") for o in groups if o != s]
            marks = [(-f(p[s][t], q[t]), t.encode(), "term") for t in kept if groups[s][t] and p[s][t] > q[t]]
            for some in (sorted(pairs), sorted(marks)[:top]):
                out += [(lang, s, part, item.decode(), -v, r + 1) for r, (v, item, part) in enumerate(some)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks, chunk", [(8, 400_000), (1, 7), (3, 40), (4, 5)])
def test_audit(spark, blocks, chunk):
    docs = spark.createDataFrame(AUDITED, "lang string, source string, text string").repartition(5).withColumns({c: F.lit("x") for c in ("term", "DF", "tf", "slot", "block", "item", "rank", "part", "n", "v")})
    assert rows(source_audit.audit(docs, blocks=blocks, chunk=chunk)) == audited(AUDITED)
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_each_two_blocks_meet_once(spark):
    for n in (2, 4, 6, 8, 10):
        seats = spark.range(n).select(F.col("id").cast("int").alias("b"), F.lit(n).alias("n"))
        met = Counter()
        for turn in range(n - 1):
            for r in seats.select("b", source_audit.opponent(F.col("b"), F.col("n"), turn).alias("o")).collect():
                met[tuple(sorted((r["b"], r["o"])))] += 1
        assert met == {(a, b): 2 for a in range(n) for b in range(a + 1, n)}


@given(st.lists(st.integers(0, 10**13), min_size=1, max_size=5), st.integers(0, 10**12))
def test_shares_are_exact(counts, more):
    whole = sum(counts) + 2 * len(counts) + more
    assert source_audit.shares(np.array(counts), whole).tolist() == [1 + 10**9 * (c + 2) // whole for c in counts]
