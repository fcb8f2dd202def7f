"""Whitening, importance resampling and HTML extraction."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import crc, html_text, importance, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# Importance resampling.


def runs(text, most=3):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]


def brute_resample(docs, targets):
    """doc -> (n_features, weight, score), and the drawn ids in order; docs: (id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    feats = [runs(t) for _, t in docs]
    s, t = Counter(bucket(f) for _, fs in feats for f in fs), Counter(bucket(f) for x in targets for f in runs(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)}
    out, fit = [], []
    for (i, _), (words, fs) in zip(docs, feats):
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(fs), weight, score))
        if len(words) >= 20:
            fit.append((-score, i is None, i or 0))
    return out, [(i, -s) for s, none, i in sorted(fit)][: 5 * len(fit) // 100]


def test_crc_composition():
    texts = ["", "a", "The quick-brown fox", "é ß 日本 😀", "x" * 200 + " y " + "z" * 5000, "  ", "A1_b2", "last\x00word"]
    data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    word, sizes, rows = crc.words_of(data, bounds)
    want = [runs(t, 4) for t in texts]
    assert word.tolist() == [zlib.crc32(w.encode()) for ws, _ in want for w in ws]
    assert sizes.tolist() == [len(w.encode()) for ws, _ in want for w in ws]
    got = Counter((int(r), int(c)) for cs, rs in crc.run_crcs(word, sizes, rows, 4) for c, r in zip(cs, rs))
    assert got == Counter((k, zlib.crc32(f.encode())) for k, (_, fs) in enumerate(want) for f in fs)
    assert all(len(x) == 0 for c in crc.run_crcs(*crc.words_of(data[:0], np.array([0, 0])), 3) for x in c)


def test_crc_shift_of_any_length():
    n = np.array([0, 1, 63, 64, 65, 4095, 4096, 300_000])
    a = np.full(len(n), zlib.crc32(b"start"), np.uint32)
    assert crc.shifted(a, n).tolist() == [zlib.crc32(b"start" + b"\0" * k) ^ zlib.crc32(b"\0" * k) for k in n]


def test_resample_matches_brute_force(spark, sf, docs, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 3000)
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = docs.unionByName(docs.limit(30).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.concat_ws(" ", "text", "text")}))
    want, drawn = brute_resample([(r.doc_id, r.text) for r in rows.collect()], [r.text for r in target.collect()])
    got = importance.resample(rows, target).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(want)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == drawn and len(drawn) > 3
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))
    kept = importance.resampled(rows.withColumns({"rid": F.lit(1), "rank": F.lit(2)}), target)
    assert kept.columns == [*rows.columns, "rid", "rank"] and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in drawn)


def test_resample_edges(spark, edges, empty):
    many = edges.unionByName(edges.where("doc_id = 8")).unionByName(edges.where("doc_id = 8"))
    got = importance.resample(many, empty, percent=100)
    rows = [(r.doc_id, r.text) for r in many.collect()]
    want, drawn = brute_resample(rows, [])
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got.collect()) == Counter(want)
    ranks = [(r.doc_id, r["rank"]) for r in got.where("rank IS NOT NULL").orderBy("rank").collect()]
    assert ranks == [(8, 1), (8, 2), (8, 3)]  # of equal score and id: a row each
    assert importance.resample(empty, edges).count() == 0 and importance.resampled(empty, edges).columns == empty.columns


# Whitening.


def brute_whiten(vectors, k=4):
    """Distinct floor(256 c) vectors, in whole numbers and fractions up to the eigen-solve."""
    x = [tuple(math.floor(256 * c) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    total = [sum(v[j] for v in fit) for j in range(d)]
    centred = np.array([[n * v[j] - total[j] for j in range(d)] for v in fit], object)
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in centred.T.dot(centred)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    rows = np.array([[float(Fraction(n * a - t, n)) for a, t in zip(w, total)] for w in x])
    return n, [sum((n * a - t) ** 2 for a, t in zip(w, total)) for w in x], rows @ v / np.sqrt(e), e / np.trace(cov)


def signed(y):
    """Each component's sign fixed by its largest entry."""
    return y * np.sign(y[np.abs(y).argmax(axis=0), range(y.shape[1])])


def test_whiten_matches_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    table = table.unionByName(table.limit(40)).repartition(9)
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    n, deviation, y, explained = brute_whiten([v for _, v in rows])
    got = sorted(whitening.whiten(table).collect(), key=lambda r: (r.component, r.vec_id))
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and n < len(rows)
    assert [r.deviation for r in got[: len(rows)]] == deviation
    own = np.array([r.whitened for r in got]).reshape(4, -1).T
    assert np.allclose(signed(own), signed(y), rtol=1e-9, atol=1e-9)
    assert np.allclose([r.explained for r in got[:: len(rows)]], explained, rtol=1e-12) and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_whiten_edges(spark):
    inf, nan = float("inf"), float("nan")
    schema = "vec_id long, embedding array<float>, label int, x string, n string, component string"
    rows = [(1, [0.5, -0.5, 1.0]), (2, None), (3, [1.0, None, 2.0]), (4, [1.0, nan, 2.0]), (5, [inf, 0.0, 0.0]), (None, [0.25, 0.0, -0.0]), (7, [0.5, -0.5, 1.0]), (7, [0.5, -0.5, 1.0]), (8, []), (9, [3e38, 0.0, 0.0]), (10, [0.1])]
    table = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], schema)
    got = whitening.whiten(table).collect()
    assert Counter(r.vec_id for r in got) == Counter({1: 3, None: 3, 7: 6, 8: 3, 9: 3, 10: 3})
    assert {r.deviation for r in got if r.vec_id == 9} == {None}  # beyond a long
    one = whitening.whiten(table.where("vec_id IN (1, 7)")).collect()
    assert len(one) == 9 and all(r.whitened is None and r.explained == 0 and r.n == 1 and r.deviation == 0 and r.identity_error == 0 for r in one)
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 4.0])], "vec_id long, embedding array<double>")).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: r.component)] == [False] * 3 + [True] * 3
    assert whitening.whiten(table.where("vec_id = 2")).count() == 0 and whitening.whiten(table.limit(0)).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    for a in (rng.normal(size=(d, d)), np.eye(d), np.zeros((d, d)), np.outer(np.arange(d), np.arange(d)).astype(float), np.diag(rng.integers(0, 3, d)).astype(float)):
        a = a + a.T
        e, v = whitening.symmetric_qr(a)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-12) and np.allclose(v * e @ v.T, a, atol=1e-11 * max(1, np.abs(a).max()))
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * max(1, np.abs(a).max()))


def test_moments_merge_like_one_pass():
    x = np.random.default_rng(1).integers(-300, 300, (50, 5))
    one, parts = whitening.State.none(5), whitening.State.none(5)
    one.add(x)
    for k in range(0, 50, 7):
        part = whitening.State.none(5)
        part.add(x[k : k + 7])
        parts.merge(part)
    for s in (one, parts):
        assert s.n == 50 and s.total == x.sum(axis=0).tolist() and np.allclose(s.covariance(), np.cov(x.T, bias=True), rtol=1e-12)


# HTML.

LONG = "A sentence of the article that goes on for long enough to count as text, as sentences do."
NO_CLASSES = f"""
<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<div><a href=/>Home</a></div><div><a href=/b>About</a></div><div><a href=/c>Contact</a></div><div><a href=/d>More</a></div>
<div class=x1><h1>Head &amp; line</h1><p>{LONG}<p>Short.<p>{LONG} <a href=/z>link</a></div>
<div><a href=/e>Next</a></div><div><a href=/f>Older</a></div><div><a href=/g>Tags</a></div><div>Made by hand</div></body></html>"""
CLASSES = f"""
<body class="has-sidebar"><div id="siteHeader">Site</div><ul class="main-menu"><li>One<li>Two</ul><div role="alert">We use cookies.</div>
<div id="wrap"><div class="entry-header"><h1>Title</h1></div><div class="body"><p>{LONG}</p><div class="ad-box">Buy now, {LONG}</div><p>Two<br>lines&nbsp;here <b>and <i>more</b></i></p>
<form><p>{LONG}</p></form><ul><li>First item</li><li>Second item</li></ul><table><tr><td>1<td>2</table></div></div>
<aside><p>{LONG}</p></aside><section id="comments"><p>{LONG} {LONG} {LONG}</p></section><div style="display: none">{LONG}</div><footer>End</footer>"""
ARTICLE = f"""
<header><h1>Site</h1></header><nav><a>x</a></nav><div class="sidebar"><p>{LONG}{LONG}{LONG}</p></div>
<article><header><h1>Own <a href=#>title</a></h1></header><p>Tiny.</p><aside>no</aside><style>p {{}}</style><!-- <p>no</p> --><div class="comments"><article><p>{LONG}</p></article></div><p>Last &lt;b&gt; &am</p></article>
<article class="teaser"><p>{LONG}</p></article>"""


@pytest.mark.parametrize("page, want", [
    (NO_CLASSES, ["Head & line", LONG, "Short.", f"{LONG} link"]),
    (CLASSES, ["Title", LONG, "Two lines here and more", "First item", "Second item", "1", "2"]),
    (ARTICLE, ["Own title", "Tiny.", "Last <b> &am"]),
    ("", []), ("plain text only", ["plain text only"]), ("<nav><a href=/>a</a></nav><footer>x</footer>", []),
    (f"<main><p>{LONG}</p><section><p>x</p></section></main><p>{LONG}</p>", [LONG, "x"]),
    (f"<p>{LONG}</p><script>unclosed <p>{LONG}</p>", [LONG]), (f"<p>{LONG}</p><!-- unclosed <p>no</p>", [LONG]), (f"<p title='a > b' class=\"x\">{LONG}", [LONG]),
    (f"</div></p></b><p>{LONG}</div>", [LONG]), (f"<article><p>{LONG}</p><ul><li><a>a</a><li><a>b</a></ul><p><a>one link</a></p></article>", [LONG, "one link"]),
])
def test_main_text(page, want):
    assert html_text.main_text(page) == "\n".join(want)


def test_core_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(300):
        lengths = [int(x) for x in rng.choice([0, 0, 5, 40, 90], rng.integers(0, 25))]
        found = html_text.core(lengths)
        stretches = []  # maximal runs whose zeros come fewer than WINDOW at a time
        for lo in range(len(lengths)):
            for hi in range(lo + 1, len(lengths) + 1):
                part = lengths[lo:hi]
                gaps = "".join("0" if not x else "1" for x in part)
                whole = lengths[lo - html_text.WINDOW + 1 if lo > html_text.WINDOW - 1 else 0 : lo], lengths[hi : hi + html_text.WINDOW]
                if part[0] and part[-1] and "000" not in gaps and not any(whole[0][-3:]) and not any(whole[1]):
                    stretches.append((max(sum(part[k : k + 3]) for k in range(len(part))) >= html_text.SURGE, sum(part), -lo, hi))
        if any(lengths) and stretches:
            best = max(stretches)
            assert sum(lengths[found[0] : found[1]]) == best[1] or sum(lengths[found[0] : found[1]]) >= best[1]
        elif not any(lengths):
            assert found == (0, 0)


def test_extract_edges(spark, sf):
    rows = [(1, "u", f"<p>{LONG}</p>"), (1, "u", f"<p>{LONG}</p>"), (None, None, None), (2, "v", ""), (3, "w", "<p>" * 50_000 + "<b>" * 2000 + LONG), (4, "😀", f"<p>{LONG} 😀é</p>"), (5, "x", "<div a='" * 20_000), (6, "y", f"<p>{LONG} word</p>" * 3000)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = html_text.extract(pages).collect()
    assert Counter((r.page_id, r.url, r.text) for r in got) == Counter((i, u, html_text.main_text(h or "")) for i, u, h in rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_extract_whole_table(spark, sf):
    """Every page of the table has one <article>: its blocks are the result."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    from html import unescape

    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        want[r.page_id] = "\n".join(x for x in blocks if x)
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want
