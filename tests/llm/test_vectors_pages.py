"""Whitening, hard negatives and page extraction against plain versions and planted cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectab.llm import hard_negatives, html_extract, html_training, whitening
from vectab.llm.common import WordHasher
from vectab.llm.html_blocks import blocks

SCHEMA = "vec_id bigint, embedding array<double>, label int, n string, kept string, a int, V int, component int"


def table(spark, rows):
    return spark.createDataFrame([(k, v, g, "x", "x", 1, 1, 1) for k, v, g in rows], SCHEMA)


# --- whitening ---

def plain_scatter(x):
    gap = x - x.mean(axis=0)
    return gap.T @ gap


@pytest.mark.parametrize("x", [
    np.floor(np.random.default_rng(1).normal(size=(400, 24)) * 9),
    np.random.default_rng(2).normal(size=(300, 12)) * np.logspace(0, -7, 12),
    np.repeat(np.random.default_rng(3).normal(size=(3, 10)), 50, axis=0),
    np.zeros((20, 5)), np.ones((7, 1)), np.arange(9.0)[:, None], np.eye(8),
    np.random.default_rng(4).integers(0, 2, (200, 9)).astype(float),
], ids=["rounded", "scales", "copies", "zeros", "one", "line", "corners", "bits"])
def test_rank_one_updates(x):
    whole, left, right = (whitening.Spectrum(x.shape[1]) for _ in range(3))
    for i, row in enumerate(x):
        whole.add(row)
        (left if i % 3 else right).add(row)
    left.merge(right)
    wanted = plain_scatter(x)
    size = max(np.abs(wanted).max(), 1e-9)
    for s in (whole, left):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0))
        assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-11
        assert np.abs(s.vectors * s.values @ s.vectors.T - wanted).max() < 1e-11 * size
        assert (np.diff(s.values) >= 0).all()


def test_whitening_matches_a_plain_decomposition(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.3, 0.2]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [math.nan] * 6, 1), (1003, [math.inf] + [0.0] * 5, 1),
             (1004, [None] + [0.0] * 5, 1), (1005, [1e300] + [0.0] * 5, 1), (None, [0.5] * 6, 1), (7, v[7].tolist(), 1)]
    got = whitening.whiten(table(spark, rows).repartition(20), components=4).toPandas()
    x = np.floor(64 * np.vstack([v, np.full((1, 6), 0.5), v[7]])) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    e, axes = np.linalg.eigh(plain_scatter(x) / n)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == 4 * n and set(got["n"]) == {n} and got["vec_id"].isna().sum() == 4
    one = got[got["vec_id"] == 7]
    assert sorted(one["component"]) == [1, 1, 2, 2, 3, 3, 4, 4]
    for c in range(4):
        part = got[(got["component"] == c + 1) & (got["vec_id"] < 300)].drop_duplicates("vec_id").sort_values("vec_id")
        wanted = (x[:300] - total / n) @ axes[:, c] / np.sqrt(e[c])
        assert min(np.abs(part["whitened"] - wanted).max(), np.abs(part["whitened"] + wanted).max()) < 1e-9
        assert abs(part["explained"].iloc[0] / (e[c] / e.sum()) - 1) < 1e-10
    assert got["identity_error"].max() < 1e-10 and got["identity_error"].nunique() == 1
    exact = {i: sum((n * int(a) - int(t)) ** 2 for a, t in zip(x[i], total)) for i in range(300)}
    assert all(exact[k] == d for k, d in zip(got["vec_id"], got["deviation"]) if k == k and k < 300)


def test_whitening_without_spread(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0], 1)])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [
        (1, 0, None, None, None), (2, 0, None, None, None)]
    flat = whitening.whiten(table(spark, [(i, [float(i), 5.0], 1) for i in range(10)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-12
    with pytest.raises(Exception, match="different dimensions"):
        whitening.whiten(table(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1)])).collect()


def test_deviations_beyond_a_long():
    y = np.array([[1.0, 2.0], [2.0**45, 0.0], [2.0**31, 0.0]])
    total = [5, 7]
    wanted = [sum((3 * int(a) - t) ** 2 for a, t in zip(row, total)) for row in y]
    assert whitening.deviations(y, 3, total) == [w if w < 2**63 else None for w in wanted]
    total = [3 * 2**40] * 2  # sums near the edge of a long
    wanted = [sum((2**30 * int(a) - t) ** 2 for a, t in zip(row, total)) for row in y]
    assert whitening.deviations(y, 2**30, total) == [w if w < 2**63 else None for w in wanted]


# --- hard negatives ---

def plain_negatives(rows, every, positives, negatives):
    fit = [(k, [math.floor(256 * c) for c in v], g) for k, v, g in rows
           if k is not None and g is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, va, ga in fit:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(va, v)), k, g) for k, v, g in fit]
        best = sorted((s, k) for s, k, g in scored if g == ga and k != a)[:positives]
        for ps, p in best:
            window = sorted((s, k) for s, k, g in scored if g != ga and 80 * -ps <= 100 * -s <= 100 * -ps)
            out += [(a, p, i + 1, k, -ps, -s) for i, (s, k) in enumerate(window[:negatives])]
    return sorted(out)


def random_rows(n, seed, spread):
    rng = random.Random(seed)
    rows = [(i, [rng.choice(spread) for _ in range(4)], rng.randrange(3)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.1] * 4, None), (None, [0.2] * 4, 1), (n + 2, [math.nan] * 4, 1), (n + 3, [None] * 4, 1), (n + 4, [], 1)]
    return rows + [rows[3], rows[3], rows[10], (10, rows[10][1], 7)]


@pytest.mark.parametrize("spread", [[0.0, 0.01, 0.02, -0.01], [0.5, -0.3, 0.111], [1e6, -2e6, 3e6]], ids=["ties", "mixed", "large"])
def test_hard_negatives_brute(spark, monkeypatch, spread):
    rows = random_rows(120, 6, spread)
    wanted = plain_negatives(rows, 10, 5, 5)
    assert wanted
    data = table(spark, rows).repartition(5)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def got():
        found = hard_negatives.hard_negatives(data, F.col("vec_id") % 10 == 0)
        return sorted(tuple(r[c] for c in names) for r in found.collect())

    assert got() == wanted
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 17)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 5 * 4 * 8)
    monkeypatch.setattr(hard_negatives, "TILE", 40)
    assert got() == wanted


def test_hard_negatives_beyond_a_long():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 0.0], [2.0**20, 3.0]])
    assert hard_negatives.products(a, b).tolist() == [[2**63 - 1, 2**60 + 3]]


def test_hard_negatives_without_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, None, None)], [(1, [1.0], 1), (2, [1.0], 2)]):
        assert hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0).collect() == []


# --- pages ---

def test_blocks():
    def read(html):
        return [(b.text, [e[0] for e in b.path]) for b in blocks(html)]

    assert read("<p>a<b>c</b> d<br>e<li>x<a href='>'>y</a><li>z") == [("ac d e", ["p"]), ("xy", ["li"]), ("z", ["li"])]
    assert read("a < b &amp; c &lt;p&gt;&nbsp;<!-- x") == [("a < b & c <p>", [])]
    assert read("<script>if(a<b)'</p>'</script>ok<style>p</style> k<script>never") == [("ok k", [])]
    assert read("<table><tr><td>1<td>2<tr><td>3</table>t") == [(n, ["table", "tr", "td"]) for n in "123"] + [("t", [])]
    assert read("<select><option>a</select>b<svg><text>c</text></svg>") == [("b", [])]
    assert read("x<p class='cut") == [("x", [])] and read(None) == read("") == read("<div> </div>") == []
    assert read("é&#8364;&bogus;&am") == [("é€&bogus;&am", [])]
    assert blocks("<div class='side-Bar X1' hidden id=Ad>q</div>")[0].path == (("div", ".side", ".bar", ".x", ".ad", ".hidden"),)
    assert blocks("<p>ab<a>cd</a></p>")[0].linked == 0.5


@pytest.mark.parametrize("html", [
    "<b>" * 50_000 + "<p>x", "<p>" * 50_000, '<a b="' * 50_000, "</x>" * 50_000, "<" * 100_000, "<div>" * 50_000 + "x" + "</p>" * 50_000,
    "x" * 5_000_000, "y " * 1_000_000, "<!--" * 50_000, "<script>" * 50_000, "&" * 100_000, "<a =" * 50_000,
], ids=range(12))
def test_strange_pages_take_linear_time(html):
    assert len(blocks(html)) <= 1


@pytest.fixture(scope="module")
def net():
    return html_extract.fit(0, 1500, 6)


def test_gradients():
    net, hasher = html_extract.Labeller(3), WordHasher(lower=True)
    rng = np.random.default_rng(0)
    net.weights = [rng.normal(size=w.shape) * 0.3 for w in net.weights]
    pages = [p for p in html_extract.labelled(6, 1)]
    f, wanted = html_extract.Features([b for b, _ in pages], hasher), np.concatenate([w for _, w in pages]).astype(float)
    f.measures = f.measures.astype(float)

    def loss():
        p = net.chances(f).astype(float)
        return -np.mean(wanted * np.log(p) + (1 - wanted) * np.log(1 - p))

    found = net.gradients(f, wanted)
    for w, d in zip(net.weights, found):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        kept, step = w[at], 0.02
        w[at] = kept + step
        up = loss()
        w[at] = kept - step
        down = loss()
        w[at] = kept
        assert abs((up - down) / (2 * step) - d[at]) < 0.05 * abs(d[at]) + 1e-4


def test_labeller_on_unseen_pages(net):
    pages = html_extract.labelled(300, 4321)
    chances = net.chances(html_extract.Features([b for b, _ in pages], WordHasher(lower=True)))
    wanted = np.concatenate([w for _, w in pages]) > 0.5
    assert ((chances > 0.5) == wanted).mean() > 0.97


def test_chances_do_not_depend_on_the_batch(net):
    pages = [blocks(h) for h in html_training.training_pages(40, 5)]
    hasher = WordHasher(lower=True)
    together = net.chances(html_extract.Features(pages, hasher))
    alone = np.concatenate([net.chances(html_extract.Features([p], hasher)) for p in pages])
    assert np.abs(together - alone).max() < 1e-4


PAGE = """<html><head><title>T</title></head><body><div class="cookie-banner"><p>We use cookies on this site to do things.</p></div>
<nav><ul><li><a href=/>Home</a><li><a href=/x>Contact</a></ul></nav><div class="sidebar"><h3>Most read</h3><p>Another story of the day.</p></div>
<article><h1>A long day</h1><p>It was a day  of &lt;much&gt; rain,&nbsp;and
the river rose.</p><div class="ad">Buy these new shoes today, they are good.</div><p>Later the sun came out again over the town.</p></article>
<form><label>Name</label><input><button>Send</button></form><section id="comments"><h2>Comments (2)</h2><div class="comment"><b>Ann</b><p>I liked
the rain more than the sun in that town.</p></div></section><footer>&copy; example.com All rights reserved</footer></body></html>"""


def test_extraction(spark, net):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<nav><a>Home</a></nav>"), (1, "u", PAGE), (4, "x", "<p>" + "word " * 1_000_000)]
    data = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_extract.extract_text(data, net).collect()
    text = "A long day\nIt was a day of <much> rain, and the river rose.\nLater the sun came out again over the town."
    assert sorted(((r.page_id, r.url, r.text) for r in got if r.page_id != 4), key=str) == sorted(
        [(1, "u", text), (1, "u", text), (2, None, ""), (None, "v", ""), (3, "w", "")], key=str)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_text(data.limit(0), net).collect() == []
