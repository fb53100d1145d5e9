"""Marginals against summing over all labellings, texts against labelled and registered pages."""

import html as entities
import itertools
import random
import re
import time

import numpy as np
import pytest

from winnow.llm import html as H
from winnow.llm.html_pages import PAGES


@pytest.fixture(scope="module")
def model():
    return H.estimated(H.counted(H.forest([H.tree(p) for p in PAGES])))


@pytest.mark.parametrize("seed", range(8))
def test_marginals_are_exact(model, seed):
    rng = random.Random(seed)
    tags = ["div", "p", "article", "ul", "nav class='ad'"]
    page = "".join(f"<{rng.choice(tags)}>{'word. ' * rng.randint(0, 9)}" + ("</p></div>" if rng.random() < 0.4 else "") for _ in range(6))
    f = H.forest([H.tree(page)])
    n = len(f.parent)
    total, inside = 0.0, np.zeros(n)
    for y in itertools.product(range(3), repeat=n):
        logp = model.root[y[0]]
        for i in range(1, n):
            logp += model.step[f.kind[i], y[f.parent[i]], y[i]]
            logp += sum(t[f.seen[i, k], y[i]] for k, t in enumerate(model.traits))
        total += np.exp(logp)
        inside += np.exp(logp) * (np.array(y) == H.INSIDE)
    assert H.marginals(f, model) == pytest.approx(inside / total)


def test_labelled_pages(model):
    wrong = blocks = 0
    for page in PAGES:
        t = H.tree(page)
        p = H.marginals(H.forest([t]), model)
        wrong += sum((p[own] >= 0.5) != (t.label[own] == 1) for own, _ in t.blocks)
        blocks += len(t.blocks)
    assert wrong <= 0.01 * blocks


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p>a &amp;amp; b&nbsp;c<br>d<p> x\n\ty </p>", ["a &amp; b c d", "x y"]),
        ("<p>1<b>2<p>3</b>4</p>5", ["1 2".replace(" ", ""), "34", "5"]),
        ("a<!-- <p>b --><script>if (a < b) '</p>'</script><style>p{}</style>c<title>t</title>", ["ac"]),
        ("<ul><li>1<li>2<ul><li>3</ul>4</ul>5", ["1", "2", "3", "4", "5"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", ["1", "2", "3", "4"]),
        ("<svg><text>no</text></svg><select><option>no</select>yes", ["yes"]),
        ("<div a='>' b=\">\">x</div><P CLASS=ad>y", ["x", "y"]),
        ("1 < 2 & 3 <", ["1 < 2 & 3 <"]),
        ("<script>never closed", []),
        ("</div></p>x</article>", ["x"]),
        ("<a href=x>l</a><!doctype x><br/>y", ["l y"]),
    ],
)
def test_blocks(page, blocks):
    assert [b for _, b in H.tree(page).blocks] == blocks


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<head><title>x</title><body><p>a", ["a"]),
        ("<html><head><meta charset=utf-8><title>x</title><p>a</p><p>b", ["a", "b"]),
        ("<head><title>x</title>a</head><p>b", ["a", "b"]),
        ("<head><script>'<head>'</script><style>p{}</style></head><body>a", ["a"]),
        ("<head><template><p>no</p></template><noscript><p>no</p></noscript></head>a", ["a"]),
        ("<div><button>no</div><p>a", ["a"]),
        ("<form><select><option>no</form>a", ["a"]),
        ("<div><svg><text>no</div>a", ["a"]),
        ("<svg><path><p>a", ["a"]),
        ("<svg><foreignObject><p>no</p></foreignObject></svg>a", ["a"]),
        ("<div><object><div>no</div>no</object>a<p>b</div>", ["a", "b"]),
        ("<div><p>a<object><p>no</p>no</object>b</p></div>c", ["ab", "c"]),
        ("<button>no<button>no</button>a", ["a"]),
    ],
)
def test_hidden_elements_that_are_not_closed(page, blocks):
    assert [b for _, b in H.tree(page).blocks] == blocks


SENTENCES = "Some words of a sentence that goes on for a while, as they do. And another one, which is short. "


def test_layouts(model):
    s = SENTENCES.strip()
    pages = {
        f"<nav><a href=/>Home</a></nav><article><h1>T</h1><p>{s}</p><aside><p>{s}</p></aside><p>Yes.</p></article><footer>f</footer>": f"T {s} Yes.",
        f"<div class='gdpr'><p>{s}</p></div><main><h2>A</h2><p>{s}</p><section id=comments><h3>Comments</h3><p>{s}</p></section></main>": f"A {s}",
        f"<article><p>{s}</p></article><ol class=comment-list><li><article><p>{s}</p></article></li></ol>": s,
        f"<div id=top><a href=/>Home</a></div><div><h1>T</h1><p>{s} {s}</p><p>{s}</p></div><div>Copyright 2020</div>": f"T {s} {s} {s}",
        f"<form><p>{s}</p></form><div class='ads'>{s}</div>": "",
        "<html><body></body></html>": "",
        "": "",
    }
    found = H.main_texts(list(pages), model)
    assert [" ".join(x) for x in found] == list(pages.values())


def test_pages(spark):
    s = SENTENCES * 3000
    rows = [(1, "u", f"<article><p>{s}</p></article>", "x"), (2, None, None, "y"), (None, "u", "", None), (2, "u", "<p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, blocks string")
    found = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.report(df).collect()), key=repr)
    assert found == sorted([(1, "u", s.strip(), len(s) - 1), (2, None, "", 0), (None, "u", "", 0), (2, "u", "", 0)], key=repr)
    assert H.report(df.limit(0)).collect() == []


def test_training_counts_on_the_cluster(spark, model):
    trained = H.trained(spark)
    assert np.allclose(trained.step, model.step) and all(map(np.allclose, trained.traits, model.traits))


def test_pages_of_the_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.page_id: r.text for r in H.report(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"<(/?p|/?h1|br)>", " ", inside))
        assert texts[r.page_id] == " ".join(entities.unescape(plain).split())


@pytest.mark.parametrize(
    "page",
    [
        "<article>" + "<div>" * 100_000 + "deep. words in here." + "</div>" * 100_000 + "</article>",
        "<article><p>text. more text.</p></article>" + '<a "' * 250_000,
        "<div>" * 60_000 + "</section>" * 60_000 + "</b>" * 60_000,
        "<object>" * 50_000 + "</object>" * 50_000 + "<p>x</p>",
        "<p><b>" * 120_000 + "words",
    ],
    ids=["nested", "unclosed", "unmatched", "hidden", "inline"],
)
def test_hostile_pages_of_a_megabyte(spark, page):
    model = H.trained(spark)
    begin = time.time()
    assert len(H.main_texts([page], model)) == 1
    assert time.time() - begin < 20


def test_pages_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS page_id, 'u' AS url, cast(unhex('3C703E61FF623C2F703E') AS string) AS html")
    assert H.report(df).count() == 1
