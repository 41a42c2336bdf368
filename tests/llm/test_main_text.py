"""Main text: held-out labelled pages, marginals against enumeration, awkward pages, and the table's own articles."""

import html
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import main_text as mt

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return mt.trained()


def text(model, page):
    return mt.extract([page], model)[0]


def test_marginals_equal_enumeration():
    dom = mt.parse("<body><div class=menu>a<p>b</p></div><article>c<p>d</p><p>e</p></article></body>")
    f = mt.forest([dom])
    r = np.random.default_rng(3)
    model = mt.Model(r.normal(size=mt.FEATURES), r.normal(size=(len(mt.TAGS), 2, 2)))
    own = np.bincount(f.rows, model.own[f.cols], minlength=len(f.parent))
    n, total, sums, pairs = len(f.parent), 0.0, np.zeros(len(f.parent)), np.zeros((len(f.parent), 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(own[k] * y[k] for k in range(n)) + sum(model.pair[f.tag[k], y[f.parent[k]], y[k]] for k in range(1, n)))
        total += w
        sums += w * np.array(y)
        for k in range(1, n):
            pairs[k, y[f.parent[k]], y[k]] += w
    one, two = mt.beliefs(f, model)
    assert np.allclose(np.exp(one[:, 1]), sums / total)
    assert np.allclose(np.exp(two[1:]), pairs[1:] / total)


def test_held_out_labelled_pages(model):
    doms = [mt.parse(p) for p in mt.labelled_pages(300, seed=99)]
    one = mt.beliefs(mt.forest(doms), model)[0]
    y, chars = np.concatenate([mt.labels(d) for d in doms]), np.concatenate([d.chars for d in doms])
    right = (one[:, 1] >= one[:, 0]) == (y == 1)
    assert right[chars > 0].mean() > 0.97
    assert (right * chars).sum() > 0.97 * chars.sum()


def test_parents_decide(model):
    """The same paragraph counts by what stands around it."""
    p = "<p>Rain fell on the hills all night, and the river rose.</p>"
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Rain</h1>{}</article><div class='comments'><div class='comment'>{}</div></div><aside class=sidebar>{}</aside><footer>&copy; us</footer></body>"
    got = text(model, page.format(p, p, p))
    assert got == "Rain Rain fell on the hills all night, and the river rose."
    assert text(mt.Model(model.own, np.zeros_like(model.pair)), page.format(p, p, p)) != got


def test_kinds_of_noise(model):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class=masthead><p>Site name</p></header><div class="cookie-notice"><p>We use cookies. Accept?</p></div>
    <div class="content"><h1>Title here</h1><p>First &amp; foremost,<br>a&nbsp;line with <b>bold</b><i>ness</i>.<p>Second   one.<div class="ad-slot">Buy now.</div><ul><li>Point one.<li>Point two.</ul>
    <form class=newsletter><label>Mail</label><button>Go</button></form></div><section id="comments"><h3>2 comments</h3><p>Nice one.</p></section><script>var x="<p>no</p>"</script><!-- <p>no</p> --></body></html>"""
    assert text(model, page) == "Title here First & foremost, a line with boldness. Second one. Point one. Point two."


@pytest.mark.parametrize("page, expected", [("", ""), ("<", ""), ("<!-- open", ""), ("<article><p>Cut off in a tag <b", "Cut off in a tag"), ("<article><p>1 < 2 &am; 3</p></article>", "1 < 2 &am; 3"), ("<script>never closed <p>x</p>", ""), ("</p></div></article>", "")])
def test_broken_markup(model, page, expected):
    assert text(model, page) == expected


def test_attributes_and_implied_ends():
    d = mt.parse("<div class='a > b' title=it's><p>x<div>y</div></p><table><tr><td>1<td>2<tr><td></div>3</table>z<a href=x>l</div></a>w")
    runs = [(d.tag[n], d.text(k)) for k, (n, _) in enumerate(d.runs)]
    assert runs == [("p", "x"), ("div", "y"), ("td", "1"), ("td", "2"), ("td", "3"), ("div", "zl"), ("html", "w")]
    assert d.linked[d.runs[5][0]] == 1 and d.linked[0] == 0


def test_deep_and_long(model):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    long = "<article><h1>T</h1>" + "<p>Some words here, again and again.</p>" * 20_000 + "</article>"
    assert text(model, deep) in ("", "x")
    assert text(model, long) == "T" + " Some words here, again and again." * 20_000


def test_query_gives_the_articles(spark):
    """Pages of the table hold one article each; everything else is menu, advert or footer."""
    def article(page):
        m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>|<br>", " ", m[1]))).split()) if m else ""

    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = mt.op11_main_text(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_nulls_repeats_empty_and_extra_columns(spark, model):
    rows = [(1, None, None), (None, "u", "<article><p>Here it is, the text.</p></article>"), (None, "u", "<article><p>Here it is, the text.</p></article>"), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5)).withColumn("_html", F.lit("x"))
    got = Counter((r.page_id, r.text) for r in mt.main_text(df, model).collect())
    assert got == {(1, ""): 1, (2, ""): 1, (None, "Here it is, the text."): 2}
    assert mt.main_text(df.limit(0), model).count() == 0
