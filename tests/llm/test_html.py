"""Block cutting, held-out accuracy of the labeller, and the whole extraction on hard pages."""

import pytest
from lodestone.llm import html_extract, queries

from tests.llm import tables


@pytest.fixture(scope="module")
def labeller():
    return html_extract.labeller()


def test_held_out_accuracy(labeller):
    assert html_extract.accuracy(labeller, range(10_000, 10_200)) >= 0.97


def test_blocks():
    page = "<p>a &amp; <b>b</b>\n\n c<p>d<br>e<!-- x --><script>var p='</p>'</script><div>f</div>g"
    assert [b[1] for b in html_extract.blocks(page)] == ["a & b c", "d e", "f", "g"]
    assert html_extract.blocks("") == [] and html_extract.blocks("<") and html_extract.blocks("<!-- never ends") == []


def test_blocks_keep_what_follows_elements():
    """Self-closed, closed and unclosed elements whose content is markup: nothing is skipped, and an unclosed one ends with its parent."""
    texts = lambda page: [b[1] for b in html_extract.blocks(page)]
    for tag in ("svg", "math", "object", "select", "button", "noscript", "template"):
        assert texts(f"<article><p>one</p><{tag} class='i'/><p>two</p></article><p>three</p>") == ["one", "two", "three"]
        assert texts(f"<article><p>one</p><{tag}/><p>two</p><{tag}></{tag}><p>three</p>") == ["one", "two", "three"]
        assert texts(f"<article><p>one</p><{tag}>x</{tag}><p>two</p></article>") == ["one", "x", "two"]
        cut = html_extract.blocks(f"<article><p>one</p><div><{tag} class='i'><p>two</p></div><p>three</p></article><p>four</p>")
        assert [b[1] for b in cut] == ["one", "two", "three", "four"]
        assert "@i" in cut[1][0] and not any("@i" in b[0] for b in cut[2:])
    assert texts("<p>so <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds</p>") == ["so a=b holds"]
    assert texts("<p>one<svg><title/><path d=''/></svg><p>two<svg><title>t</svg><p>three") == ["one", "two", "t", "three"]
    assert texts("<title>t</title><p>one<textarea>x</textarea><iframe>y</iframe><style>z</style>two") == ["one", "two"]


def test_text_beside_icons(labeller):
    long = "This sentence of the article is long enough to be read, and {} it says what the page is about."
    for tag in ("<svg class='i'/>", "<button>", "<select>", "<noscript>", "<object>"):
        (text,) = html_extract.extract_texts(labeller, [f"<html><body><article><p>{long.format('first')}</p><div>{tag}</div><p>{long.format('then')}</p></article></body></html>"])
        assert long.format("first") in text and long.format("then") in text


def test_gradients():
    """Against differences, on a small batch."""
    import numpy as np

    net = html_extract.Labeller(3)
    pages, labels = html_extract.labelled(range(3))
    x, y = html_extract.Inputs(pages), np.array([v for p in labels for v in p], float)

    def loss():
        p = net.probabilities(x)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(x, y)
    for name in ("wf", "ub", "cb", "out"):
        flat = net.p[name].reshape(-1)
        flat[0] += 1e-5
        up = loss()
        flat[0] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[name].reshape(-1)[0]) < 1e-6
        flat[0] += 1e-5


def test_hard_pages(spark):
    df = tables.with_clashes(tables.pages(spark))
    out = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert len(out) == df.count()
    assert out[4]["text"] == out[5]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert html_extract.extract(tables.empty(spark, tables.PAGES)).count() == 0


def test_query_returns_every_page(spark, tiny):
    got = queries.op3_html_extraction(spark, tiny)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    assert got.count() == spark.read.parquet(f"{tiny}/pages.parquet").count()
    assert all("<script" not in r["text"] and "  " not in r["text"] for r in got.collect())


def test_long_and_broken_pages_take_linear_time():
    """A quarter of a megabyte each; a parser that looks back or ahead for every tag takes minutes."""
    import time

    n = 60_000
    for page in ("<a " * n, "<div>x" * n, "<a href='" * n, "</b>" * n + "<div>" * n + "</p>" * n, "<p>x<b>" * n, "<!-- " * n, "<div>" * n + "</x>" * n, "<" * 4 * n):
        began = time.time()
        html_extract.blocks(page)
        assert time.time() - began < 20, page[:20]
    deep = html_extract.blocks("<div>" * 5000 + "the end")
    assert [t for _, t, _ in deep] == ["the end"] and len(deep[0][0]) == html_extract.OUTER + html_extract.INNER


def test_cdata_without_an_end():
    assert [t for _, t, _ in html_extract.blocks("<svg><![CDATA[whole text")] == ["whole text"]
