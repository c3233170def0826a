import numpy as np
import pytest

from parcelcast.llm import boosting, html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy now and save more today.</div><article><h1>A title of this page</h1><p><b>First&nbsp;paragraph of   the
article, with <a href="#">a link</a> &amp; more text that goes on, as texts do.<br><p>Second paragraph is here &#8212; it has some words, too.</p>
<p>Third one: not as long.</p></article><footer>&copy; example.net &middot; all rights</footer>"""
MAIN = "A title of this page\nFirst paragraph of the article, with a link & more text that goes on, as texts do.\nSecond paragraph is here \u2014 it has some words, too.\nThird one: not as long."


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return ht.train(pages)


def texts(spark, model, htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html", "'x' as text")
    return {r.page_id: r.text for r in ht.extract(df, model).collect()}


def test_article_without_the_rest(spark, model):
    comments = '<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this article, it was well written and good.</p></div></section>'
    aside = '<aside class="sidebar"><h4>Related</h4><ul><li><a href="#">One story</a></li><li><a href="#">Other story</a></li></ul></aside>'
    form = '<form class="newsletter"><label>Your mail</label><input><button>Send</button></form>'
    changed = PAGE.replace("</article>", f"</article>{aside}{comments}{form}")
    plain = changed.replace("<article>", '<div class="post-content">').replace("</article>", "</div>")
    got = texts(spark, model, [PAGE, None, "", changed, plain, "just <<text", "<p>" * 500, "<nav><a>x</a></nav>"])
    assert got[0] == got[3] == MAIN and got[1] == got[2] == ""
    assert got[4].split("\n")[1:] == MAIN.split("\n")[1:]


def test_pages_of_the_table(spark, pages, model):
    import html
    import re

    rows = {r.page_id: r.html for r in pages.collect()}
    got = ht.extract(pages, model).collect()
    wrong = 0
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        wrong += r.text != "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    assert len(got) == len(rows) and wrong <= 0.02 * len(rows)


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        nodes = [ht.Node("root", -1, 0)] + [ht.Node("div", int(rng.integers(0, i)), 1, own=int(rng.integers(0, 50))) for i in range(1, n)]
        odds = rng.normal(size=n)
        kept = ht.decode(nodes, odds)
        weight = np.array([1 + np.log1p(x.own) for x in nodes])
        value = lambda k: float(np.where(k, -weight * np.logaddexp(0, -odds), -weight * np.logaddexp(0, odds))[1:].sum())
        best = -np.inf
        for bits in range(1 << (n - 1)):
            k = np.array([True] + [bool(bits >> i & 1) for i in range(n - 1)])
            if all(k[nodes[i].parent] for i in range(1, n) if k[i]):
                best = max(best, value(k))
        assert all(kept[nodes[i].parent] for i in range(1, n) if kept[i])
        assert value(kept) == pytest.approx(best)


def test_boosting_learns_and_stands_odd_data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert (((model.log_odds(x[2000:]) > 0) == y[2000:]).mean()) > 0.95
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).log_odds(np.zeros((2, 3))).tolist() == [0.0, 0.0]


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert ht.extract(empty, ht.train(empty)).count() == 0


@pytest.mark.parametrize("odd, inner", [
    ("<svg><path d='x'>", ""), ("<object data='a'>", ""), ("<video src='a'>", ""), ("<canvas>", ""), ("<template>", ""),
    ("<svg><g><svg><text>no</text></svg><text>no</text></g></svg>", ""), ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2")])
def test_silent_elements_end_with_their_parent(odd, inner):
    _, runs = ht.read(f"<html><body><article><div>{odd}</div><p>First text.</p><p>Second text.</p></article></body></html>")
    assert "\n".join(t for _, t in runs) == "\n".join([*[inner] * bool(inner), "First text.", "Second text."])


def test_raw_text_without_end_reaches_to_the_end():
    for name in ("script", "style", "textarea", "iframe", "title"):
        assert [t for _, t in ht.read(f"<p>Text.</p><{name}>a < b <p>no")[1]] == ["Text."]


def test_a_block_ends_an_open_drawing():
    page = "<article><svg><path d='x'><p>First text.</p><p>Second text.</p></article>"
    assert [t for _, t in ht.read(page)[1]] == ["First text.", "Second text."]


def test_whole_text_of_a_page_without_article(spark, model):
    plain = PAGE.replace("<article>", '<div class="post-content">').replace("</article>", "</div>")
    assert texts(spark, model, [plain])[0] == MAIN
