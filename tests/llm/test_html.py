from __future__ import annotations

import html as entities
import re

from echofield.llm import html
from echofield.llm.queries import op9_main_content


def test_article_text_of_all_pages(spark):
    at = "/root/testdata/sf0.01"
    markup = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    for r in op9_main_content(spark, at).collect():
        inside = re.search(r"<article>(.*?)</article>", markup[r["page_id"]], re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inside)]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PAGE = """<!doctype html><html><head><title>Title of page</title><style>p{}</style><script>var a = "<p>no</p>";</script></head>
<body><header><h1>Site name</h1><form><label>Search words</label><input></form></header>
<div class="cookie-notice"><p>We use cookies on this site to serve you better, please agree to it now.</p></div>
<div id="sidebar"><ul><li>one link</li><li>two links</li></ul></div>
<div class="post"><h2>A heading &amp; more</h2><p>First <i>para</i>graph of text,
  with lines.</p><!-- <p>hidden</p> --><div class="advert">Buy this now</div><p>Second&nbsp;one &lt;here&gt;.</p><ul><li>item</li></ul></div>
<section class="comments"><p>I like this very much indeed, thanks.</p></section><footer>Copyright</footer></body></html>"""


def test_furniture_goes_without_labels():
    assert html.main_text(PAGE, {}) == "A heading & more First paragraph of text, with lines. Second one <here>. item"


def test_best_run_as_by_brute_force():
    scores = [("p", 3), ("nav", 4), ("p", 2), ("nav", 1), ("p", 5)]
    page = "".join(f"<{k}>{' '.join(['w'] * n)}</{k}>" for k, n in scores)
    weights = {"p": 1.0, "nav": -1.0}
    line = []
    for kind, value, _ in html.pieces(page):
        line.append(-html.TAG_COST if kind.startswith("<") else len(value.split()) * weights[kind])
    best = max(sum(line[i:j]) for i in range(len(line)) for j in range(i, len(line) + 1))
    kept = html.main_text(page, weights).split()
    assert abs(best - (2 - 1 + 5 - 6 * html.TAG_COST + 0)) < 1 and len(kept) == 7


def test_odd_pages():
    assert [html.main_text(p, {}) for p in (None, "", "<p>", "<!-- open", "<script>x", "a < b", "<p>a<p>b")] == ["", "", "", "", "", "a < b", "a b"]
    assert html.main_text("<p>" + "word " * 200_000, {}).count("word") == 200_000


def test_query_on_odd_and_empty_tables(spark, odd_dir, none_dir):
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in op9_main_content(spark, odd_dir).collect()}
    assert got == {1: ("u", "Big& Some bold words here and more", 34), 2: (None, "", 0), 3: ("u", "", 0), None: ("v", "only <text>", 11)}
    assert op9_main_content(spark, none_dir).count() == 0
    clash = spark.createDataFrame([(1, "x", "<p>a b", "k")], "text int, _p string, html string, kind string")
    assert html.extract(clash.drop("text"), {}).first()["text"] == "a b"


def test_wrappers_named_like_furniture():
    want = html.main_text(PAGE, {})
    body = PAGE.replace("<body>", "<body class='has-sidebar'>")
    assert html.main_text(body, {}) == want
    assert html.main_text(body.replace("<header>", "<div id='share-enabled'><header>").replace("</body>", "</div></body>"), {}) == want
    parts = "<div class='widget'><article><p>one two three</p></article><div class='comments'>" + "x " * 99 + "</div></div><p>a b c</p>"
    assert html.main_text(parts, {}) == "one two three"
    cards = "<p>one two three</p><article>four</article><div class='related'><article>five six</article></div>"
    assert html.main_text(cards, {}) == "one two three four"


def test_quotes_count_only_behind_an_equals_sign():
    page = "<p data-x=it's>Hello world one</p><p>I don't know</p><p>end words here</p>"
    assert html.main_text(page, {}) == "Hello world one I don't know end words here"
    assert html.main_text("<p title='a > b' x = \"c > d\">text here now</p>", {}) == "text here now"
    assert html.main_text('<p x="never closed>one two three</p><p>four five six</p>', {}) == "one two three four five six"
    assert html.main_text("<p>one two three</p><p>if a <b then nothing ends", {}) == "one two three if a <b then nothing ends"


def test_time_grows_with_the_page_only():
    import time

    begin = time.perf_counter()
    for part in ('<a "', "<a x='", '<a x="', "<!", "<![CDATA[", "<script", "<script>", "<i>", "<div class=ad>", "</b>", "<p><i>", "<!--", "<li><b>x",
                 "<td class=ad><p>", "<article><div class='x ad'>w "):
        page = part * (1_000_000 // len(part))
        html.main_text(page, {})
    assert time.perf_counter() - begin < 60


def test_names_that_only_contain_a_noise_word_are_no_furniture():
    page = ("<article><header><h1>The headline stays</h1></header><p>First words of it all.</p><div class='share-price'>The share price rose today "
            "a lot</div><p>more text</p><section class='ad-hoc-notes'><p>Notes made ad hoc.</p></section><aside>Related things to read</aside>"
            "<div class='ad'>Buy this now, it is cheap and good and everyone has one already at home</div><p>Last.</p></article>")
    assert html.main_text(page, {}) == (
        "The headline stays First words of it all. The share price rose today a lot more text Notes made ad hoc. Last.")


def test_named_noise():
    for value in ("ad", "cookie-notice", "siteHeader", "left-sidebar", "x share_buttons", "AD", "comments2"):
        assert html._named_noise(value), value
    for value in ("share-price", "ad-hoc-notes", "header-photo-essay", "download", "main", "post", "shared", ""):
        assert not html._named_noise(value), value
    assert html._furniture("div", "title='class=ad' data-class=ad", False) is None
    assert html._furniture("div", 'class = "ad box" title=x', False) == ".ad"


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, "u", "<p>some words</p>", "old", "k", 5), (None, None, None, None, None, None)]  # text, kind, frame are taken
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, kind string, frame int")
    got = html.extract(pages, {}).collect()
    assert [(r["page_id"], r["text"], r["kind"], r["frame"]) for r in got] == [(1, "some words", "k", 5), (None, "", None, None)]
