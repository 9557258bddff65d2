import html
import random
import re
import time

import pytest

from duplexa.llm.pages import Page, extract, host_of


def text(source):
    return Page(source).main_text()


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b<br>c</p>d", "a\nb c\nd"),
        ("<body><nav><ul><li>menu</ul></nav><article><h1>T &amp;  u</h1><p>x&lt;y &#233;&nbsp;z<p><b>bold<br><p>next</article><footer>f</footer>", "T & u\nx<y é z\nbold\nnext"),
        ("<div class='ad'>buy</div><div id=main-content><p>one</p><div class=\"comments\"><p>reply</p></div></div>after", "one"),
        ("<main><header><h1>Head</h1></header><section><p>a</p></section><aside>s</aside><form><p>f</p></form></main><p>out", "Head\na"),
        ("<header>top</header><p>body</p><div role=navigation>n</div>", "body"),
        ('<script>var t="</p><p>no";</script><style>p{}</style><title>t</title><p>yes<!-- no --> &copy; <a href="x>y">link</a>', "yes © link"),
        ("<article class=comment><p>long reply text here</article><article><p>own</article>", "own"),
        ("<article>short</article><article><p>the longer one</article>", "short\nthe longer one"),
        ("<article><h1>t</h1><div class=promo-code>SAVE10</div><p id=share-price>41.20</p><section class='social-history'>x</section><div class=notices-of-intent>y</div><div class=ads>no</div></article>", "t\nSAVE10\n41.20\nx\ny"),
        ("<div class=share-box>no</div><p>yes</p><div class=content>more</div><div class='x content'>again</div>", "more\nagain"),
        ("<table><tr><td><p>a<td>b<tr><td>c</table><dl><dt>d<dd>e<dt>f</dl><b><li>g</b><li>h", "a\nb\nc\nd\ne\nf\ng\nh"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
        ("<p>a < b and c > d <3", "a < b and c > d <3"),
        ("<p>cut <a href='unclosed", "cut"),
        ("<div class=shadow><p class=headline>keep</p></div>", "keep"),
        ("<p>one<!-- open comment <p>two", "one"),
        ("<article><p>a<span class=ad>x</span>b</p></article>", "ab"),
    ],
)
def test_extraction(source, want):
    assert text(source) == want


def test_long_pages_stay_linear():
    assert text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert text('<a href="' * 300 + "x") is not None
    assert len(text("<p>word</p>" * 100000).split("\n")) == 100000


@pytest.mark.parametrize("source", ["<b></i>", "<i><div><b></i>", "<b><li></li>", "<p><b><i></p></b>", "</div>", "<span class=ad></p>"])
def test_unmatched_tags_stay_linear(source):
    began = time.perf_counter()
    Page("<i><div>" + source * 5000)
    one = time.perf_counter() - began
    Page("<i><div>" + source * 40000)
    assert time.perf_counter() - began - one < 20 * one + 0.5


BOX = "<div><a href=/s>Follow us everywhere</a></div>"


def test_templates_of_a_host_are_removed(spark):
    rows = [(i, f"https://a.example/{i}", f"<body><h1>t{i}</h1>{BOX}<p>Released under the MIT License.</p><p>own text that is the longest of all here {i}</p>", 0) for i in range(8)]
    rows += [(10 + i, f"https://b.example/{i}", f"<body>{BOX}<p>own text of another {i}</p>", 0) for i in range(3)] + [(20, None, None, 0), (21, "x", "", 0), (21, "x", "", 0), (None, None, "<p>z", 0)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, blocks int")
    got = extract(docs).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[3].text == "t3\nReleased under the MIT License.\nown text that is the longest of all here 3" and by[3].n_chars == len(by[3].text)
    assert by[11].text == "Follow us everywhere\nown text of another 1"
    assert by[20].text == "" and by[20].n_chars == 0 and by[None].text == "z"
    assert extract(docs.limit(0)).count() == 0
    assert host_of("HTTP://u@A.example:8080/x") == "a.example" and host_of(None) == host_of("x") == ""


def test_copies_of_an_article_are_no_template_and_names_need_the_host(spark):
    article = "<article><h1>t</h1><p>a long paragraph that makes the article what it is</p><div>the inner part of it</div><p>{}</p></article>"
    rows = [(i, f"https://a.example/{i}", article.format("same" if i < 20 else f"edited {i}")) for i in range(40)]
    rows += [(100 + i, f"https://b.example/{i}", f"<article><p>text number {i} with words</p><div class='social-links'>see {i * 7}</div><div class=promo-{'code' if i == 2 else 'x' + chr(97 + i)}>p{i}</div></article>") for i in range(9)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "t\na long paragraph that makes the article what it is\nthe inner part of it\n" + ("same" if i < 20 else f"edited {i}") for i in range(40))
    assert [got[100 + i] for i in range(9)] == [f"text number {i} with words\np{i}" for i in range(9)]


def test_boxes_put_into_every_page_are_removed_again(spark):
    """The whole table with boxes of each host's own inside all articles and bare bodies: the text is what it was without them."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    before = {p: Page(h).main_text() for p, h in zip(pages.page_id, pages.html)}
    pages["host"] = pages.url.map(host_of)
    longest = pages.html.map(lambda h: max(Page(h).main()[0], key=len, default=""))
    many = longest.groupby(pages.host).transform("nunique") >= 5
    for at, (host, source) in enumerate(zip(pages.host, pages.html)):
        box = f"<section><h3>More from {host}</h3><ul><li>one of {host}</li><li>two</li></ul></section><div class=share-row>tell {at}</div>"
        pages.loc[at, "html"] = source.replace("</article>", box + "</article>") if at % 2 else source.replace("</h1>", "</h1>" + box, 1)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages[["page_id", "url", "html"]])).collect()}
    assert many.sum() > 30
    for page, is_many in zip(pages.page_id, many):
        assert (got[page] == before[page]) == bool(is_many)


def test_deletions_against_brute_force(spark):
    """Random nests of boxes on two hosts: what is deleted is what plain counting of subtrees over all pages says."""
    rng = random.Random(2)
    boxes = [f"<div><p>box {i}</p></div>" for i in range(6)]
    boxes += [f"<section>{a}{b}<p>outer</p></section>" for a, b in zip(boxes, boxes[1:])]
    rows = []
    for i in range(60):
        parts = [f"<p>page {i} has this text of its own</p>", *rng.sample(boxes, rng.randrange(4))]
        rng.shuffle(parts)
        rows.append((i, f"https://{'ab'[i % 2]}.example/{i}", "<body>" + "".join(parts)))
    found = {}
    for i, url, source in rows:
        for box in boxes:
            if box in source:
                found.setdefault((url[8], box), set()).add(i)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, url, source in rows:
        for box in sorted(boxes, key=len, reverse=True):
            if len(found.get((url[8], box), ())) >= 5:
                source = source.replace(box, "")
        assert got[i] == Page(source).main_text()
    assert 0 < sum(len(v) >= 5 for v in found.values()) < len(found)


def test_whole_table_against_the_article_of_each_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    own = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.DOTALL)[1]
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert own[r.page_id] == "\n".join(x for x in lines if x)
