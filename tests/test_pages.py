"""Search results and article pages from hand-made HTML."""

import re

import pytest
from pyspark.sql import functions as F

from tesserae.sources import elements, pages

RESULTS = """<html><body><span id="totalCount"> 12 </span><div id="news_list"><ul>
<li><a name="x">no address</a><p>belongs to nothing</p></li>
<li><p>before any hit</p></li>
<li><b><a href="/article/1234567?x=1">　甲  <i>乙</i><br> 丙</a></b> 来源：人民网 发布时间：2024-05-06</li>
<li><a href="/article/12">too short an id</a></li>
<li><p>第一 段</p></li><li><p>第二段</p></li>
<li><a href="/x/7654321">丁&amp;戊</a>来源：　某报 [2023-01-02]<ul><li><p>inner</p></li></ul></li>
<li><a href="/article/7777777">己</a> 2020-02-03</li>
</ul></div></body></html>"""

DETAIL = """<body><h1>outside</h1><div class="x d2txt"><h1>标题<br>一</h1><h3>副题</h3>
<div class="d2txt_1">某地</div><div class="d2txt_1">来源：新华社   发布时间：2024-01-02</div><div class="d2txt_1">来源：乙报 2000-01-01</div>
<div class="d2txt_con"><p>　　甲&nbsp;乙 <br> 丙<script>var p="<p>";</script><img src="a"><button>go</button></p>
<p><p>内 一</p><p>内二</p></p><p> </p><video><p>caption</p></video></div></div></body>"""


def read(spark, column, html):
    return spark.createDataFrame([(html,)], "html string").select(column.alias("r")).first().r


def test_search_results(spark):
    got = read(spark, pages.search_results(F.col("html"), "http://x"), RESULTS)
    hit = lambda i, t, d, o, s: (i, t, f"http://x/article/{i}", d, o, s)
    assert [tuple(h) for h in got.hits] == [
        hit("1234567", "　甲 乙\n丙", "2024-05-06", "人民网", "第一 段"),
        hit("7654321", "丁&戊", "2023-01-02", "某报", "inner"),
        hit("7777777", "己", "2020-02-03", None, ""),
    ]
    assert (got.total, got.error) == (12, None)
    got = read(spark, pages.search_results(F.col("html")), RESULTS.replace("news_list", "other").replace(" 12 ", "12 hits"))
    assert (got.total, got.hits, got.error) == (None, [], "missing_list")
    assert read(spark, pages.search_results(F.col("html")), None).error == "missing_list"
    assert read(spark, pages.search_results(F.col("html")), '<p id="news_list">').hits == []


def test_details(spark):
    got = read(spark, pages.detail_fields(F.col("html")), DETAIL)
    assert (got.title, got.subtitle, got.origin, got.date, got.error) == ("标题\n一 副题", "副题", "新华社", "2024-01-02", None)
    assert got.body == "　　甲 乙\n丙\n\n内 一\n\n内二"
    for change, error in [
        (("d2txt\"", "other\""), "missing_container"), (("d2txt_con", "other"), "missing_body"),
        (("<h1>标题<br>一</h1>", ""), "missing_title"), (('<div class="d2txt_con">', '<div class="d2txt_con"></div><div>'), "empty_body"),
    ]:
        assert read(spark, pages.detail_fields(F.col("html")), DETAIL.replace(*change)).error == error
    same = read(spark, pages.detail_fields(F.col("html")), DETAIL.replace("<h3>副题", "<h3>标题"))
    assert same.title == "标题\n一" and same.subtitle == "标题"
    plain = DETAIL.replace("<p>", "").replace("</p>", "")
    assert read(spark, pages.detail_fields(F.col("html")), plain).body == "　　甲 乙\n丙\n内 一内二"
    empty = read(spark, pages.detail_fields(F.col("html")), None)
    assert empty.error == "missing_container" and empty.title is None


@pytest.mark.parametrize("n", [1, 50_000])
def test_deep_pages(n):
    root = elements.tree("<p>a" * n + "<ul><li class='x y' id=q>z<li>w</ul>")
    assert [e.text() for e in root.select("li#q.y")] == ["zw"] and root.first("ul li li").text() == "w" and root.first("ol") is None
    assert root.text() == "a" * n + "zw"
    assert pages.body_paragraphs(root) == ["azw"]


def test_given_pages(spark):
    """Every given page against an event by event reading of its article."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        got = pages.detailed(r.html, "article", "", "article")
        art = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        want, held = [], []
        for tag, text in re.findall(r"(<p>|</p>)|((?:(?!</?p>).)+)", art, re.DOTALL):
            if tag == "<p>":
                held = [None] * len(held) + [""]
            elif tag and held:
                want.append(held.pop())
            elif held and held[-1] is not None:
                held[-1] += re.sub("<[^>]*>", "", text.replace("<br>", "\n"))
        assert got["body"].count("\n\n") + 1 == len([x for x in [*want, *held[::-1]] if x and x.strip()])


def test_cut_references(spark):
    """A title that ends within a reference, as SQL has it and as a browser reads it."""
    page = "<article><h1>a&amp;b &amp</h1><p>&lt;&quot;&gt; &ampx; &am &#65; &#x42; &copy; &copy & &lt</p></article>"
    got = read(spark, pages.detail_fields(F.col("html"), "article", "", "article", closed=True), page)
    assert (got.title, got.body) == ("a&b &amp", '<"> &ampx; &am A B \xa9 &copy & &lt')
    got = read(spark, pages.detail_fields(F.col("html"), "article", "", "article"), page)
    assert (got.title, got.body) == ("a&b &", '<"> &x; &am A B \xa9 \xa9 & <')
