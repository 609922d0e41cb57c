"""Fragments: blocks, tables, headings and white space in plain cases."""

import time

from pagewright.operators import fragments

NB = " "
CENTRE = 'style="text-align:center"'
CASES = [
    ("plain line\n\n 中 文 a b\n<", "<p>plain line</p>\n<p>中文a b</p>\n<p>&lt;</p>", []),
    ("", "", []), (None, "", []), ("<p>甲  乙</p><p>a  b</p>", "<p>甲乙</p>\n<p>a b</p>", []),
    ("<h1>标题</h1><p>正文</p>", f'<h1 id="h1" {CENTRE}>标题</h1>\n<p>正文</p>', [("h1", 1, "标题")]),
    ('<h1 class="page-align-left x">A &amp; <em>b</em></h1><h3></h3><h6>c</h6>', f'<h1 id="h1" class="page-align-left" {CENTRE}>A&amp;<em>b</em></h1>\n<h3 id="h2" {CENTRE}></h3>\n<h6 id="h3" {CENTRE}>c</h6>', [("h1", 1, "A&b"), ("h3", 6, "c")]),
    ('<h1 data-pl="2">t</h1>', '<h1 id="h1" style="margin-left:2em;text-align:center">t</h1>', [("h1", 1, "t")]),
    ('<p class="page-citation" data-pl="2" data-ind="first">段落</p>', '<p class="page-citation" style="margin-left:2em;text-indent:2em">段落</p>', []),
    (f'<p class="page-align-lines"> 甲  乙{NB}{NB} </p>', f'<p class="page-align-lines">甲  乙{NB}{NB}</p>', []), ('<p class="page-align-right"> 甲 乙 </p>', '<p class="page-align-right"> 甲 乙 </p>', []),
    ('<p class="page-divider page-divider-wavy evil">─</p>', '<p class="page-divider page-divider-wavy">─</p>', []),
    ("loose<p>in</p>after", "<p>loosein</p>\n<p>after</p>", []), ("<p>a<p>b</p></p></h1>c", "<p>a</p>\n<p>b</p>\n<p>c</p>", []), ("<p>a</h1>b</p>", "<p>ab</p>", []), ("<h2>a", f'<h2 id="h1" {CENTRE}>a</h2>', [("h1", 2, "a")]),
    ("x<table><tr><td> 前 后 </td></tr></table>y<h1>z</h1>", f"<p>x</p>\n<table><tr><td> 前 后 </td></tr></table>\n<h1 id=\"h1\" {CENTRE}>yz</h1>", [("h1", 1, "z")]),
    ('<p>a</p><table class="page-noborder"><tr><td colspan="2"> b </td><td><p data-lh="1.8" class="evil page-citation">c  d</p></td></tr></table>', '<p>a</p>\n<table class="page-noborder"><tr><td colspan="2"> b </td><td><p class="page-citation" style="line-height:1.8">c  d</p></td></tr></table>', []),
    ("<table><tr><td><h1>no</h1>", "<table><tr><td><h1>no</h1>", []), ("<p><math><mtext>if x</mtext> <mi>y</mi></math> 文 字</p>", "<p><math><mtext>if x</mtext> <mi>y</mi></math>文字</p>", []),
    ('<p>a<span data-page-marker="x">b</span><img src="a b" alt="c d"/></p>', '<p>ab</span><img src="a b" alt="c d"/></p>', []),
]


def test_fragments(spark):
    df = spark.createDataFrame([(i, x) for i, (x, *_) in enumerate(CASES)], "i int, html string").repartition(3)
    got = {x.i: (x.html, [tuple(h) for h in x.headings]) for x in fragments.rendered(df, "i", "html").collect()}
    bad = {x: (got[i], (want, heads)) for i, (x, want, heads) in enumerate(CASES) if got[i] != (want, heads)}
    assert bad == {} and len(got) == len(CASES)
    assert fragments.rendered(df.limit(0), "i", "html").count() == 0


def test_long_pages(spark):
    page = "".join(f"<h2>t{i}</h2><p>{'word ' * 20}</p>" for i in range(8000)) + "<table>" + "<tr><td>a</td></tr>" * 20_000 + "</table>"
    began = time.time()
    (out,) = fragments.rendered(spark.createDataFrame([(1, page)], "i int, html string"), "i", "html").collect()
    assert len(out.headings) == 8000 and out.headings[-1].id == "h8000" and out.html.endswith("</table>") and time.time() - began < 60
