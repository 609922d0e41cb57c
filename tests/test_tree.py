"""Pages as trees, ranges in one sweep, and rules on them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagewright.operators import rules
from pagewright.operators.tree import Tree, cleaned


@pytest.mark.parametrize(
    "markup,want",
    [
        ("你好世界", "<p>你好世界</p>"), ("a < b & c", "<p>a &lt; b &amp; c</p>"), ("", ""), (" \n ", ""), ("<p><b>粗</b> <i>斜</i></p>", "<p><strong>粗</strong> <em>斜</em></p>"),
        ("<h2>t</h2>\n<p>x</p>", "<h2>t</h2><p>x</p>"), ('<p><img alt="x"></p>', "<p></p>"), ('<p>a<img src="s" onerror="x" class="page-img-w50 y">b</p>', '<p>a<img class="page-img-w50" src="s"/>b</p>'),
        ('<p>x<span data-page-marker="join" class="page-marker">join</span></p>', '<p>x<span class="page-marker" data-page-marker="join">join</span></p>'),
        ('<p style="color:red">t</p><script>alert(1)</script><span>in</span>', "<p>t</p><p><span>in</span></p>"), ("<p>a<input type=hidden>b</p>", "<p>ab</p>"),
        ("<p>a<a href='javascript:x'>b</a>c</p>", "<p>ac</p>"), ("<ul><li>x</li></ul>y", "<p>y</p>"), ("<p>a<b>b</p>c", "<p>a<strong>bc</strong></p>"), ("</p>x</i>", "<p>x</p>"),
        ("<table><tr><td>1</td></tr></table>", "<p><table><tr><td>1</td></tr></table></p>"),
        ('<p><math xmlns="http://www.w3.org/1998/Math/MathML" href="x"><mi mathvariant="bold">x</mi></math></p>', '<p><math xmlns="http://www.w3.org/1998/Math/MathML"><mi mathvariant="bold">x</mi></math></p>'),
        ('<math xmlns="other">1</math>', "<p><math>1</math></p>"), ('<p class="page-caption-x page-captionx page-divider-wavy" data-ind="no" data-pl=" 1.5 ">c</p>', '<p class="page-caption-x page-divider-wavy" data-pl="1.5">c</p>'),
    ],
)
def test_cleaned(markup, want):
    assert cleaned(markup) == want


def plain_wraps(length, wraps):
    """Ranges one after another: each goes into every stretch of text that it touches."""
    tree = ["p", [("".join(chr(97 + i % 26) for i in range(length)), 0)]]

    def into(node, a, b, name):
        out = []
        for kid in node[1]:
            if isinstance(kid, list):
                out.append(into(kid, a, b, name))
                continue
            text, at = kid
            x, y = max(a - at, 0), min(b - at, len(text))
            out += [kid] if x >= y else [k for k in [(text[:x], at), [name, [(text[x:y], at + x)]], (text[y:], at + y)] if isinstance(k, list) or k[0]]
        return [node[0], out]

    for a, b, name in wraps:
        if a < b:
            tree = into(tree, a, b, name)
    write = lambda n: f"<{n[0]}>{''.join(write(k) if isinstance(k, list) else k[0] for k in n[1])}</{n[0]}>"
    return write(tree)


def test_wraps_in_one_sweep():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 30)
        wraps = [(r.randint(0, n), r.randint(0, n), r.choice(["strong", "em"])) for _ in range(r.randint(0, 9))]
        text = "".join(chr(97 + i % 26) for i in range(n))
        tree = Tree(f"<p>{text}</p>")
        tree.wrap([(a, b, t, {}) for a, b, t in wraps])
        assert tree.html() == plain_wraps(n, wraps), (n, wraps)
        assert tree.text() == text
        twice = Tree(f"<p>{text}</p>")  # in two sweeps
        twice.wrap([(a, b, t, {}) for a, b, t in wraps[:4]])
        twice.wrap([(a, b, t, {}) for a, b, t in wraps[4:]])
        assert twice.html() == tree.html()


def run(markup, selection=None, mode="all", **c):
    return rules.apply_rules(markup, [{"id": "1", "mode": mode, "conditions": [c]}], None, selection)[0]


def test_operations():
    span = lambda c, x: f'<span class="page-{c}">{x}</span>'
    assert run("<p>ab</p>", pattern="a", formats=["sup"]) == f"<p>{span('sup', 'a')}b</p>"
    assert run("<p>ab</p>", pattern="a", formats=["sup", "sub"]) == f"<p>{span('sub', 'a')}b</p>"
    assert run(f"<p>{span('sub', 'a')}b</p>", pattern="b", formats=["sup"]) == f"<p>a{span('sup', 'b')}</p>"
    for colour in ("green", "blue", "pink", "orange", "purple"):
        assert run("<p>ab</p>", pattern="b", formats=[f"highlight_{colour}"]) == f"<p>a{span(f'highlight-{colour}', 'b')}</p>"
    assert run("<p>a</p><p>b</p>", pattern="a", formats=["align_center", "align_left"]) == '<p class="page-align-center">a</p><p>b</p>'
    assert run("<p>a</p>", pattern="a", formats=["flush", "note"]) == '<p class="page-flush page-note">a</p>'
    assert run('<p class="page-flush">a</p>', pattern="a", formats=["hang_indent"]) == '<p class="" data-ind="hang" data-indv="2">a</p>'
    assert run("<p>a</p><p>b</p><p>c</p>", formats=["merge"]) == "<p>a b c</p>" and run("<p>a</p><p>b</p><p>c</p>", pattern="a", formats=["merge"]) == "<p>a b</p><p>c</p>"
    assert run('<p>a</p><p class="page-divider">-</p><p>c</p>', formats=["merge"]) == '<p>a</p><p class="page-divider">-</p><p>c</p>'
    assert run("<p>a  b　c\nd</p><p>e f</p>", pattern="a", formats=["strip_ws"]) == "<p>abc\nd</p><p>e f</p>"
    assert run('<p>a</p><p class="page-caption-x">b</p><p>c</p>', formats=["heading1"]) == '<h1>a</h1><p class="page-caption-x">b</p><h1>c</h1>'
    # a line end between blocks is no part of a match's range
    assert run("<p>a</p>\n<p>b</p>", type="regex", pattern="a\n", match_formats=[["heading2"]]) == "<h2>a</h2><p>b</p>"
    # operations of matches do not keep each other away, but alignments of one block do, the last place first
    assert run("<p>ab</p>", type="regex", pattern="a|b", match_formats=[["heading1", "align_left"], ["heading2", "align_right"]]) == '<h1 class="page-align-right">ab</h1>'
    assert run("<p>abcd</p>", (1, 3), scope="selection", formats=["note"]) == f"<p>a{span('note', 'bc')}d</p>" and run("<p>ab</p>", (0, 2), scope="selection", formats=["note"]) == '<p class="page-note">ab</p>'
    assert run("<p>abab</p>", (1, 4), scope="selection", pattern="ab", formats=["bold"]) == "<p>ab<strong>ab</strong></p>"
    assert run("<p>abab</p>", pattern="a", formats=["bold", "remove"]) == "<p><strong>a</strong>b<strong>a</strong>b</p>"
    assert run("<p>ab</p>", type="regex", pattern="(a)(b)?", group_formats=[["note"], ["none"]]) == f"<p>{span('note', 'a')}b</p>"


def test_many_overlapping_ranges_take_one_sweep():
    for ops in (["sup"], ["bold", "italic", "wavy"], ["heading2", "align_left"]):
        began = time.time()
        out = run("<p>" + "aa " * 4000 + "</p>", pattern="a", formats=ops)
        assert time.time() - began < 0.5 * len(ops) and out.count("a") >= 8000, ops


def test_deep_and_long_pages():
    deep = "<span>" * 5000 + "x"
    assert cleaned(deep) == "<p>" + "<span>" * 5000 + "x" + "</span>" * 5000 + "</p>"
    assert run("<p>x</p>" * 5000, formats=["heading1"]) == "<h1>x</h1>" * 5000


def test_character_styles(spark):
    cases = [
        ("color:red", "color:red"), ("", ""), (None, ""), ("font-size:100px", "font-size:72px"), ("font-size:7px", "font-size:8px"), ("font-size:12.5px", "font-size:12px"), ("font-size:13.5 PX", "font-size:14px"),
        ("font-size:12pt;color", ""), ("color:#FFF;color:#zz", "color:#fff"), ("color:Blue;text-align:RIGHT", "text-align:right;color:Blue"), ("font-family:'黑体' , x", ""), ('font-family:"serif"', "font-family:serif"),
        ("font-family:楷体, KaiTi;top:1px", ""), ("font-family:楷体, \tKaiTi, serif;top:1px", "font-family:楷体, KaiTi, serif"), ("color:red;color:x y", "color:red"), ("text-align:justify", ""), ("font-size:12345px", ""), ("a:b:c;color:ab", ""),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, style string")
    got = {x.i: x.s for x in df.select("i", rules.char_style(F.col("style")).alias("s")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
    from pagewright.operators.tree import character_style

    assert [character_style(x or "") for x, _ in cases] == [w for _, w in cases]
