"""Operators in plain cases: rules, tables, lexicon, EPUB, progress and streams."""

import io
import os
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import chapters, commands, geometry, images, lexicon, markers, pages, rules, tables
from pagewright.sources import epub, files, sinks
from pagewright.streaming import progress


def apply(markup, **c):
    return rules.apply_rules(markup, [{"id": "1", "mode": "all", "conditions": [c]}])


@pytest.mark.parametrize(
    "markup,cond,want",
    [
        ("<p>abc</p>", {"pattern": "b", "formats": ["bold"]}, "<p>a<strong>b</strong>c</p>"),
        ("<p>aaa</p>", {"pattern": "aa", "formats": ["italic"]}, "<p><em>a</em><em><em>a</em>a</em></p>"),
        ("<p>a</p><p>b</p>", {"type": "regex", "pattern": "^a", "formats": ["heading1", "heading2"]}, "<h1>a</h1><p>b</p>"),
        ("<p><b>a</b><i>b</i></p>", {"formats": ["no_bold"]}, "<p>a<em>b</em></p>"),
        ("<p><b>a</b><span class='page-note'>b</span></p>", {"formats": ["remove"]}, "<p>ab</p>"),
        ("<p>a b</p>", {"formats": ["strip_ws"]}, "<p>ab</p>"),
        ("<p>x: y; z</p>", {"type": "regex", "pattern": ":", "target": "between", "between_end_pattern": ";", "formats": ["bold"]}, "<p>x:<strong> y</strong>; z</p>"),
        ("<p>a</p>", {"pattern": "q", "formats": ["bold"]}, "<p>a</p>"),
        ("<p>a<script>x</script></p>", {"formats": ["h1"]}, "<p>a</p>"),
        ("<p class='page-divider'>a</p>", {"formats": ["heading1"]}, '<p class="page-divider">a</p>'),
    ],
)
def test_rules(markup, cond, want):
    assert apply(markup, **cond) == (want, None)


def test_rule_errors():
    assert apply("<p>a</p>", type="regex", pattern="(a+)+", formats=["bold"]) == ("<p>a</p>", "unsafe pattern")
    assert apply("<p>a</p>", type="regex", pattern="(", formats=["bold"])[0] == "<p>a</p>"
    assert rules.apply_rules("<p>a</p>", [], "9") == ("<p>a</p>", "no such rule")


def test_first_and_selection():
    two = [{"id": "1", "conditions": [{"pattern": "a", "formats": ["bold"]}, {"pattern": "b", "formats": ["bold"]}]}]
    assert rules.apply_rules("<p>ab</p>", two)[0] == "<p><strong>a</strong>b</p>"
    sel = [{"id": "1", "conditions": [{"scope": "selection", "formats": ["italic"]}]}]
    assert rules.apply_rules("<p>abcd</p>", sel, None, (1, 3))[0] == "<p>a<em>bc</em>d</p>"
    assert rules.apply_rules("<p>abcd</p>", sel)[0] == "<p>abcd</p>"


TABLE = "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"


@pytest.mark.parametrize(
    "text,kw,want",
    [
        ("| A | B |\n|---|---|\n| 1 | 2 |", {}, TABLE),
        ("A | B\n---|---\n1 | 2\nend", {}, TABLE + "\nend"),
        ("｜A｜B｜\n｜---｜---｜\n\n｜1｜2｜", {}, TABLE),
        ("Cap | A | B\n|---|---|\n| 1 | 2 |", {}, "<p>Cap</p>\n" + TABLE),
        ("| A | B |\n| 1 | 2 |", {}, "| A | B |\n| 1 | 2 |"),
        ("| A | B |\n| 1 | 2 |", {"need_separator": False}, TABLE),
        ("+---+---+\n| A | B |\n+---+---+\n| 1 | 2 |\n+---+---+", {}, TABLE),
        ("A  B\n1\t2\nend", {"spaced": True}, TABLE + "\nend"),
        ("A　　B\n1  2\nend", {"spaced": True}, TABLE + "\nend"),
        ("┏━┯━┓\n│A│B│\n┠─┼─┫\n│1│2│\n┗━┷━┛", {}, TABLE),
        ("---\n| A | B |\n| 1 | 2 |\n---", {}, "---\n| A | B |\n| 1 | 2 |\n---"),
        ("=====\n| A | B |\n=====", {}, "=====\n| A | B |\n====="),
        ("普通一行──没有竖边框", {}, "普通一行──没有竖边框"),
        ("| A | B || 1 | 2 |", {}, TABLE),
        ("| | B || 1 | 2 |", {}, TABLE.replace(">A<", "><")),
        ("| a || b |", {}, "| a || b |"),
        ("a | b || c | d", {}, "a | b || c | d"),
        ("| A | B |\n|---|---|\nno rows", {}, "| A | B |\n|---|---|\nno rows"),
        ("| A | B |\n|---|---|\n| 1 | 2 | 3 |", {}, TABLE.replace("<td>2<", "<td>23<")),
    ],
)
def test_tables(text, kw, want):
    out, chunks = tables.page_tables(text, **kw)
    assert out == want and tables.page_tables(out, **kw)[0] == out
    assert all(0 <= a < b <= len(text.split("\n")) for a, b, _ in chunks)


def test_table_round_trip():
    pipes = tables.table_to_pipes("<p/>" + TABLE)
    assert pipes == "| A | B |\n| --- | --- |\n| 1 | 2 |" and tables.page_tables(pipes)[0] == TABLE and tables.table_to_pipes("<p>x</p>") is None


def test_tokens_and_differences():
    assert lexicon.differences("abXd", "abYd") == [{"start": 2, "end": 3, "wrong": "X", "candidates": ["Y"]}]
    assert lexicon.differences("abcd", "abd") == [{"start": 2, "end": 3, "wrong": "c", "candidates": []}] and lexicon.differences("ab", "abc") == []


def test_candidates(spark):
    words = spark.createDataFrame([("再见", 50000), ("在", 900000), ("再", 90000), ("在见", 3)], "word string, freq long")
    pairs = lexicon.pairs_from_lines(spark.createDataFrame([("再 在",), ("# 一 二",), ("三",)], "value string"))
    assert {tuple(r) for r in pairs.collect()} == {("再", "在"), ("在", "再")}
    fixes = spark.createDataFrame([("坏", "再")], "wrong string, fixed string")
    got = lexicon.candidates(spark.createDataFrame([("在",), ("坏",), ("在再",)], "wrong string"), words, pairs, fixes, least=0.2).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.wrong, []).append(r.word)
    assert by["坏"] == ["再"] and by["在"][0] == "再" and "再见" not in by["在"] and set(by["在再"]) <= {"再见", "在见", "在", "再"}


def test_epub():
    book = epub.write_book("T & T", "A", "en", [("One", "<p>x<br/></p>"), ("Two", "<p>y</p><script>z</script>")], b"png")
    z = zipfile.ZipFile(io.BytesIO(book))
    assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert [b for _, b in epub.read_spine(book)] == ["<p>x<br/></p>", "<p>y</p>"]
    assert epub.read_meta(book) == {"title": "T & T", "author": "A", "description": None, "language": "en", "cover": "OEBPS/Images/cover.png"}
    changed = epub.update_meta(book, title="N")
    assert epub.read_meta(changed)["title"] == "N" and epub.read_spine(changed) == epub.read_spine(book)
    assert epub.write_book("a", "b", "c", []) == epub.write_book("a", "b", "c", [])


def test_broken_books_and_pages(spark):
    rows = spark.createDataFrame([("a", b"no zip"), ("b", epub.write_book("t", "", "en", [("x", "y")]))], "path string, content binary")
    got = {r.path: r for r in epub.books(rows).collect()}
    assert got["a"].error and got["a"].spine == [] and got["b"].error is None and got["b"].spine[0].body == "y"
    out = files.infer_pages(spark.createDataFrame([("p1", 1, b"ok"), ("p2", 2, b"x")], "img string, page int, content binary"), files.fake_backend).collect()
    assert {(r.page, r.result, r.error is None) for r in out} == {(1, "2", True), (2, None, False)}
    assert files.jpeg_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20" + bytes(9)) == (32, 16) and files.jpeg_size(b"x") is None


def test_geometry(spark):
    lines = [(0, "第二", [100.0, 0.0, 160.0, 20.0]), (1, "第一", [0.0, 2.0, 60.0, 22.0]), (2, "下一行", [0.0, 30.0, 60.0, 50.0]), (3, "没有框", None), (4, "结束。", [0.0, 60.0, 60.0, 80.0])]
    df = spark.createDataFrame([(1, *r) for r in lines], "page int, seq int, text string, box array<double>")
    rows = geometry.visual_rows(df, ["page"]).orderBy("place").collect()
    assert [r.text for r in rows] == ["第一", "第二", "下一行", "结束。", "没有框"]
    none = spark.createDataFrame([(1, 0, "b", None), (1, 1, "a", None)], "page int, seq int, text string, box array<double>")
    assert [r.text for r in geometry.paragraphs(none, ["page"]).orderBy("paragraph").collect()] == ["b", "a"]


def test_page_specs(spark):
    df = spark.createDataFrame([("1-3, 5,9-7,x,2-",), ("",), (None,), ("0",), ("7",)], "s string")
    assert [r[0] for r in df.select(pages.page_numbers(F.col("s"))).collect()] == [[1, 2, 3, 5, 7, 8, 9], [], [], [], [7]]


def test_split_limit():
    parts = chapters.split_limit("<p>aa</p><table><tr><td>" + "x" * 50 + "</td></tr></table><p>b</p>", 30)
    assert "".join(parts).count("<table>") == 1 and any(p.startswith("<table>") and p.endswith("</table>") for p in parts)


def test_progress_batch_and_stream(spark, tmp_path):
    rows = [("j", i, "ocr", i * 2, 20, float(i * 4)) for i in range(6)] + [("j", 6, "render", 0, 5, 30.0), ("j", 7, "done", 5, 5, 31.0), ("k", 0, "manual", 1, 9, 0.0)]
    schema = "job string, seq long, stage string, done long, total long, now double"
    batch = sorted(map(tuple, progress.estimates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert batch[0][5] is None and [r for r in batch if r[2] == "done"][0][6] == 0.0 and abs(batch[5][7] - 0.5) < 1e-9
    for i in range(3):
        spark.createDataFrame(rows[i * 3 : i * 3 + 3], schema).coalesce(1).write.json(f"{tmp_path}/in", mode="append")
        q = progress.streaming_estimates(spark.readStream.schema(schema).json(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=repr) == batch


def test_follow_pages(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    seen = []
    spark.createDataFrame([(1, 1, "old", 1), (1, 1, "new", 2), (1, 2, "b", 1)], "book int, page int, text string, version int").write.json(f"{tmp_path}/in", mode="append")
    q = progress.follow_pages(spark, f"{tmp_path}/in", "book int, page int, text string, version int", lambda df, i: seen.extend(map(tuple, df.collect())), f"{tmp_path}/c")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [(1, 1, "new", 2), (1, 2, "b", 1)]


def test_regex_safety():
    unsafe = ["(a+)+", "(a|b*)*", "((a+))+", "((a+)b?)*", r"(\d+)*x", "([abc]+)+", "(a?)+", "(?:x(?:ab)+y)*", "a" * 513]
    safe = ["a+", "(ab)+c", "(.*)+", r"([\s\S]+)+", "(?:ab)+", "(a+)?", "(a+){2}", r"\(a+\)+", "[(a+)]+", "a" * 512]
    assert [p for p in unsafe if rules.regex_is_safe(p)] == [] and [p for p in safe if not rules.regex_is_safe(p)] == []


def test_find_and_replace_formats():
    page = '<p>x<strong>ab</strong><strong>c</strong>d<span class="page-note page-shade" style="x">e</span></p>'
    assert rules.texts_with_format(page, "bold") == [(1, 4, "abc")] and rules.texts_with_format(page, "shade") == [(5, 6, "e")]
    assert rules.replace_format("<p><b>a</b></p>", "bold", "italic") == "<p><em>a</em></p>"
    assert rules.replace_format("<p><b>a</b></p>", "bold", "note") == '<p><span class="page-note">a</span></p>'
    assert rules.replace_format(page, "note", "italic").endswith('d<span class="page-shade" style="x"><em>e</em></span></p>')
    assert rules.replace_format(page, "shade", "highlight").endswith('d<span class="page-note page-highlight" style="x">e</span></p>')
    assert rules.replace_format("<p>a</p>", "bold", "sup") == "<p>a</p>"


def test_many_ranges_in_one_pass():
    markup = "<p>" + "ab " * 3000 + "</p>"
    began = time.time()
    out, error = rules.apply_rules(markup, [{"id": 1, "mode": "all", "conditions": [{"type": "regex", "pattern": "(a)(b)", "group_formats": [["italic"], ["bold"]]}]}])
    assert error is None and out == "<p>" + "<em>a</em><strong>b</strong> " * 3000 + "</p>" and time.time() - began < 5


@pytest.mark.parametrize(
    "script,want",
    [
        ("1,2合并", ["ab", "c", "d"]), ("（1,2合并）加粗", ["<strong>ab</strong>", "c", "d"]), ("3删除；1替换 x y", ["x y", "b", "d"]), ("2-3 clear", ["a", "", "", "d"]),
        ("4,2 标题2", ["a", "<h2>b</h2>", "<h2>c</h2>", "<h2>d</h2>"]), ("选 3; 包围 书名号", ["a", "b", "《c》", "d"]), ("2,3包围 【】", ["a", "【b", "c】", "d"]),
        ("fmt 斜体", [f"<em>{x}</em>" for x in "abcd"]), ("((1,2mg)(2,3mg))b", ["ab", "<strong>cd</strong>"]), ("", ["a", "b", "c", "d"]), ("1rp (x)", ["(x)", "b", "c", "d"]),
    ],
)
def test_commands(script, want):
    assert commands.run(["a", "b", "c", "d"], script) == want


@pytest.mark.parametrize("script", ["5删除", "1,1合并", "无此", "（1删除", "1包围 abc", "1 fmt 无", "0删除"])
def test_commands_that_do_not_fit(script):
    with pytest.raises(ValueError):
        commands.run(["a", "b", "c", "d"], script)


def test_substitution_and_scripts(spark):
    df = spark.createDataFrame([(1, "a/b a/b"), (2, "a/b"), (9, "A/B"), (10, None)], "page int, text string")
    got = lambda c: {x.page: x.text for x in commands.substituted(df, c).collect()}
    assert got(r"%s/a\/b/$1/gi") == {1: "$1 $1", 2: "$1", 9: "$1", 10: None}
    assert got(r":2,1s/a\/b/x/") == {1: "x a/b", 2: "x", 9: "A/B", 10: None} and got("s/zz/x/")[1] == "a/b a/b"
    rows = spark.createDataFrame([("a\nb", "1,2合并"), ("a", "1,2合并"), (None, "1删除")], "t string, s string")
    assert [tuple(x.edited) for x in commands.run_scripts(rows, "t", "s").collect()] == [("ab", None), ("a", "no lines 1 to 2"), ("", None)]


def test_markers(spark):
    a, p, n, c = markers.ARTICLE, markers.PARAGRAPH, markers.NOTE, 'class="page-note"'
    rows = [
        (1, 1, 1, f"<p>one{n}"), (1, 1, 2, f"two{p}"), (1, 2, 1, f" and three{a}new {n} x{n}"), (1, 2, 2, f"<p {c}>(first) note</p>"), (1, 2, 3, f"<p {c}>（second）</p>"),
        (1, 3, 1, f"<p {c}>thi"), (1, 4, 1, f"{p}rd</p>"), (2, 1, 1, f"x{n}{n}"), (2, 1, 2, f"<p {c}>only</p>"), (3, 1, 1, "plain"), (3, 1, 2, f"<p {c}>stays</p>"), (3, 2, 1, None), (4, 1, 1, f"{a}a{a}"),
    ]
    got = {(x.book, x.article): (x.body, x.error) for x in markers.apply_markers(spark.createDataFrame(rows, "book int, page int, n int, html string").repartition(3)).collect()}
    note = lambda x: f'<span class="page-note-inline">{x}</span>'
    assert got == {
        (1, 0): (f"<p>one{note('（（first） note）')}\ntwo and three", None), (1, 1): (f"new {note('（second）')} x{note('（third）')}", None),
        (2, None): (None, "2 note marks, 1 notes"), (3, 0): (f"plain\n<p {c}>stays</p>", None), (4, 1): ("a", None),
    }


def test_throttled(spark):
    r = random.Random(3)
    rows = [(j, i, float(t)) for j in "ab" for i, t in enumerate(sorted(r.uniform(0, 40) for _ in range(300)))] + [("c", 7, 1.0)]
    want = set()
    for j in "abc":
        last, mine = None, [x for x in rows if x[0] == j]
        for _, i, now in mine:
            if last is None or now - last >= 2.0:
                last = now
                want.add((j, i))
        want.add((j, mine[-1][1]))
    df = spark.createDataFrame(rows, "job string, seq long, now double").repartition(3)
    assert {tuple(x) for x in pages.throttled(df).collect()} == want and pages.throttled(df.limit(0)).count() == 0


def test_running_and_ranges(spark):
    df = spark.createDataFrame([(list(range(1000)),), ([],), ([5],)], "v array<int>")
    got = [x[0] for x in df.select(t.running(F.col("v"), F.lit(0), lambda a, x: a + x)).collect()]
    assert got == [[sum(range(i + 1)) for i in range(1000)], [], [5]]
    texts = ["aaaa", "abab", "", None, "xaax", "é.aa\naa", "$a$a"]
    for term in ("aa", "a", ".", "$a", "aba"):
        want = [[i for i in range(len(x)) if x.startswith(term, i)] if x is not None else None for x in texts]
        rows = spark.createDataFrame([(x,) for x in texts], "x string").select(rules.contains_ranges(F.col("x"), term)).collect()
        assert [x[0] or [] for x in rows] == [w or [] for w in want], term


def test_context_and_fixes(spark):
    words = spark.createDataFrame([("ab",), ("bc",)], "word string")
    rows = spark.createDataFrame([(1, "xa", "b", "z"), (2, "", "b", "cd"), (3, "b", "a", "c"), (4, None, "b", None)], "id int, before string, candidate string, after string")
    assert {x.id: x.boost for x in lexicon.context_boost(rows, words).collect()} == {1: 0.15, 2: 0.15, 3: 0.0, 4: 0.0}
    texts = spark.createDataFrame([(1, "xx yy xx"), (2, "zz"), (3, "")], "id int, text string")
    spans = spark.createDataFrame([(1, 0, 2, "xx"), (1, 1, 3, "xx"), (1, 6, 8, "xx"), (1, 3, 5, "yy")], "id int, start int, end int, wrong string")
    best = spark.createDataFrame([("xx", "Q", 0.85, 1), ("yy", "W", 0.84, 1)], "wrong string, word string, score double, rank int")
    assert {x.id: (x.text, x.n_fixed) for x in lexicon.auto_fixed(texts, spans, best).collect()} == {1: ("Q yy Q", 2), 2: ("zz", 0), 3: ("", 0)}


def test_image_styles():
    out = images.inlined('<div><p class="page-img-full"><img src="a"></p><p class="page-img-full page-img-right"><img class="page-img-w25" src="b"/></p></div>')
    both = "display:inline-block;max-width:100%;width:100%;vertical-align:middle"
    assert out == (
        '<div><p class="page-img-full" style="page-break-before:auto;page-break-after:always;text-align:center">' f'<img src="a" style="{both}" width="100%"></p>'
        '<p class="page-img-full page-img-right" style="page-break-before:always;page-break-after:always;text-align:right">' f'<img class="page-img-w25" src="b" style="{both}" width="100%"/></p></div>'
    )
    assert images.inlined(out) == out
    same = ['<p>no image</p>', '<p><img src="x"/></p>', '<p class="page-img-left" style="a:b"><img src="x" style="c:d" class="page-img-w50"/></p>', '<img class="other img-w50">']
    assert [images.inlined(x) for x in same] == same
    assert images.inlined('<img class="page-img-float-left page-img-w50" width="9">') == '<img class="page-img-float-left page-img-w50" width="9" style="display:inline-block;float:left;max-width:100%;width:50%;margin:0 0.5em 0.4em 0">'
    assert images.inlined('<img class="page-img-inline page-img-vtop">').endswith('style="display:inline-block;max-width:100%;height:auto;vertical-align:top">')
    page = '<td><p>a</p><ul><p class="page-img-full"><img src="<>"></p></ul>\n<section>t<p class="page-img-full">\n<IMG SRC="b">'
    assert images.inlined(page).count("page-break-before:always") == 1 and images.inlined(page).count("page-break-before:auto") == 1
