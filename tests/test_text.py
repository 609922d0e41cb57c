"""Cases with their results for functions that DuckDB's regular expressions cannot express."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as t

CASES = {
    "half_to_full": (t.half_to_full, [("他说abc, 后面", "他说abc， 后面"), ("价 1,000 元;好:12:30", "价 1,000 元；好：12:30"), ("见https://a.b?c=1 吗?", "见https://a.b?c=1 吗？"), ("中文 (abc)!", "中文 （abc）！"), ("a!=b中", "a!=b中"), ("结束.", "结束。"), ("值 3.14 和 e.g. 例", "值 3.14 和 e.g. 例"), ("A&amp;B中;", "A&amp;B中；"), ("等等...", "等等..."), (None, "")]),
    "punct_base": (t.punctuation_base, [("Hello, world.", "Hello, world."), ("a，b", "a,b"), ("中文,好", "中文，好"), ("（x", "(x")]),
    "quotes": (t.quotes, [('他说"你好"了', "他说“你好”了"), ('He said "hi" ok', 'He said "hi" ok'), ("it's 'is' good", "it's 'is' good"), ("他'中'说", "他‘中’说")]),
    "ellipsis": (t.ellipsis, [("a...b…c", "a……bc"), ("x..y", "x..y"), ("一…\n二....三…", "一……\n二……三")]),
    "digits": (t.digit_punctuation, [("1。2，3、4。", "1.2,3,4."), ("1 。 2", "1.2"), ("共 1。 条", "共 1. 条"), ("H，W", "H,W"), ("test，OK", "test，OK"), ("圆周率 3.14，和", "圆周率 3.14，和"), ("H。", "H。"), ("１：２", "１:２")]),
    "alnum": (t.alnum_spaces, [("1 2 3", "123"), ("a b c d", "abcd"), ("A B", "AB"), ("a b", "a b"), ("A B\nC", "A B\nC"), ("is a test", "is a test")]),
    "spaces": (t.inline_spaces, [("中 文　字", "中文字"), ("hello  world", "hello world"), (" a\n b ", "a\nb"), ("a​­b", "a b"), (None, "")]),
    "fold": (lambda c: t.inline_spaces(c, True, False), [("《…，\n投入", "《…，投入"), ("hello \n world", "hello world")]),
    "symbols": (t.symbols_core, [("中[x]文", "中【x】文"), ("a【b】c", "a[b]c"), ("中--文", "中——文"), ("a……b", "a...b")]),
    "page_numbers": (t.strip_page_numbers, [("2\ntext\n3", "\ntext\n"), ("1918\ntext", "1918\ntext"), ("第 十二 页\n中\n- 4 -", "\n中\n"), ("a\n5\nb", "a\n5\nb"), ("7", ""), ("5 / 12\nx", "\nx")]),
    "brackets": (t.unify_brackets, [("（^{[1]】}x", "〔1〕x"), ("【甲】[乙]［丙］", "〔甲〕〔乙〕〔丙〕"), ("$〔a〕$", "〔a〕")]),
    "headings": (t.detect_headings, [("第一章\n这是正文。", "<h1>第一章</h1>\n<p>这是正文。</p>"), ("正文一句话。", "正文一句话。"), ("12 - 3", "12 - 3"), ("<b>x</b>\nTitle", "<b>x</b>\n<h1>Title</h1>")]),
    "bbox": (t.bbox_to_html, [("title [1,2,3,4]A&B\npage_number [1,2,3,4] 2\nother", "<h2>A&amp;B</h2>\nother"), ("no boxes", "no boxes")]),
    "duration": (lambda c: t.format_duration(c.cast("double")), [("0", "0秒"), ("45", "45秒"), ("192", "3分12秒"), ("3720", "1小时02分"), ("-1", "-")]),
    "uuid5": (t.uuid5, [("python.org", "7af94e2b-4dd9-50f0-9c9a-8a48519bdef0")]),
    "key": (t.natural_key, [("a10b", "a000000000210b"), ("x" + "9" * 25, "x0000000025" + "9" * 25)]),
    "page": (lambda c: t.page_of(c).cast("string"), [("scan_0012.png", "12"), ("x.png", "0"), ("3", "3")]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    f, cases = CASES[name]
    df = spark.createDataFrame([(i, x, want) for i, (x, want) in enumerate(cases)], "i int, x string, want string")
    got = df.select("x", "want", f(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in got if r.got != r.want] == []


def test_uuid5_is_the_standard_s():
    import uuid

    assert str(uuid.uuid5(uuid.NAMESPACE_URL, "python.org")) == CASES["uuid5"][1][0][1]


@pytest.mark.parametrize("name", ["half_to_full", "spaces", "page_numbers", "quotes"])
def test_idempotent(spark, name):
    f, cases = CASES[name]
    df = spark.createDataFrame([(x,) for x, _ in cases], "x string")
    assert df.where(f(f(F.col("x"))) != f(F.col("x"))).count() == 0


def test_join_fragments(spark):
    cases = [("中文 ", " 字", "中文字"), ("中", "a", "中 a"), ("a", "中", "a 中"), ("x1", "2", "x1 2"), ("", "b", "b"), ("a", None, "a"), ("—", "—", "——")]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    assert df.where(t.join_fragments(F.col("a"), F.col("b")) != F.col("want")).count() == 0
