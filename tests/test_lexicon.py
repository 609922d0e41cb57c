"""Tokens and phrases by a lexicon that is a table."""

import random

import pytest

from pagewright.operators import lexicon


def han(c):
    return "\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff"


def chosen(text, known, most, singles):
    out, i = [], 0
    while i < len(text):
        size = next((n for n in range(min(most, len(text) - i), 0, -1) if text[i : i + n] in known), 0) if han(text[i]) else 0
        if size or (singles and han(text[i])):
            out.append((text[i : i + max(size, 1)], i, i + max(size, 1)))
        i += max(size, 1)
    return out


TEXTS = ["a中国人民！人民", "", None, "中", "中中国", "国中a国", "😀中国😀人\n民中国人x", "中国人" * 50]


@pytest.mark.parametrize("most_listed", [1_000_000, 0])
def test_tokens(spark, most_listed):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("中国人民a ！") for _ in range(r.randint(1, 60))) for _ in range(60)]
    words = {"中国", "中国人", "人民", "民中国人民", "国人民中", "民", "人a", "国！国"}
    df = spark.createDataFrame([(i % 50, x) for i, x in enumerate(texts)], "k int, t string").repartition(3)  # keys are not unique
    lex = spark.createDataFrame([(w,) for w in words] + [("中国",), (None,), ("",)], "word string")
    got = sorted(map(tuple, lexicon.tokens(df, "k", "t", lex, most_listed=most_listed).collect()))
    want = sorted((i % 50, *x) for i, t in enumerate(texts) for x in chosen(t or "", words, 4, True))
    assert got == want
    assert lexicon.tokens(df, "k", "t", lex.limit(0), most_listed=most_listed).where("length(word) > 1").count() == 0


@pytest.mark.parametrize("most_listed", [1_000_000, 0])
def test_phrases(spark, most_listed):
    table = {"頭": "头", "頭髮": "头发", "發": "发", "髮": "发", "乾": "干", "乾坤": "乾坤", "一": ""}
    texts = ["頭髮發", "乾坤乾", "無", "", None, "x頭y髮z一", "😀頭😀", "頭髮" * 3000]

    def plain(t):
        out, at = "", 0
        for w, a, b in chosen(t, table, 8, False):
            out, at = out + t[at:a] + table[w], b
        return out + t[at:]

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = spark.createDataFrame(list(table.items()), "word string, to string")
    got = {x.k: x.t for x in lexicon.converted(df, "k", "t", rows, most_listed=most_listed).collect()}
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}


def test_scores_alike_in_six_decimals_are_ties(spark):
    # abce comes before abxy by 4e-8; to six decimals they are alike, so the more frequent one is first.
    words = spark.createDataFrame([("abce", 3000), ("abxy", 300_098), ("abdc", 9999)], "word string, freq long")
    none = spark.createDataFrame([], "ch string, alt string")
    fixes = spark.createDataFrame([], "wrong string, fixed string")
    wrong = spark.createDataFrame([("abcd",)], "wrong string")
    got = lexicon.candidates(wrong, words, none, fixes, least=0.2, near=0.3).orderBy("rank").collect()
    assert [(x.word, x.score, x.rank) for x in got] == [("abxy", 0.236932, 1), ("abce", 0.236932, 2), ("abdc", 0.2, 3)]


def test_tokens_and_phrases_shuffle_no_texts(spark):
    df = spark.createDataFrame([(1, "中国a人民")], "k int, t string")
    for out in (lexicon.tokens(df, "k", "t", df.selectExpr("'人民' word")), lexicon.converted(df, "k", "t", df.selectExpr("'人民' word", "'x' to"))):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() in (1, 3)


@pytest.mark.parametrize("most_listed", [1_000_000, 0])
def test_boosted_rows_are_not_shuffled_to_a_small_lexicon(spark, most_listed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(1, "a", "b", "c"), (2, "", "b", ""), (3, "x", "b", "d"), (4, None, None, None)], "k int, before string, candidate string, after string")
        words = spark.createDataFrame([("ab",), ("bd",), ("ab",), (None,)], "word string").repartition(3)
        out = lexicon.context_boost(rows, words, most_listed=most_listed)
        joins = out._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in joins) == (most_listed == 0)
        assert sorted((x.k, x.boost) for x in out.collect()) == [(1, 0.15), (2, 0.0), (3, 0.15), (4, 0.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
