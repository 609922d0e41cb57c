"""Queries of word lists and corrections, with words taken from documents and customers' names."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import lexicon as x
from pagewright.plans.registry import batch_udf, query, table

_WORDS = "SELECT w AS word, count(*) AS freq FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) BETWEEN 2 AND 6 GROUP BY w HAVING count(*) >= 20"


def _words(s, d):
    w = table(s, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word").between(2, 6))
    return w.groupBy("word").agg(F.count("*").alias("freq")).where("freq >= 20")


query(
    "src_dict_words",
    "SELECT 'w' || (doc_id % 40) AS word, max_by(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE n_chars END, doc_id)::BIGINT AS freq FROM "
    "documents GROUP BY 1",
)(
    lambda s, d: x.words_from_lines(
        table(s, d, "documents").select(F.concat(F.lit(" w"), (F.col("doc_id") % 40).cast("string"), F.lit(" "), F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("n_chars").cast("string")), F.lit(" n")).alias("value"), F.col("doc_id").alias("n")),
    )
)
query(
    "src_dict_pairs",
    "SELECT DISTINCT a AS ch, b AS alt FROM (SELECT unnest(g) AS a, g FROM (SELECT ['k' || (doc_id % 7), 'k' || (doc_id % 5), 'z'] AS "
    "g FROM documents WHERE doc_id % 4 > 0)) t, unnest(g) AS u(b) WHERE a <> b",
)(
    lambda s, d: x.pairs_from_lines(
        table(s, d, "documents").select(F.concat(F.when(F.col("doc_id") % 4 == 0, "# ").otherwise(""), F.lit("k"), (F.col("doc_id") % 7).cast("string"), F.lit(" k"), (F.col("doc_id") % 5).cast("string"), F.lit("  z")).alias("value")),
    )
)
query("src_dict_user", "SELECT doc_id, unnest(['a', 'b']) AS wrong, unnest([lang, source]) AS fixed FROM documents")(
    lambda s, d: (
        table(s, d, "documents")
        .select(
            "doc_id",
            F.from_json(F.concat(F.lit('{"fixes":{"a":"'), "lang", F.lit('","b":"'), "source", F.lit('"},"ignored":[]}')), "fixes map<string,string>, ignored array<string>").alias("j"),
        )
        .select("doc_id", F.explode("j.fixes").alias("wrong", "fixed"))
    )
)
query("flt_is_word", f"SELECT word FROM ({_WORDS}) WHERE word NOT IN ('the', 'la') UNION SELECT 'zzz'")(
    lambda s, d: x.known_words(
        _words(s, d).select("word").union(s.createDataFrame([("zzz",), ("qqq",)], "word string")),
        _words(s, d),
        s.createDataFrame([("q", "zzz")], "wrong string, fixed string"),
        s.createDataFrame([("the",), ("la",)], "word string"),
    )
)
query("agg_dict_stats", f"SELECT count(*) AS words, sum(freq)::BIGINT AS total FROM ({_WORDS})")(
    lambda s, d: (
        _words(s, d).agg(F.count("*").alias("words"), F.sum("freq").cast("long").alias("total"))
    )
)


def _wrong(s, d):
    return _words(s, d).select(F.concat("word", F.lit("e")).alias("wrong"))


_CAND = f"SELECT a.w AS wrong, b.word, round(least(1.2, 0.2 * (1 - levenshtein(a.w, b.word) / greatest(length(a.w), length(b.word))::DOUBLE) + least(0.15, log10(b.freq + 1) / 40)), 6) AS score, b.freq FROM (SELECT DISTINCT word || 'e' AS w FROM ({_WORDS})) a JOIN ({_WORDS}) b ON left(a.w, 1) = left(b.word, 1) AND abs(length(a.w) - length(b.word)) <= 1 AND a.w <> b.word AND 1 - levenshtein(a.w, b.word) / greatest(length(a.w), length(b.word))::DOUBLE >= 0.5"


def _candidates(s, d):
    none = s.createDataFrame([], "ch string, alt string")
    return x.candidates(_wrong(s, d), _words(s, d), none, s.createDataFrame([], "wrong string, fixed string"), least=0.2, near=0.5)


query(
    "topk_candidates",
    f"SELECT wrong, word, score FROM (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY score DESC, freq DESC, word) AS n FROM "
    f"({_CAND} WHERE round(least(1.2, 0.2 * (1 - levenshtein(a.w, b.word) / greatest(length(a.w), length(b.word))::DOUBLE) + "
    f"least(0.15, log10(b.freq + 1) / 40)), 9) >= 0.2)) WHERE n <= 5",
)(
    lambda s, d: (
        _candidates(s, d).select("wrong", "word", F.round("score", 6).alias("score"))
    )
)
query("join_candidates", f"SELECT wrong, word FROM ({_CAND})")(
    lambda s, d: (
        x.candidates(
            _wrong(s, d),
            _words(s, d),
            s.createDataFrame([], "ch string, alt string"),
            s.createDataFrame([], "wrong string, fixed string"),
            least=0.0,
            near=0.5,
            top=10**6,
        )
        .select("wrong", "word")
    )
)
query(
    "pr_candidates",
    f"SELECT wrong, word, score, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY score DESC, freq DESC, "
    f"word) AS n FROM ({_CAND} WHERE round(least(1.2, 0.2 * (1 - levenshtein(a.w, b.word) / greatest(length(a.w), "
    f"length(b.word))::DOUBLE) + least(0.15, log10(b.freq + 1) / 40)), 9) >= 0.2)) WHERE n <= 5",
)(
    lambda s, d: (
        _candidates(s, d).withColumn("score", F.round("score", 6))
    )
)


@batch_udf("array<struct<start:int,end:int,wrong:string,candidates:array<string>>>")
def _diff(a, b):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("wrong", pa.string()), ("candidates", pa.list_(pa.string()))]))
    return pa.array([x.differences(p or "", q or "") for p, q in zip(a.to_pylist(), b.to_pylist())], kind)


query("pr_diff", "SELECT c_custkey, 0 AS start, 1 AS end_, 'C' AS wrong, 'K' AS fixed FROM customer")(
    lambda s, d: (
        table(s, d, "customer")
        .select("c_custkey", F.explode(_diff("c_name", F.concat(F.lit("K"), F.substring("c_name", 2, 99)))).alias("t"))
        .select("c_custkey", "t.start", F.col("t.end").alias("end_"), "t.wrong", F.get("t.candidates", F.lit(0)).alias("fixed"))
    )
)
