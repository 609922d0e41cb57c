"""Cases that every stage and operator must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

import os

import corpus_pipeline
import pytest

from pagewright.llm import anisotropic, mixing, ngram_join, packing, quality_rules, reply_trees, secret_scan
from pagewright.llm.registry import QUERIES

NAMES = (
    "t k1 k2 k3 c1 c2 c3 rep node key key2 copies n size a b masked kept clean_text n_words left_words secret_spans "
    "component class_id first in0 in1 __t __text __1 chunk nth taken piece length open"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    long = "word " * 210_000  # over 1 MB
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    out = [(i, text(i), "en", "a" if i % 3 else "b", 5) for i in range(30)]
    out += [(3, text(3), "en", "a", 5), (3, text(3), "en", "a", 5), (40, text(4), "en", "a", 5), (3, text(50), None, None, None)]
    out += [(None, text(60), None, None, None), (None, text(60), None, None, None), (41, None, "en", "a", None), (42, "", "en", "a", 0), (None, None, None, None, None)]
    return out + [(43, long + text(61), "en", "b", 1), (44, "token=abcdefghij " + text(62), "en", "b", 1), (45, "\n\n \t\x0b", "en", "b", 1)]


def table(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return df.selectExpr("*", *[f"concat('v', doc_id, '{n}') as `{n}`" for n in NAMES])


@pytest.mark.parametrize("k", range(4))
def test_stages(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    df = table(spark)
    out = stage(spark, df, "")
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    found = out.collect()
    assert found and {x.doc_id for x in found} <= {x[0] for x in rows()}
    for x in found:
        assert all(x[n] == (None if x.doc_id is None else f"v{x.doc_id}{n}") for n in NAMES), (name, x)
    empty = stage(spark, df.limit(0), "")
    assert empty.columns == df.columns and empty.count() == 0


def test_last_stage(spark):
    df = table(spark)
    found = corpus_pipeline.STAGES[4][1](spark, df, "").collect()
    assert sorted(repr(x.doc_id) for x in found if x.piece == 0) == sorted(repr(x[0]) for x in rows())
    assert corpus_pipeline.STAGES[4][1](spark, df.limit(0), "").count() == 0


def test_operators_beside_clashing_columns(spark):
    df = table(spark)
    n = len(rows())
    assert ngram_join.ngram_jaccard_join(df).count() == n
    judged = quality_rules.judge(df)
    assert judged.count() == n and set(quality_rules.VERDICT) <= set(judged.columns) and len(set(judged.columns)) == len(judged.columns)
    scanned = secret_scan.scan(df)
    assert scanned.count() == n and scanned.columns.count("secret_spans") == 1
    talks = df.selectExpr("doc_id as conv_id", "n_chars as turn", "lang as role", "text", *[f"`{n}`" for n in NAMES])
    assert reply_trees.read_back(reply_trees.format_trees(reply_trees.conversation_messages(talks))).count() == len({x[0] for x in rows()})


@pytest.mark.parametrize("name", ["op2_token_blocks", "op6_suffix_tree", "op8_random_indexing", "op11_private_data", "op12_filter_audit", "op13_wand_search"])
def test_queries_of_the_same_rows(spark, tmp_path, name):
    """Long texts, repeated rows, nulls and clashing names through the queries, and through them with no rows."""
    marks = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "w3x1 w3x2"), (1, "w3x1 w3x2"), (2, None), (None, "word")], "item_id long, text string")
    more = lambda df: df.selectExpr("*", *[f"'v' as `{n}`" for n in NAMES])
    for case, docs in (("all", table(spark)), ("none", table(spark).limit(0))):
        docs.write.parquet(f"{tmp_path}/{case}/documents.parquet")
        more(marks).write.parquet(f"{tmp_path}/{case}/labels.parquet")
        more(items).write.parquet(f"{tmp_path}/{case}/benchmark.parquet")
        found = QUERIES[name](spark, f"{tmp_path}/{case}").collect()
        if case == "none":
            assert found == []
        elif name == "op12_filter_audit":
            assert len(found) == 600 * len({x[3] for x in rows()})
        elif name == "op13_wand_search":
            assert {x.item_id for x in found} == {1, None} and [x.doc_id for x in found if x.item_id == 1][:3] == [3, 3, 3]
        else:
            assert sorted(repr(x.doc_id) for x in found) == sorted(repr(x[0]) for x in rows())


def test_all_null_texts(spark):
    df = spark.createDataFrame([(i, None, None, None, None) for i in range(5)] + [(None,) * 5] * 2, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns
    assert ngram_join.near_duplicates_stage(spark, df, "").count() == 1 and quality_rules.quality_stage(spark, df, "").count() == 0
    assert mixing.mixing_stage(spark, df, "").count() == 0
    assert packing.packing_stage(spark, df, "").agg({"length": "sum"}).first()[0] == 7
    assert anisotropic.search(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    os.makedirs(f"{tmp_path}/x")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/x/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/x").count() == 0
