"""Queries of the layout operators: a document's lines, with boxes made from their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions.text import CJK_MARKS, WS
from pagewright.operators import geometry as g
from pagewright.plans.registry import query, table

_L = "(SELECT doc_id, i - 1 AS seq, l[i] AS text, (i - 1) % 3 * 45 + (doc_id % 7) AS x1, (i - 1) // 2 * 30 + (i - 1) % 2 * 4 AS y1, (i - 1) % 3 * 45 + 60 + (doc_id % 7) AS x2, (i - 1) // 2 * 30 + (i - 1) % 2 * 4 + 16 + (i - 1) % 3 AS y2 FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


def _lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    s, d = F.col("seq"), F.col("doc_id") % 7
    half = F.floor(s / 2) * 30 + s % 2 * 4
    box = F.array(*[x.cast("double") for x in (s % 3 * 45 + 60 + d, half, s % 3 * 45 + d, half + 16 + s % 3)])
    return rows.withColumn("box", box)


@query("geo_box", f"SELECT doc_id, seq, x1::DOUBLE AS x1, y2::DOUBLE AS y2 FROM {_L} WHERE seq % 5 <> 4")
def _box(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("box", F.when(F.col("seq") % 5 == 4, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(5.0))).otherwise(F.col("box")))
    return rows.withColumn("b", g.normal_box(F.col("box"))).where("b is not null").select("doc_id", "seq", F.get("b", F.lit(0)).alias("x1"), F.get("b", F.lit(3)).alias("y2"))


@query("geo_median_h", f"SELECT doc_id, list_sort(list(y2 - y1))[count(*) // 2 + 1]::DOUBLE AS h FROM {_L} GROUP BY doc_id")
def _median(spark, sf_dir):
    b = F.col("b")
    return _lines(spark, sf_dir).withColumn("b", g.normal_box(F.col("box"))).groupBy("doc_id").agg(g.upper_median(F.collect_list(F.get(b, F.lit(3)) - F.get(b, F.lit(1)))).alias("h"))


_H = f"(SELECT *, list_sort(list(y2 - y1) OVER (PARTITION BY doc_id))[count(*) OVER (PARTITION BY doc_id) // 2 + 1] AS h, (y1 + y2) / 2.0 AS cy FROM {_L})"
_BAND = f"(SELECT *, sum(nb) OVER (PARTITION BY doc_id ORDER BY cy, x1, seq ROWS UNBOUNDED PRECEDING) AS band FROM (SELECT *, CASE WHEN cy - lag(cy) OVER w > 0.35 * h THEN 1 WHEN lag(cy) OVER w IS NULL THEN 1 ELSE 0 END AS nb FROM {_H} WINDOW w AS (PARTITION BY doc_id ORDER BY cy, x1, seq)))"
_ROW = f"(SELECT *, sum(nr) OVER (PARTITION BY doc_id ORDER BY band, x1, seq ROWS UNBOUNDED PRECEDING) AS row_, row_number() OVER (PARTITION BY doc_id ORDER BY band, x1, seq) AS place FROM (SELECT *, CASE WHEN lag(x2) OVER w IS NULL OR x1 - lag(x2) OVER w > 2.0 * h THEN 1 ELSE 0 END AS nr FROM {_BAND} WINDOW w AS (PARTITION BY doc_id, band ORDER BY x1, seq)))"


def _rows(*cols):
    return lambda spark, sf_dir: g.visual_rows(_lines(spark, sf_dir), ["doc_id"]).selectExpr("doc_id", "seq", *cols)


query("geo_bands", f"SELECT doc_id, seq, band::BIGINT AS band FROM {_BAND}")(_rows("band"))
query("geo_clusters", f"SELECT doc_id, seq, band::BIGINT AS cluster FROM {_BAND}")(_rows("band AS cluster"))
query("geo_columns", f"SELECT doc_id, seq, row_::BIGINT AS n FROM {_ROW}")(_rows("`row` AS n"))
query("geo_rows", f"SELECT doc_id, seq, place FROM {_ROW}")(_rows("place"))

_END, _START = g.SENTENCE_END.replace("'", "''"), g.BLOCK_START.replace("'", "''")
_HEAD = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, row_ ORDER BY place) AS k FROM {_ROW}) WHERE k = 1)"
_MERGE = f"(SELECT doc_id, row_, coalesce((y1 - lag(y2) OVER w) < 1.5 * h AND (abs(x1 - lag(x1) OVER w) <= 0.5 * h OR abs((x1 + x2) / 2.0 - (lag(x1) OVER w + lag(x2) OVER w) / 2.0) <= 0.5 * h) AND (least(x2, lag(x2) OVER w) - greatest(x1, lag(x1) OVER w)) / least(x2 - x1, lag(x2) OVER w - lag(x1) OVER w)::DOUBLE >= 0.3 AND trim(lag(text) OVER w) <> '' AND trim(text) <> '' AND NOT regexp_matches(trim(lag(text) OVER w), '{_END}') AND NOT regexp_matches(trim(text), '{_START}'), false) AS merge FROM {_HEAD} WINDOW w AS (PARTITION BY doc_id ORDER BY row_))"


@query(
    "geo_should_merge",
    f"SELECT doc_id, max(p)::BIGINT AS paragraphs FROM (SELECT doc_id, sum(CASE WHEN merge THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id "
    f"ORDER BY row_) AS p FROM {_MERGE}) GROUP BY doc_id",
)
def _should(spark, sf_dir):
    return g.paragraphs(_lines(spark, sf_dir), ["doc_id"]).groupBy("doc_id").agg(F.max("paragraph").alias("paragraphs"))


_RTRIM, _LTRIM = f"regexp_replace(a, '[{WS}]+$', '')", f"regexp_replace(b, '^[{WS}]+', '')"
_JOINED = f"""list_reduce([''] || list(coalesce(text, '') ORDER BY place), lambda a, b: CASE WHEN {_RTRIM} = '' THEN {_LTRIM} WHEN {_LTRIM} = '' THEN {_RTRIM}
 WHEN NOT (regexp_matches(right({_RTRIM}, 1), '{CJK_MARKS}') AND regexp_matches(left({_LTRIM}, 1), '{CJK_MARKS}')) AND (regexp_matches(right({_RTRIM}, 1), '[A-Za-z0-9]') OR regexp_matches(left({_LTRIM}, 1), '[A-Za-z0-9]'))
 THEN {_RTRIM} || ' ' || {_LTRIM} ELSE {_RTRIM} || {_LTRIM} END)"""
_PARAGRAPHS = f"""SELECT r.doc_id, paragraph::BIGINT AS paragraph, {_JOINED} AS text FROM {_ROW} r
 JOIN (SELECT doc_id, row_, sum(CASE WHEN merge THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY row_) AS paragraph FROM {_MERGE}) m ON r.doc_id = m.doc_id AND r.row_ = m.row_ GROUP BY r.doc_id, paragraph"""
query("geo_paragraphs", _PARAGRAPHS)(lambda spark, sf_dir: g.paragraphs(_lines(spark, sf_dir), ["doc_id"]))


@query("geo_page_text", f"SELECT doc_id, string_agg(text, chr(10) ORDER BY paragraph) AS text FROM ({_PARAGRAPHS}) GROUP BY doc_id")
def _page_text(spark, sf_dir):
    p = g.paragraphs(_lines(spark, sf_dir), ["doc_id"])
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n").alias("text"))
