"""The composed page pipeline: clean each page, find headings and tables, and put documents together in page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators.pages import joined_text
from pagewright.operators.tables import convert_tables
from pagewright.plans.registry import query, table


def clean_page(c: Column) -> Column:
    """Steps before tables are converted: think blocks, layout lines, page numbers, brackets."""
    return t.unify_brackets(t.strip_page_numbers(t.bbox_to_html(t.strip_think(c))))


def structure(pages: DataFrame, tables: bool = False) -> DataFrame:
    """``pages`` (doc_id, page, text) with cleaned text and its paragraphs, rows without page or text left out.

    Without ``tables`` all of it is native; with it, pages that hold a pipe or a border pass through the table parser.
    """
    rows = pages.where(F.col("page").isNotNull() & F.col("text").isNotNull()).withColumn("text", clean_page(F.col("text")))
    if tables:
        rows = convert_tables(rows, "text").withColumn("text", F.col("converted.text")).drop("converted")
    rows = rows.withColumn("text", t.normalize_whitespace(t.detect_headings(F.col("text"))))
    return rows.withColumn("paragraphs", t.split_paragraphs(F.col("text")))


def document_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(
        F.sum(F.size("paragraphs")).cast("long").alias("n_paragraphs"),
        F.sum(F.size(F.filter("paragraphs", lambda p: F.startswith(p, F.lit("<h1>"))))).cast("long").alias("n_headings"),
        F.sum(F.length("text")).cast("long").alias("n_chars_clean"),
    )


def _pages(spark, sf_dir):
    """Documents as one-page books, with a think block, a page number and brackets to clean."""
    x = F.concat(F.lit("<thinking>t</thinking>\n"), (F.col("doc_id") % 900 + 1).cast("string"), F.lit("\nNote 【"), F.col("lang"), F.lit("】\n"), "text", F.lit("\n第 3 页"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), x.alias("text"))


def _flagship_sql() -> str:
    from pagewright.plans.text_queries import _HEAD, _PLAIN, _q, _sql_brackets, sql_html, sql_trim

    s = sql_trim("l")
    page = "'<thinking>t</thinking>' || chr(10) || (doc_id % 900 + 1) || chr(10) || 'Note 【' || lang || '】' || chr(10) || text || chr(10) || '第 3 页'"
    numbers = f"(SELECT array_to_string([CASE WHEN (i = k[1] OR i = k[-1]) AND regexp_matches(l[i], {_q(t.PAGE_NUMBER)}) THEN '' ELSE l[i] END for i in range(1, len(l) + 1)], chr(10)) FROM (SELECT l, [i for i in range(1, len(l) + 1) if {sql_trim('l[i]')} <> ''] AS k FROM (SELECT string_split(x, chr(10)) AS l)))"
    headings = f"CASE WHEN len([l for l in string_split(x, chr(10)) if {_PLAIN} AND {_HEAD}]) = 0 THEN x ELSE array_to_string([CASE WHEN NOT {_PLAIN} THEN l WHEN {_HEAD} THEN '<h1>' || {sql_html(s)} || '</h1>' ELSE '<p>' || {sql_html(s)} || '</p>' END for l in string_split(x, chr(10))], chr(10)) END"
    spaces = sql_trim("regexp_replace(regexp_replace(x, '[ \\x{3000}\\t]+', ' ', 'g'), '[\\r\\n]+', chr(10), 'g')")
    steps = f"SELECT doc_id, {page} AS x FROM documents"
    for expr in ("regexp_replace(x, '(?is)<thinking>.*?</thinking>', '', 'g')", numbers, _sql_brackets(), headings, spaces):
        steps = f"SELECT doc_id, {expr} AS x FROM ({steps})"
    return f"SELECT doc_id, len(p)::BIGINT AS n_paragraphs, len([q for q in p if starts_with(q, '<h1>')])::BIGINT AS n_headings, length(x)::BIGINT AS n_chars_clean FROM (SELECT doc_id, x, [q for q in string_split(x, chr(10)) if q <> ''] AS p FROM ({steps}))"


query("txt_structure", _flagship_sql())(lambda spark, sf_dir: document_summary(structure(_pages(spark, sf_dir))))


@query("txt_structure_tables")
def _with_tables(spark, sf_dir):
    p = _pages(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |\nend")))
    return document_summary(structure(p, tables=True))


query("txt_structure_body", None)(
    lambda spark, sf_dir: joined_text(
        structure(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")),
        "doc_id",
        "page",
        "text",
        "\n",
    )
)
