"""Queries of the table operators: pipe rows made from a document's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import tables as tb
from pagewright.plans.registry import batch_udf, query, table

_ROW = "'| ' || source || ' | a\\|b | ' || lang || ' || ' || doc_id || ' |'"


def _row():
    return F.concat(F.lit("| "), "source", F.lit(" | a\\|b | "), "lang", F.lit(" || "), F.col("doc_id").cast("string"), F.lit(" |"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


query("tbl_split_cells", "SELECT doc_id, source || '/a|b/' || lang || '//' || doc_id AS cells FROM documents")(
    lambda s, d: (
        _docs(s, d).select("doc_id", F.array_join(tb.split_cells(_row()), "/").alias("cells"))
    )
)
def _sep():
    return F.element_at(F.array(*[F.lit(x) for x in ("|---|:-:|", "| -- | x |", "---", "| :— |--:|")]), (F.col("doc_id") % 4 + 1).cast("int"))
query("tbl_is_separator", "SELECT doc_id, doc_id % 4 IN (0, 3) AS yes FROM documents")(
    lambda s, d: (
        _docs(s, d).select("doc_id", tb.is_separator(_sep()).alias("yes"))
    )
)
query(
    "tbl_align",
    "SELECT doc_id, ['page-align-left', 'page-align-center', 'page-align-right', NULL][doc_id % 4 + 1] AS cls FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            tb.align_class(F.element_at(F.array(*[F.lit(x) for x in (":--", ":-:", "--:", "---")]), (F.col("doc_id") % 4 + 1).cast("int"))).alias("cls"),
        )
    )
)
query(
    "tbl_fit",
    "SELECT doc_id, array_to_string(CASE WHEN doc_id % 5 + 1 >= 4 THEN [source, 'a', lang, 'b'] || CASE WHEN doc_id % 5 + 1 = 5 THEN "
    "[''] ELSE [] END ELSE [source, 'a', lang, 'b'][1:doc_id % 5] || [array_to_string([source, 'a', lang, 'b'][doc_id % 5 + 1:], '')] "
    "END, '/') AS cells FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            F.array_join(tb.fit(F.array("source", F.lit("a"), "lang", F.lit("b")), (F.col("doc_id") % 5 + 1).cast("int")), "/").alias("cells"),
        )
    )
)
query(
    "tbl_render",
    "SELECT doc_id, '<table><thead><tr><th class=\"c\">' || source || '</th><th>&lt;b&gt;</th></tr></thead><tbody><tr><td "
    "class=\"c\">' || lang || '</td><td>' || doc_id || '</td></tr></tbody></table>' AS html FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            tb.render_table(F.array("source", F.lit("<b>")), F.array(F.array("lang", F.col("doc_id").cast("string"))), F.array(F.lit("c"), F.lit(None))).alias("html"),
        )
    )
)
query("agg_max_width", "SELECT doc_id, greatest(1, doc_id % 6)::INT AS width FROM documents")(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            F.array_max(F.transform(F.array(F.array(F.lit("a")), F.array_repeat(F.lit("b"), (F.col("doc_id") % 6).cast("int"))), lambda r: F.size(r))).alias("width"),
        )
    )
)


def _page(kind: str):
    body = {
        "pipe": F.concat(F.lit("Title | A | B\n|---|:-:|\n\n"), _row(), F.lit("\n| 1 | 2 |\nend\n"), "text"),
        "box": F.concat(F.lit("+---+---+\n| a | b |\n+---+---+\n| "), "source", F.lit(" | "), "lang", F.lit(" |\n+---+---+\n"), "text"),
        "space": F.concat(F.lit("a  b\n"), "source", F.lit("\tx\n\n"), "text"),
        "glued": F.concat(F.lit("| a | b || "), "source", F.lit(" | "), "lang", F.lit(" || 3 | 4 |\n"), "text"),
    }
    return body[kind]


def _converted(kind: str):
    def run(s, d):
        df = _docs(s, d).select("doc_id", _page(kind).alias("page"))
        return tb.convert_tables(df, "page", spaced=kind == "space").select("doc_id", F.size("converted.chunks").alias("tables"), F.length("converted.text").alias("chars"), F.get("converted.chunks", F.lit(0))["end"].alias("end_line"))

    return run


for _k in ("pipe", "box", "space", "glued"):
    query(f"tbl_{_k}")(_converted(_k))
query("tbl_convert")(
    lambda s, d: (
        tb.convert_tables(
            _docs(s, d).select("doc_id", F.concat(*[x for k in ("pipe", "box", "glued") for x in (_page(k), F.lit("\n"))]).alias("page")),
            "page",
        )
        .select("doc_id", F.explode("converted.chunks").alias("c"))
        .select("doc_id", "c.start", "c.end", "c.html")
    )
)


@batch_udf("string")
def _pipes(v):
    import pyarrow as pa

    return pa.array([tb.table_to_pipes(x) for x in v.to_pylist()], pa.string())


query(
    "tbl_to_pipe",
    "SELECT doc_id, '| ' || source || ' | b |' || chr(10) || '| :-: | --- |' || chr(10) || '| x\\|y z | ' || lang || ' |' AS pipes "
    "FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            _pipes(F.concat(F.lit('<p>t</p><table><tr><th class="page-align-center">'), "source", F.lit("</th><th>b</th></tr><tr><td>x|y<br/>z</td><td>"), "lang", F.lit("</td></tr></table>"))).alias("pipes"),
        )
    )
)
