"""Queries of chapters, contents and search, over web pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import chapters as c
from pagewright.plans.registry import batch_udf, query, table


def _books(spark, sf_dir):
    h = F.concat(F.lit("<p>pre</p><h1>One &amp; "), F.col("lang"), F.lit("</h1><table><tr><td><h1>in</h1></td></tr></table><p>a</p><H1 class='x'>Two <b>"), F.col("source"), F.lit("</b></H1>"), F.lit("<p>"), "text", F.lit("</p><h1></h1><h2>Sub</h2>end<br><img src='a'>"))
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("html"), F.lit("Preface").alias("fallback"), "text", "source", "lang")



@query(
    "art_split",
    "SELECT doc_id, unnest([1, 2, 3, 4]) AS article, unnest(['Preface', 'One & ' || lang, 'Two ' || source, 'Preface']) AS title, "
    "unnest([10, length('<table><tr><td><h1>in</h1></td></tr></table><p>a</p>'), length(text) + 7, length('<h2>Sub</h2>end<br><img "
    "src=''a''>')]) AS chars FROM documents",
)
def _split(spark, sf_dir):
    return c.split_articles(_books(spark, sf_dir), "doc_id", "html", "fallback").select("doc_id", "article", "title", F.length("text").alias("chars"))


query("src_epub_book", "SELECT doc_id, 4::BIGINT AS articles FROM documents")(
    lambda s, d: (
        c.split_articles(_books(s, d), "doc_id", "html", "fallback", True).groupBy("doc_id")
        .agg(F.count("*").alias("articles"))
    )
)
query(
    "html_toc",
    "SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS seq, unnest([1, 1, 1, 1, 2]) AS level, unnest(['One & ' || lang, 'in', 'Two ' || "
    "source, '', 'Sub']) AS title FROM documents",
)(
    lambda s, d: c.toc(_books(s, d), "doc_id", "html")
)
query(
    "html_text",
    "SELECT page_id, length(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, "
    "'(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', "
    "'\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')) AS chars FROM pages",
)(
    lambda s, d: (
        table(s, d, "pages").select("page_id", F.length(c.html_text(F.col("html"))).alias("chars"))
    )
)
query(
    "html_fix",
    "SELECT page_id, regexp_replace(html || '<br><img src=\"a>b\"><hr />', "
    "'(?i)<(br|hr|img|input|meta|link|col|wbr)\\b((?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*?)\\s*/?>', '<\\1\\2/>', 'g') AS html FROM pages",
)(
    lambda s, d: (
        table(s, d, "pages")
        .select("page_id", c.self_closed(F.concat("html", F.lit('<br><img src="a>b"><hr />'))).alias("html"))
    )
)
query("flt_img_page", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")(
    lambda s, d: (
        _books(s, d)
        .withColumn("html", F.when(F.col("doc_id") % 3 == 0, "<p><img src='x1'/> — </p>").otherwise(F.col("html")))
        .where(c.image_page(F.col("html")))
        .select("doc_id")
    )
)
query("html_cover", "SELECT doc_id, doc_id % 3 = 0 AS cover FROM documents")(
    lambda s, d: (
        _books(s, d)
        .select("doc_id", c.image_page(F.when(F.col("doc_id") % 3 == 0, "<img src='x'>").otherwise(F.col("html"))).alias("cover"))
    )
)

query(
    "srch_find",
    "SELECT doc_id, i AS match, length(array_to_string(p[1:i], '')) + coalesce(list_sum([length(h) for h in hs[1:i - 1]]), 0)::BIGINT "
    "AS start, hs[i] AS hit FROM (SELECT doc_id, regexp_split_to_array(text, 'th[aeiou]|en') AS p, regexp_extract_all(text, "
    "'th[aeiou]|en') AS hs, unnest(range(1, len(regexp_extract_all(text, 'th[aeiou]|en')) + 1)) AS i FROM documents)",
)(
    lambda s, d: (
        c.find(table(s, d, "documents"), "doc_id", "text", "th[aeiou]|en", None)
        .select("doc_id", "match", "start", "hit")
    )
)
query(
    "srch_context",
    "SELECT doc_id, i AS match, start, substr(text, greatest(1, start + 1 - 40), least(40, start)) AS before, hit, substr(text, start + length(hit) + 1, 40) AS after FROM ("
    "SELECT doc_id, text, i, hs[i] AS hit, length(array_to_string(p[1:i], '')) + coalesce(list_sum([length(h) for h in hs[1:i - 1]]), 0)::BIGINT AS start FROM ("
    "SELECT doc_id, text, regexp_split_to_array(text, 'e\\.') AS p, regexp_extract_all(text, 'e\\.') AS hs, unnest(range(1, least(200, len(regexp_extract_all(text, 'e\\.'))) + 1)) AS i FROM documents))",
)(lambda s, d: c.find(table(s, d, "documents"), "doc_id", "text", c.literal("e."), 40, 200))
query(
    "limit_search",
    "SELECT doc_id, least(10, len(regexp_extract_all(text, 'en')))::BIGINT AS shown, len(regexp_extract_all(text, 'en'))::BIGINT AS "
    "total FROM documents WHERE contains(text, 'en')",
)(
    lambda s, d: (
        c.find(table(s, d, "documents"), "doc_id", "text", "en", None, 10).groupBy("doc_id")
        .agg(F.count("*").alias("shown"))
        .join(table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit("en")).cast("long").alias("total")), "doc_id")
    )
)
query("srch_replace_all", "SELECT doc_id, '<p class=\"en\">' || replace(text, 'en', '$1\\') || '</p>' AS html FROM documents")(
    lambda s, d: (
        table(s, d, "documents")
        .select("doc_id", c.replace_in_text(F.concat(F.lit('<p class="en">'), "text", F.lit("</p>")), "en", "$1\\").alias("html"))
    )
)
query(
    "srch_replace_pattern",
    "SELECT doc_id, '<p class=\"en\">' || regexp_replace(text, 'e[nr]', '$1', 'g') || '</p>' AS html FROM documents",
)(
    lambda s, d: (
        table(s, d, "documents")
        .select("doc_id", c.replace_in_text(F.concat(F.lit('<p class="en">'), "text", F.lit("</p>")), "e[nr]", "$1", True).alias("html"))
    )
)
query("srch_highlight", "SELECT doc_id, '<p>' || replace(text, 'e.', '<mark>e.</mark>') || '</p>' AS html FROM documents")(
    lambda s, d: (
        table(s, d, "documents")
        .select("doc_id", c.highlight(F.concat(F.lit("<p>"), "text", F.lit("</p>")), "e.").alias("html"))
    )
)


@batch_udf("array<string>")
def _parts(v):
    import pyarrow as pa

    return pa.array([c.split_limit(x or "", 2000) for x in v.to_pylist()], pa.list_(pa.string()))


query("html_split_limit")(lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(_parts("html")).alias("part", "html")))
query("html_content_pages")(
    lambda s, d: (
        c.split_articles(_books(s, d), "doc_id", "html", "fallback", True)
        .select("doc_id", "article", "title", F.posexplode(_parts("text")).alias("part", "html"))
        .select(
            "doc_id",
            "article",
            F.when(F.col("part") > 0, F.concat("title", F.lit("（第"), (F.col("part") + 1).cast("string"), F.lit("部分）"))).otherwise(F.col("title")).alias("title"),
            "html",
        )
    )
)
