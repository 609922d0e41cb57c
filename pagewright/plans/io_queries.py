"""Queries of sources, sinks, progress and inference, with file bytes made from rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.plans.registry import query, table
from pagewright.sources import epub, files
from pagewright.streaming import progress

PNG = "89504E470D0A1A0A0000000D49484452"


def _docs(s, d):
    return table(s, d, "documents")


def _content():
    return F.encode(F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("%PDF-1.7 ")).otherwise(F.lit("x")), "text"), "UTF-8")


query("src_pdf_sniff", "SELECT doc_id, doc_id % 2 = 0 AS pdf FROM documents")(
    lambda s, d: (
        _docs(s, d).select("doc_id", files.is_pdf(_content()).alias("pdf"))
    )
)
query("src_pdf_sha256", "SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN '%PDF-1.7 ' ELSE 'x' END || text) AS sha FROM documents")(
    lambda s, d: (
        _docs(s, d).select("doc_id", files.sha256(_content()).alias("sha"))
    )
)
_HEADS = [PNG, "FFD8FFE0", "474946383961", "524946460000000057454250", "424D00", "00"]
query(
    "src_image_mime",
    "SELECT doc_id, ['image/png', 'image/jpeg', 'image/gif', 'image/webp', 'image/bmp', 'image/jpeg'][doc_id % 6 + 1] AS mime FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            files.image_mime(F.unhex(F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % 6 + 1).cast("int")))).alias("mime"),
        )
    )
)
def _png():
    return F.unhex(F.concat(F.lit(PNG), F.lpad(F.hex(F.col("doc_id") + 1), 8, "0"), F.lpad(F.hex(F.col("n_chars")), 8, "0")))
query("src_image_dims", "SELECT doc_id, (doc_id + 1)::INT AS width, n_chars::INT AS height FROM documents")(
    lambda s, d: (
        _docs(s, d).select("doc_id", files.png_size(_png()).alias("p"))
        .select("doc_id", "p.width", "p.height")
    )
)
query("src_image_b64", "SELECT doc_id, base64(encode(text)) AS data FROM documents")(
    lambda s, d: (
        _docs(s, d)
        .select("doc_id", F.regexp_replace(files.as_base64(F.encode("text", "UTF-8")), "[\r\n]", "").alias("data"))
    )
)


@query("src_split_cache", "SELECT doc_id, doc_id % 50 AS split FROM documents WHERE doc_id % 50 < 30 AND doc_id % 50 % 4 <> 1")
def _cache(s, d):
    k = (F.col("doc_id") % 50).alias("split")
    wanted = _docs(s, d).select("doc_id", k.cast("string").alias("sha"), F.lit(200).alias("dpi"), F.lit("png").alias("fmt"), F.lit("").alias("prep"))
    cached = s.range(30).select(F.col("id").alias("split"), F.col("id").cast("string").alias("sha"), F.lit(200).alias("dpi"), F.lit("png").alias("fmt"), F.lit("").alias("prep"), F.lit(3).alias("pages"))
    there = s.range(30).select(F.col("id").alias("split"), F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 4 == 1, 2).otherwise(3))).alias("page"))
    return files.reusable_splits(wanted, cached, there).select("doc_id", "split")




_INFER = "SELECT doc_id AS img, CASE WHEN doc_id % 2 = 0 THEN (strlen(text) + 9)::VARCHAR END AS result, CASE WHEN doc_id % 2 = 1 THEN 'ValueError: not a page' END AS error FROM documents"
for _n in ("src_ocr_llama", "src_ocr_vllm", "src_ocr_paddle"):
    query(_n, _INFER)(lambda s, d: files.infer_pages(_docs(s, d).select(F.col("doc_id").alias("img"), F.col("doc_id").alias("page"), _content().alias("content")), files.fake_backend).drop("page"))
query("st_as_completed", "SELECT count(*) AS total, count(*) FILTER (doc_id % 2 = 1) AS failed FROM documents")(
    lambda s, d: (
        files.infer_pages(
            _docs(s, d).select(F.col("doc_id").alias("img"), F.col("doc_id").alias("page"), _content().alias("content")),
            files.fake_backend,
        )
        .agg(F.count("*").alias("total"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    )
)


def _books(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").cast("int").alias("n"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title"), F.concat(F.lit("<p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>")).alias("text"), F.concat(F.lit("Book "), F.col("conv_id").cast("string")).alias("name"), F.lit("A & B").alias("author"), F.lit("en").alias("language"))
    return epub.pack_books(c, "book").select(F.col("book").cast("string").alias("path"), "content")


query("sink_epub", "SELECT conv_id::VARCHAR AS path, true AS packed FROM conversations GROUP BY conv_id")(
    lambda s, d: (
        _books(s, d)
        .select("path", (F.hex(F.substring("content", 31, 8)) == F.hex(F.encode(F.lit("mimetype"), "UTF-8"))).alias("packed"))
    )
)
query(
    "src_epub_spine",
    "SELECT conv_id::VARCHAR AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n FROM conversations",
)(
    lambda s, d: (
        epub.books(_books(s, d)).select("path", F.explode("spine").alias("x")).select("path", "x.n")
    )
)
_PIC = "'<img src=\"data:image/png;base64,' || base64(encode('png' || conv_id)) || '\" alt=\"a &amp; b\"/>'"


@query(
    "src_epub_body",
    f"SELECT conv_id::VARCHAR AS path, turn::INT AS page, '<p>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p>&nbsp;' || {_PIC} || '<br/>&#169;' AS body FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)",
)
def _bodies(s, d):
    """Texts of books with an image, one that is not there, a script, a comment and entities."""
    more = F.lit('</p>&nbsp;<img class="" src="../Images/cover.png?x#y" srcset="z" alt="a &amp; b"><img src="no.png"><script>var a = "<p>";</script><!-- c --><link rel="x"><br>&#169;')
    text = F.concat(F.lit("<p>"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.replace(more, F.lit(' class=""'), F.lit("")))
    cover = F.encode(F.concat(F.lit("png"), F.col("conv_id").cast("string")), "UTF-8")
    rows = table(s, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("n"), F.lit("t").alias("title"), text.alias("text"), F.lit("b").alias("name"), F.lit("a").alias("author"), F.lit("en").alias("language"), cover.alias("cover"))
    books = epub.pack_books(rows, "conv_id").select(F.col("conv_id").cast("string").alias("path"), "content")
    return epub.books(books).select("path", F.explode("spine").alias("x")).select("path", F.col("x.n").alias("page"), "x.body")


query(
    "src_epub_meta",
    "SELECT DISTINCT conv_id::VARCHAR AS path, 'Book ' || conv_id AS title, 'A & B' AS author, 'en' AS language FROM conversations",
)(
    lambda s, d: (
        epub.books(_books(s, d)).select("path", "meta.title", "meta.author", "meta.language")
    )
)
query("sink_epub_merge", "SELECT count(*) AS pages FROM conversations")(
    lambda s, d: (
        epub.merge_pages(
            epub.books(_books(s, d)).select("path", F.explode("spine").alias("x")).select("path", "x.n", "x.body"),
            ["path", "n"],
        )
        .agg(F.max("page").cast("long").alias("pages"))
    )
)


def _events(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 20).cast("string").alias("job"), F.col("event_id").alias("seq"), "event_id")
    k = F.col("event_id")
    return e.select("job", "seq", F.element_at(F.array(*[F.lit(x) for x in ("split", "ocr", "structure", "manual")]), (F.floor(k / 300) % 4 + 1).cast("int")).alias("stage"), (k % 300).alias("done"), F.lit(300).cast("long").alias("total"), (k * 1.5).alias("now"))


query("st_eta")(lambda s, d: progress.estimates(_events(s, d)))
query("st_progress_marker", "SELECT 'ocr' AS stage, doc_id AS done, 9 AS total FROM documents WHERE doc_id % 2 = 0")(
    lambda s, d: progress.markers(
        _docs(s, d).select(F.concat(F.when(F.col("doc_id") % 2 == 0, progress.MARKER).otherwise("log "), F.lit('{"stage":"ocr","done":'), F.col("doc_id").cast("string"), F.lit(',"total":9}')).alias("value")),
    )
)
