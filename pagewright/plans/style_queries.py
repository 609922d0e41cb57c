"""Queries of style normalisers, books' metadata and the remaining page operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import chapters, fragments, images, lexicon, rules, styles
from pagewright.plans.io_queries import _books
from pagewright.plans.registry import batch_udf, query, table
from pagewright.plans.text_queries import sql_html
from pagewright.sources import epub, files, pdf, png


def _docs(s, d):
    return table(s, d, "documents")


def _n(m):
    return (F.col("doc_id") % m).cast("string")


query(
    "html_img_width",
    "SELECT doc_id, CASE WHEN doc_id % 130 BETWEEN 1 AND 100 THEN 'width:' || (doc_id % 130) || '%' ELSE '' END AS style FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select("doc_id", styles.image_width(F.concat(F.lit("width:7px; color:red;WIDTH : "), _n(130), F.lit("%"))).alias("style"))
    )
)
@query(
    "html_cell_style",
    """SELECT doc_id, CASE WHEN doc_id % 60 BETWEEN 1 AND 49 THEN 'width:' || (doc_id % 60) || '.5em;' ELSE '' END || 'height:20px' || CASE WHEN doc_id % 2 = 0 THEN ';vertical-align:top' ELSE '' END AS style FROM documents""",
)
def _cell_style(s, d):
    """Widths from 0.50em to 59.50em, of which those above 50em are out of bounds."""
    width = F.when(F.col("doc_id") % 60 == 0, "9").otherwise(F.concat(_n(60), F.lit(".50em")))
    align = F.when(F.col("doc_id") % 2 == 0, ";vertical-align: Top").otherwise(";vertical-align:x")
    return _docs(s, d).select("doc_id", styles.cell_style(F.concat(F.lit("height:20.0PX;position:fixed;width:"), width, align)).alias("style"))


query("html_table_style", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'table-layout:fixed' ELSE '' END AS style FROM documents")(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            styles.table_style(F.when(F.col("doc_id") % 2 == 0, "color:red; Table-Layout: FIXED").otherwise("table-layout:fixed;table-layout:auto")).alias("style"),
        )
    )
)
query("html_ruby", "SELECT doc_id, '<ruby>' || lang || '<rt>x</rt></ruby>' AS html FROM documents")(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            styles.ruby(F.concat(F.lit('<ruby class="a">'), "lang", F.lit("<rp>(</rp><rt id='q'>x</rt><rp>)</rp></ruby>"))).alias("html"),
        )
    )
)
query(
    "html_note_labels",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<p id=\"a\" class=\"page-note-label\">' || lang || "
    "'<strong>注释：</strong>x</p><p>y</p>' ELSE '<div class=\"page-note-label\"> 注释:</div><p>' || lang || '</p>' END AS html FROM "
    "documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            styles.note_labels(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<p id="a">'), "lang", F.lit("<b> 注释 </b>：x</p><p>y</p>"))).otherwise(F.concat(F.lit("<div> 注释:</div><p>"), "lang", F.lit("</p>")))).alias("html"),
        )
    )
)
query(
    "html_indent_style",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'margin-left:' || (doc_id % 9 + 2) || 'em;text-indent:-2em' ELSE 'margin-left:' || "
    "(doc_id % 9) || 'em;text-indent:2em;margin-top:1.5em;line-height:1.25' END AS style FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            styles.indent_style(F.concat(F.lit(' data-pl="'), _n(9), F.when(F.col("doc_id") % 2 == 0, F.lit('" data-ind="hang"')).otherwise('" data-ind="first" data-spb="1" data-lh="1.25"'))).alias("style"),
        )
    )
)
_IMG = "'<p class=\"page-img-' || ['full', 'left', 'x'][doc_id % 3 + 1] || '\"' || ['{full}', ' style=\"text-align:left\"', ''][doc_id % 3 + 1] || '><img class=\"page-img-w50\" src=\"' || doc_id || '\"{img} width=\"' || ['100%', '50%', '50%'][doc_id % 3 + 1] || '\"/></p>'"
_FULL = ' style=\\"page-break-before:auto;page-break-after:always;text-align:center\\"'.replace("\\", "")
_WIDTH = "' || [' style=\"display:inline-block;max-width:100%;width:100%;vertical-align:middle\"', ' style=\"display:block;max-width:100%;width:50%;height:auto\"', ' style=\"display:block;max-width:100%;width:50%;height:auto\"'][doc_id % 3 + 1] || '"


@query("html_img_inline", f"SELECT doc_id, {_IMG.replace('{full}', _FULL).replace('{img}', _WIDTH)} || coalesce(text, '') AS html FROM documents")
def _img_inline(s, d):
    """An image in a paragraph of each kind, before the text of each document."""
    kind = F.element_at(F.array(F.lit("full"), F.lit("left"), F.lit("x")), (F.col("doc_id") % 3 + 1).cast("int"))
    head = F.concat(F.lit('<p class="page-img-'), kind, F.lit('"><img class="page-img-w50" src="'), F.col("doc_id").cast("string"), F.lit('"></p>'))
    return _docs(s, d).select("doc_id", images.inline_images(F.concat(head, F.coalesce("text", F.lit("")))).alias("html"))

_SPACE = " \\t-\\r\\x{3000}\\x{200b}\\x{200c}\\x{feff}"


def _tight_sql(x: str) -> str:
    """White space goes, but for a blank between ASCII letters and digits; twice, as neighbours share a character."""
    for _ in range(2):
        x = f"regexp_replace({x}, '([A-Za-z0-9])[{_SPACE}]+([A-Za-z0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"replace(regexp_replace({x}, '[{_SPACE}]+', '', 'g'), chr(1), ' ')"


_CENTRE = 'style="text-align:center"'
_FRAGMENT = (
    f"SELECT doc_id, '<h1 id=\"h1\" class=\"page-align-left\" {_CENTRE}>' || source || '</h1>' || chr(10) || '<p class=\"page-note\" style=\"margin-left:2em\">loose' || "
    f"{_tight_sql(sql_html("coalesce(text, '')"))} || '</p>' || chr(10) || '<table><tr><td> <p style=\"text-indent:2em\">' || lang || ' </p></td></tr></table>' || chr(10) || '<h2 id=\"h2\" {_CENTRE}>a&amp;b</h2>' || chr(10) || "
    "'<p>end</p>' AS html, 'h1:1:' || source || ',h2:2:a&b' AS headings FROM documents"
)


@query("html_fragment", _FRAGMENT)
def _fragment(s, d):
    """Each document as a page with a heading, text outside of blocks, a paragraph of all its text, a table and an end."""
    body = t.escape_html(t.text_or_empty(F.col("text")))
    page = F.concat(
        F.lit('<h1 class="page-align-left x">'), "source", F.lit('</h1>loose <p class="page-note y" data-pl="2">'), body, F.lit('</p></p><table><tr><td> <p class="z" data-ind="first">'),
        "lang", F.lit(" </p></td></tr></table><h2>a &amp; b</h2>\n end"),
    )
    out = fragments.rendered(_docs(s, d).select("doc_id", page.alias("html")), "doc_id", "html")
    line = lambda h: F.concat_ws(":", h["id"], h["level"].cast("string"), h["title"])
    return out.select("doc_id", "html", F.array_join(F.transform("headings", line), ",").alias("headings"))


_CSS = (
    "SELECT source, array_to_string(list_filter([CASE WHEN count(*) FILTER (lang = 'en') > 0 THEN '.page-note { font-size: .85em }' END, CASE WHEN count(*) FILTER (doc_id % 40 = 1) > 0 THEN "
    "'.page-underline { text-decoration: underline }' END, '.page-highlight-pink { background: #f8bbd0 }'], lambda x: x IS NOT NULL), chr(10)) AS css FROM documents GROUP BY source"
)


@query("html_css", _CSS)
def _css(s, d):
    """The style sheet of each source's documents, whose classes depend on language and number."""
    note = F.when(F.col("lang") == "en", '<p class="page-note other">').otherwise("<p>")
    line = F.when(F.col("doc_id") % 40 == 1, '<span class="page-highlight-pink page-underline">').otherwise('<span class="page-highlight-pink">')
    pages = _docs(s, d).select("source", F.concat(note, line, t.escape_html(t.text_or_empty(F.col("text"))), F.lit("</span></p>")).alias("html"))
    return styles.stylesheet(pages, "source", "html")


query("html_serialize", "SELECT doc_id, '<p><strong>' || lang || '</strong> x</p>' AS html FROM documents")(
    lambda s, d: (
        rules.format_pages(
            _docs(s, d).select("doc_id", F.concat(F.lit("<p><b>"), "lang", F.lit("</b> x<script></script></p></em>")).alias("html")),
            "html",
            [{"id": "1", "conditions": [{"formats": ["none"]}]}],
        )
        .select("doc_id", "formatted.html")
    )
)
query(
    "srch_replace_current",
    "SELECT doc_id, CASE WHEN contains(text, 'en') THEN substr(text, 1, strpos(text, 'en') - 1) || 'X' || substr(text, strpos(text, "
    "'en') + 2) ELSE text END AS text FROM documents",
)(
    lambda s, d: (
        _docs(s, d)
        .select(
            "doc_id",
            F.when(F.contains("text", F.lit("en")), F.concat(F.substring("text", F.lit(1), F.instr("text", "en") - 1), F.lit("X"), F.substring(F.col("text"), F.instr("text", "en") + 2, F.length("text")))).otherwise(F.col("text")).alias("text"),
        )
    )
)
def _table(s, chars: dict[str, str], phrases: dict[str, str]):
    return s.createDataFrame(list((chars | phrases).items()), "word string, to string")


@query("txt_t2s", "SELECT doc_id, '皇后在头发后面，乾坤干杯' || coalesce(text, '') || '发国' AS text FROM documents")
def _t2s(s, d):
    """Phrases come before characters: an empress stays what she is, what is behind does not."""
    table_ = _table(s, styles.SIMPLIFIED | {"頭": "头", "髮": "发", "乾": "干"}, {"皇后": "皇后", "乾坤": "乾坤"})
    text = F.concat(F.lit("皇后在頭髮後面，乾坤乾杯"), t.text_or_empty(F.col("text")), F.lit("發國"))
    return lexicon.converted(_docs(s, d).select("doc_id", text.alias("text")), "doc_id", "text", table_)


@query("txt_s2t", "SELECT doc_id, '皇后在頭髮後面' || coalesce(text, '') || '發國' AS text FROM documents")
def _s2t(s, d):
    table_ = _table(s, styles.TRADITIONAL | {"头": "頭"}, {"皇后": "皇后", "头发": "頭髮"})
    text = F.concat(F.lit("皇后在头发后面"), t.text_or_empty(F.col("text")), F.lit("发国"))
    return lexicon.converted(_docs(s, d).select("doc_id", text.alias("text")), "doc_id", "text", table_)


#: The dark block of each document's page: 4 to 16 wide, 5 to 25 high.
_INK = "(4 + doc_id % 13) * (5 + n_chars % 21)"


def _grey(s, d):
    """A page of 20 by 30 for each document, with a dark block of its own size, or nothing on every sixth."""
    inside = lambda i: (i % 20).between(2, F.col("bw") + 1) & F.floor(i / 20).between(3, F.col("bh") + 2)
    rows = _docs(s, d).select(F.col("doc_id").alias("page"), F.lit(30).alias("h"), F.lit(20).alias("w"), (F.col("doc_id") % 13 + 4).alias("bw"), (F.col("n_chars") % 21 + 5).alias("bh"))
    byte = F.transform(F.sequence(F.lit(0), F.lit(599)), lambda i: F.when(inside(i) & (F.col("page") % 6 > 0), "10").otherwise("FF"))
    return rows.withColumn("gray", F.unhex(F.array_join(byte, ""))).drop("bw", "bh")


@query(
    "flt_ink_bbox",
    f"SELECT doc_id AS page, CASE WHEN doc_id % 6 > 0 AND {_INK} >= 150 AND doc_id % 13 >= 4 AND n_chars % 21 >= 3 THEN '2,3,' || (6 + doc_id % 13) || ',' || (8 + n_chars % 21) END AS box FROM documents",
)
def _ink_box(s, d):
    return styles.ink(_grey(s, d), "page").select("page", F.when(F.col("box").isNotNull(), F.array_join(F.col("box").cast("array<string>"), ",")).alias("box"))


query("flt_ink_ratio", f"SELECT doc_id AS page, CASE WHEN doc_id % 6 > 0 THEN round({_INK} / 600.0, 6) ELSE 0 END AS ink FROM documents")(
    lambda s, d: styles.ink(_grey(s, d), "page").select("page", F.round("ink", 6).alias("ink"))
)
query("ut_bench_page", "SELECT doc_id AS page, doc_id % 6 = 0 AS blank FROM documents")(
    lambda s, d: styles.ink(_grey(s, d), "page").select("page", (F.col("ink") < 1e-4).alias("blank"))
)
@query("src_pdf_pages", "SELECT doc_id::VARCHAR AS path, unnest(range(1, 2 + doc_id % 7))::INT AS page FROM documents")
def _pdf_pages(s, d):
    """A PDF of each document, of one to seven pages, whose tree is read for their number; drawing is injected."""
    n = (F.col("doc_id") % 7 + 1).cast("int")
    kids = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat((i + 2).cast("string"), F.lit(" 0 R"))), " ")
    pages = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat((i + 2).cast("string"), F.lit(" 0 obj\n<</Type/Page/Parent 2 0 R>>\nendobj\n"))), "")
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids["), kids, F.lit("]/Count "), n.cast("string"), F.lit(">>\nendobj\n"), pages, F.lit("trailer\n<</Root 1 0 R>>\n%"), F.regexp_replace(t.text_or_empty(F.col("text")), "[^A-Za-z ]", "-"))
    files_ = _docs(s, d).select(F.col("doc_id").cast("string").alias("path"), F.encode(body, "UTF-8").alias("content"))
    counted = files_.withColumn("n_pages", pdf.page_counts(F.col("content")))
    return styles.render_pages(counted, lambda data, page: data[:page]).select("path", "page")


@batch_udf("binary")
def _drawn(v):
    import numpy as np
    import pyarrow as pa

    from pagewright.sources import png

    return pa.array([png.encode(np.frombuffer((x or b"").ljust(-(-max(len(x or b""), 1) // 32) * 32, b"\xff"), np.uint8).reshape(-1, 32)) for x in v.to_pylist()], pa.binary())


@query("src_img_preprocess", "SELECT doc_id, 32 AS width, greatest(1, (strlen(coalesce(text, '')) + 31) // 32)::INT AS height FROM documents")
def _preprocessed(s, d):
    """A picture of each document, its bytes as grey values in rows of 32, through median, sharpening and threshold."""
    drawn = _docs(s, d).select("doc_id", _drawn(F.encode(t.text_or_empty(F.col("text")), "UTF-8")).alias("image"))
    done = styles.preprocess(drawn, "image", lambda x: png.preprocessed(x, binarize=True))
    return done.select("doc_id", files.png_size(F.col("image")).alias("p")).select("doc_id", "p.width", "p.height")


query("pr_vlm", "SELECT doc_id, 'ok' AS said FROM documents")(
    lambda s, d: (
        styles.preprocess(_docs(s, d).select("doc_id", F.encode("text", "UTF-8").alias("image")), "image", lambda x: b"ok")
        .select("doc_id", F.decode("image", "UTF-8").alias("said"))
    )
)


@batch_udf("binary")
def _titled(content, title):
    import pyarrow as pa

    rows = zip(content.to_pylist(), title.to_pylist())
    return pa.array([epub.update_meta(c, t.encode(), title=t, description="d") for c, t in rows], pa.binary())


@batch_udf("string")
def _cover(content):
    import pyarrow as pa

    return pa.array([epub.cover_bytes(c).decode() for c in content.to_pylist()], pa.string())


@query(
    "sink_epub_meta",
    "SELECT DISTINCT conv_id::VARCHAR AS path, 'New ' || conv_id AS title, 'A & B' AS author, 'd' AS description, 'New ' || conv_id AS cover FROM conversations",
)
def _meta(s, d):
    """Books that get a title, a description and a cover, which are read back."""
    changed = _books(s, d).select("path", _titled("content", F.concat(F.lit("New "), "path")).alias("content"))
    covers = changed.select("path", _cover("content").alias("cover"))
    return epub.books(changed).select("path", "meta.title", "meta.author", "meta.description").join(covers, "path")


@query(
    "sink_epub_edit",
    "SELECT 'b/' || conv_id || '_编辑' || ['', ' (1)', ' (2)'][conv_id % 3 + 1] || '.epub' AS path, count(*) AS articles, 'T & ' || min(turn) AS title, sum(length('<h1>T &amp; ' || turn || '</h1>' || chr(10)) + "
    f"CASE WHEN regexp_matches(coalesce(text, ''), '[^ \\t-\\r]') THEN 7 + length({sql_html('text')}) ELSE 0 END)::BIGINT AS chars FROM conversations GROUP BY conv_id",
)
def _edited(s, d):
    """Conversations as edited books; of a third the new name is free, of a third it is taken, of a third its first number is, too."""
    text = F.concat(t.escape_html(t.text_or_empty(F.col("text"))), F.lit("<script>x</script>"))
    path = F.concat(F.lit("b/"), F.col("conv_id").cast("string"), F.lit(".epub"))
    title = F.concat(F.lit("T & "), F.col("turn").cast("string"))
    talks = table(s, d, "conversations")
    articles = talks.select(path.alias("path"), F.col("turn").cast("int").alias("n"), title.alias("title"), text.alias("text"))
    names = F.slice(F.array(F.lit("_编辑.epub"), F.lit("_编辑 (1).epub")), F.lit(1), (F.col("conv_id") % 3).cast("int"))
    existing = talks.select("conv_id").distinct().select(F.explode(F.transform(names, lambda x: F.concat(F.lit("b/"), F.col("conv_id").cast("string"), x))).alias("path"))
    read = epub.books(epub.edited_books(articles, existing))
    size = F.aggregate("spine", F.lit(0).cast("long"), lambda a, x: a + F.length(x["body"]))
    return read.select("path", F.size("spine").cast("long").alias("articles"), "meta.title", size.alias("chars"))


@batch_udf("string")
def _part(content, name):
    import io
    import zipfile

    import pyarrow as pa

    return pa.array([zipfile.ZipFile(io.BytesIO(c)).read(n).decode() for c, n in zip(content.to_pylist(), name.to_pylist())], pa.string())


query("sink_opf", "SELECT conv_id::VARCHAR AS path, count(*)::INT AS refs FROM conversations GROUP BY conv_id")(
    lambda s, d: (
        _books(s, d)
        .select("path", F.regexp_count(_part("content", F.lit("OEBPS/content.opf")), F.lit("<itemref ")).alias("refs"))
    )
)
query("sink_ncx", "SELECT conv_id::VARCHAR AS path, count(*)::INT AS points FROM conversations GROUP BY conv_id")(
    lambda s, d: (
        _books(s, d)
        .select("path", F.regexp_count(_part("content", F.lit("OEBPS/toc.ncx")), F.lit("<navPoint ")).alias("points"))
    )
)
query("sink_epub_pack", "SELECT conv_id::VARCHAR AS path, 'application/epub+zip' AS kind FROM conversations GROUP BY conv_id")(
    lambda s, d: (
        _books(s, d).select("path", _part("content", F.lit("mimetype")).alias("kind"))
    )
)
query(
    "win_gaps_islands",
    "SELECT user_id, count(*) AS islands FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, "
    "event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS cut FROM events) WHERE cut = 1 GROUP BY user_id",
)(
    lambda s, d: _islands(s, d)
)


def _islands(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return e.withColumn("cut", F.when(gap <= 3_600_000_000, 0).otherwise(1)).where("cut = 1").groupBy("user_id").agg(F.count("*").alias("islands"))


query("html_toc_nested", None)(lambda s, d: chapters.toc(table(s, d, "pages"), "page_id", "html"))
