"""Fragments of pages as they stand in a book: blocks rebuilt from rows of tokens, tables whole, headings with ids.

A page is cut into rows: start and end tags of paragraphs and headings, tables, and what stands between. Which block a row
belongs to follows from windows over the page: an end tag closes the block of the start tag before it if it is the first
of its kind since; a start tag and a table close what is open; what stands outside of blocks goes to the block that
begins after it, or, before a table and at the end, is a paragraph of its own.

White space in text goes but for one blank between ASCII letters and digits; it stays in formulas, in blocks to the right,
in note labels and in tables, and inside lines that are aligned with one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import STOP, escape_html, let, u_trim
from pagewright.names import CLASS_PREFIX
from pagewright.operators.chapters import decoded, tag_free
from pagewright.operators.styles import indent_style

# What counts as markup, as white space, and the classes that blocks keep.
MARKUP = r"(?i)</?(?:p|h[1-6]|strong|em|br|span|table|thead|tbody|tfoot|tr|th|td|math|semantics|annotation|mrow|mi|mn|mo|mtext|mstyle|mspace|msup|msub|msubsup|mfrac|msqrt|mroot|mtable|mtr|mtd)[^>]*>"
SPACES = r" \t\n\r\f\x0B\x{3000}\x{200b}\x{200c}\x{feff}"
CLASSES = [
    "note", "note-label", "align-left", "align-center", "align-right", "align-lines", "page-break", "flush", "indent", "citation", "caption",
    "img-full", "img-fit", "img-inline", "img-float-left", "img-float-right", "img-w25", "img-w50", "img-w75", "img-w100", "img-left", "img-center", "img-right", "img-vtop", "img-vmid", "img-vbot",
]
BOUNDARY = r"(?is)<table\b[^>]*>.*?(?:</table\s*>|\z)|</?(?:p|h[1-6])\b[^>]*>"
PIECE = r"(?is)<math\b.*?(?:</math\s*>|\z)|<[^>]+>|[^<]+|<"


def _tight(text: Column) -> Column:
    """Text without white space, one blank between ASCII letters and digits."""
    kept = F.regexp_replace(text, rf"(?<=[A-Za-z0-9])[{SPACES}]++(?=[A-Za-z0-9])", STOP)
    return F.replace(F.regexp_replace(kept, f"[{SPACES}]+", ""), F.lit(STOP), F.lit(" "))


def _ends(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACES}]++|(?<![{SPACES}])[{SPACES}]++\z", "")


def _inline(content: Column, spaces: Column) -> Column:
    """What stands in a block: markers go, the white space of text is treated by ``spaces``."""
    is_tag = lambda x: F.startswith(x, F.lit("<")) & F.endswith(x, F.lit(">"))
    shown = lambda x: F.when(is_tag(x), F.when(x.rlike(f"(?i)^<math|^[^>]*data-{CLASS_PREFIX}marker"), F.when(F.startswith(F.lower(x), F.lit("<math")), x).otherwise("")).otherwise(x)).when(spaces == "tight", _tight(x)).when(spaces == "ends", _ends(x)).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(PIECE), F.lit(0)), shown), "")


def _class(attributes: Column) -> Column:
    """The class attribute of a block with the classes that stay, or nothing."""
    known = [CLASS_PREFIX + c for c in CLASSES]
    kept = F.filter(F.split(F.regexp_extract(attributes, 'class="([^"]*)"', 1), r"\s+"), lambda c: c.isin(*known) | F.startswith(c, F.lit(f"{CLASS_PREFIX}divider")))
    return let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit(' class="'), F.array_join(k, " "), F.lit('"'))).otherwise(""))


def _style(attributes: Column, more: str = "") -> Column:
    declared = F.concat_ws(";", F.when(indent_style(attributes) != "", indent_style(attributes)), *[F.lit(m) for m in [more] if m])
    return let(declared, lambda s: F.when(s != "", F.concat(F.lit(' style="'), s, F.lit('"'))).otherwise(""))


def _table(markup: Column) -> Column:
    """A table as it is, but for the paragraphs in its cells, which are written like any other."""

    def cell(c):
        attributes = F.regexp_extract(c, r"(?is)\A<p\b([^>]*)>", 1)
        return F.when(c.rlike(r"(?i)\A<p\b[^>]*>"), F.concat(F.lit("<p"), _class(attributes), _style(attributes), F.lit(">"), F.regexp_replace(c, r"(?i)\A<p\b[^>]*>", ""))).otherwise(c)

    cells = F.split(markup, r"(?i)(?=<(?:td|th)\b)")
    inside = lambda x, i: F.when(i == 0, x).otherwise(F.array_join(F.transform(F.split(x, r"(?i)(?=<p\b)"), cell), ""))
    return F.when(markup.rlike(r"(?i)<p\b"), F.array_join(F.transform(cells, inside), "")).otherwise(markup)


def _lines(text: Column) -> Column:
    """A page without markup: a paragraph for each line that holds something."""
    kept = F.filter(F.transform(F.split(text, "\n"), u_trim), lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("<p>"), escape_html(_tight(x)), F.lit("</p>"))), "\n")


def _rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, i, kind (open, close, table, text), name and text of each piece of the pages, in order."""
    gaps, marks = F.split(F.col(html), BOUNDARY), F.regexp_extract_all(F.col(html), F.lit(BOUNDARY), F.lit(0))
    pair = lambda g, m: F.array(F.struct(F.lit("text").alias("kind"), g.alias("text")), F.struct(F.lit("mark").alias("kind"), m.alias("text")))
    pieces = F.filter(F.flatten(F.zip_with(gaps, marks, pair)), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    rows = pages.select(F.col(key).alias("key"), F.posexplode(pieces).alias("i", "x")).select("key", "i", "x.kind", "x.text")
    name = F.lower(F.regexp_extract("text", "(?i)^</?(p|h[1-6])", 1))
    kind = F.when(F.col("kind") == "text", "text").when(F.lower("text").startswith("<table"), "table").when(F.startswith("text", F.lit("</")), "close").otherwise("open")
    return rows.select("key", "i", kind.alias("kind"), F.when(kind.isin("open", "close"), name).alias("name"), "text")


def rendered(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, html and headings (an array of id, level and title) of each page; null is an empty page."""
    page = F.coalesce(F.col(html).cast("string"), F.lit(""))
    given = pages.select(F.col(key).alias("key"), page.alias("page"))
    plain = given.where(~F.col("page").rlike(MARKUP)).select("key", _lines(F.col("page")).alias("html"), F.array().cast("array<struct<id:string,level:int,title:string>>").alias("headings"))
    rows = _rows(given.where(F.col("page").rlike(MARKUP)), "key", "page")
    c, in_order = F.col, Window.partitionBy("key").orderBy("i")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # The start tag or table before a row, and whether a fitting end tag stands between.
    starter = F.when(c("kind").isin("open", "table"), F.struct("i", "kind", "name"))
    rows = rows.withColumn("since", F.last(starter, True).over(before))
    fitting = (c("kind") == "close") & (c("since.kind") == "open") & (c("name") == c("since.name"))
    rows = rows.withColumn("fits", fitting).withColumn("closed", F.coalesce(F.max("fits").over(Window.partitionBy("key", "since.i").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    # Rows after the tag that began a block have it as ``since``; its own row begins anew.
    is_open = (c("since.kind") == "open") & ~c("closed")
    # A frame that ends at its row is a running one; one that begins there would be worked out anew for each row.
    ahead = F.last(starter, True).over(Window.partitionBy("key").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1))
    attributes = F.regexp_extract("text", "(?is)^<(?:p|h[1-6])([^>]*)>", 1)
    spaces = F.when(attributes.contains(f"{CLASS_PREFIX}align-lines"), "ends").when(attributes.contains(f"{CLASS_PREFIX}align-right") | attributes.contains(f"{CLASS_PREFIX}note-label"), "all").otherwise("tight")
    rows = rows.withColumn("ahead", ahead).withColumn("spaces", F.coalesce(F.last(F.when(c("kind") == "open", spaces), True).over(before), F.lit("tight")))
    number = F.count_if((c("kind") == "open") & (c("name") != "p")).over(in_order)
    # Loose text of a page's end comes last; before a table it is a block of its own, just before.
    block = F.when(c("kind").isin("open", "table"), c("i") * 2).when(is_open, c("since.i") * 2).when(c("ahead.kind") == "open", c("ahead.i") * 2).when(c("ahead.kind") == "table", c("ahead.i") * 2 - 1).otherwise(F.lit(2**31 - 1).cast("long"))
    rows = rows.withColumn("number", number).where(c("kind") != "close").withColumn("block", block)
    head = F.concat(F.lit("<"), c("name"), F.when(c("name") != "p", F.concat(F.lit(' id="h'), c("number").cast("string"), F.lit('"'))).otherwise(""), _class(attributes), F.when(c("name") == "p", _style(attributes)).otherwise(_style(attributes, "text-align:center")), F.lit(">"))
    shown = rows.select(
        "key", "block", "i", "kind", "name", "number", is_open.alias("inside"),
        F.when(c("kind") == "open", head).when(c("kind") == "table", _table(c("text"))).otherwise(_inline(c("text"), c("spaces"))).alias("shown"),
    )
    parts = F.array_sort(F.collect_list(F.struct("i", "kind", "name", "number", "inside", "shown")))
    blocks = shown.groupBy("key", "block").agg(parts.alias("parts"), F.max(F.when(c("kind") == "open", F.struct("name", "number", "shown"))).alias("head"))
    texts = lambda keep: F.array_join(F.transform(F.filter("parts", keep), lambda x: x["shown"]), "")
    body = texts(lambda x: x["kind"] != "open")
    whole = F.when(c("head").isNotNull(), F.concat(c("head.shown"), body, F.lit("</"), c("head.name"), F.lit(">"))).when(F.exists("parts", lambda x: x["kind"] == "table"), body).otherwise(F.concat(F.lit("<p>"), body, F.lit("</p>")))
    title = u_trim(decoded(tag_free(texts(lambda x: (x["kind"] == "text") & x["inside"]))))
    heading = F.when((c("head.name") != "p") & (title != ""), F.struct(F.concat(F.lit("h"), c("head.number").cast("string")).alias("id"), F.substring("head.name", 2, 1).cast("int").alias("level"), title.alias("title")))
    done = blocks.select("key", F.struct("block", whole.alias("html"), heading.alias("heading")).alias("b")).groupBy("key").agg(F.array_sort(F.collect_list("b")).alias("b"))
    marked = done.select("key", F.array_join(F.transform("b", lambda x: x["html"]), "\n").alias("html"), F.array_compact(F.transform("b", lambda x: x["heading"])).alias("headings"))
    return plain.unionByName(marked).withColumnRenamed("key", key)
