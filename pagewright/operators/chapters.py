"""Chapters, contents and search over page HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import let, running, u_trim

TOKENS = "<[^>]+>|[^<]+|<"


def tag_free(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def decoded(c: Column) -> Column:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def html_text(html: Column) -> Column:
    """Text nodes one after another, without scripts and styles."""
    return decoded(tag_free(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")))


def split_articles(books: DataFrame, key: str, html: str, fallback: str, keep_heading: bool = False) -> DataFrame:
    """key, article (from 1), title and text: parts that begin at an ``<h1`` outside tables; what comes before is a preface.

    Table contents are masked for the split, so a heading in a cell does not begin an article.
    """
    mark = "\ue010"
    pieces = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<table\b.*?(?:</table\s*>|\z)|(?:(?!<table\b).)+"), F.lit(0))
    marked = F.array_join(F.transform(pieces, lambda p: F.when(F.lower(F.left(p, F.lit(6))) == "<table", p).otherwise(F.regexp_replace(p, r"(?i)(?=<h1[\s>])", mark))), "")
    parts = books.select(key, F.col(fallback).alias("__f"), F.posexplode(F.split(marked, mark)).alias("i", "part"))
    heading = F.regexp_extract("part", r"(?is)^<h1[^>]*>(.*?)</h1\s*>", 1)
    title = u_trim(F.regexp_replace(decoded(tag_free(heading)), r"\s+", " "))
    text = F.col("part") if keep_heading else F.regexp_replace("part", r"(?is)^<h1[^>]*>.*?</h1\s*>", "")
    rows = parts.where((F.col("i") > 0) | (u_trim(F.col("part")) != "")).select(key, "i", F.when(title != "", title).otherwise(F.col("__f")).alias("title"), u_trim(text).alias("text"))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("i")).alias("article"), "title", "text")


def toc(books: DataFrame, key: str, html: str) -> DataFrame:
    """key, seq, level and title of all headings, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]\s*>"), F.lit(0))
    rows = books.select(key, F.posexplode(found).alias("seq", "h"))
    return rows.select(key, "seq", F.regexp_extract("h", "(?i)<h([1-6])", 1).cast("int").alias("level"), u_trim(F.regexp_replace(decoded(tag_free(F.col("h"))), r"\s+", " ")).alias("title"))


def literal(term: str) -> str:
    import re

    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", term)


def find(rows: DataFrame, key: str, text: str, pattern: str, context: int | None = 40, most: int | None = None) -> DataFrame:
    """key, match (from 1), start, before, hit and after of all matches, numbered; ``most`` keeps the first ones of each.

    Without a context there is no before and after.

    What stands before a match is carried along the text from its beginning, what stands after it from its end, so no match
    takes the text along and nothing is shuffled.
    """
    parts = F.struct(F.split(F.col(text), pattern).alias("gaps"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("hits"))

    def placed(p):
        ahead = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["hits"])), p["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("hit")))
        ends = lambda a: running(F.transform(a, lambda x: x["gap"] + x["size"]), F.lit(0), lambda end, n: end + n)
        return let(ahead, lambda a: F.zip_with(a, ends(a), lambda x, end: F.struct((end - x["size"]).alias("start"), x["hit"].alias("hit"))))

    def found(p):
        if context is None:
            return placed(p) if most is None else F.slice(placed(p), F.lit(1), F.lit(most))
        n = F.size(p["hits"])
        ahead = F.zip_with(F.slice(p["gaps"], F.lit(1), n), p["hits"], lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        back = F.reverse(F.zip_with(F.slice(p["gaps"], F.lit(2), n), F.concat(F.slice(p["hits"], F.lit(2), n), F.array(F.lit(""))), lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))))
        zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("before"), F.lit("").alias("hit"), F.lit("").alias("tail"))

        def step(a, x):
            start, before = a["end"] + F.length(x["gap"]), F.right(F.concat(a["tail"], x["gap"]), F.lit(context))
            return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), before.alias("before"), x["hit"].alias("hit"), F.right(F.concat(before, x["hit"]), F.lit(context)).alias("tail"))

        after = F.reverse(running(back, F.lit(""), lambda a, x: F.left(F.concat(x["gap"], x["hit"], a), F.lit(context))))
        both = F.zip_with(running(ahead, zero, step), after, lambda x, y: F.struct(x["start"].alias("start"), x["before"].alias("before"), x["hit"].alias("hit"), y.alias("after")))
        return both if most is None else F.slice(both, F.lit(1), F.lit(most))

    hits = rows.where(F.col(text).rlike(pattern)).select(key, F.posexplode(let(parts, found)).alias("found_at", "found"))
    shown = ["found.start", "found.hit"] if context is None else ["found.start", "found.before", "found.hit", "found.after"]
    return hits.select(key, (F.col("found_at") + 1).alias("match"), *shown)


def replace_in_text(html: Column, term: str, to: str, pattern: bool = False) -> Column:
    """Replace in text between tags only; what is put in is taken as it is."""
    one = (lambda p: F.regexp_replace(p, term, to.replace("\\", "\\\\").replace("$", "\\$"))) if pattern else (lambda p: F.replace(p, F.lit(term), F.lit(to)))
    pieces = F.regexp_extract_all(html, F.lit(f"(?s){TOKENS}"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("<")) & F.endswith(p, F.lit(">")), p).otherwise(one(p))), "")


def highlight(html: Column, term: str) -> Column:
    pieces = F.regexp_extract_all(html, F.lit(f"(?s){TOKENS}"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("<")) & F.endswith(p, F.lit(">")), p).otherwise(F.regexp_replace(p, f"({literal(term)})", "<mark>$1</mark>"))), "")


def self_closed(html: Column) -> Column:
    """Void elements in XHTML form."""
    return F.regexp_replace(html, r"(?i)<(br|hr|img|input|meta|link|col|wbr)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)\s*/?>", "<$1$2/>")


def image_page(html: Column) -> Column:
    """Holds an image and no letter, digit or Chinese character in its text."""
    return html.rlike("(?i)<img") & ~tag_free(html).rlike(r"[A-Za-z0-9\x{3400}-\x{9fff}]")


def split_limit(html: str, limit: int) -> list[str]:
    """Parts of at most ``limit`` characters that end after a block where one does, never inside a table."""
    import re

    out = []
    while len(html) > limit:
        cut = 0
        for m in re.finditer(r"(?i)</(?:p|h[1-6]|table)\s*>", html[:limit]):
            head = html[: m.end()].lower()
            if head.count("<table") <= head.count("</table"):
                cut = m.end()
        if not cut:
            opened = html[:limit].lower().rfind("<table")
            closed = html.lower().find("</table>", limit)
            inside = opened >= 0 and "</table" not in html[opened:limit].lower()
            cut = opened if inside and opened > 0 else (closed + 8 if inside and closed >= 0 else limit)
        out.append(html[:cut])
        html = html[cut:]
    return [*out, html] if html or not out else out
