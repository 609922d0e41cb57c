"""Style and markup normalisers of page HTML as native expressions, and small page-image measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import u_trim
from pagewright.names import CLASS_PREFIX

# Units of cell sizes with their bounds.
LENGTHS = {"%": (1, 100), "px": (1, 2000), "em": (1, 50)}


def _last(style: Column, name: str) -> Column:
    """The value of a property's last declaration, in lower case; null without one."""
    parts = F.filter(F.split(F.coalesce(style, F.lit("")), ";"), lambda d: F.lower(u_trim(F.substring_index(d, ":", 1))).eqNullSafe(F.lit(name)) & F.contains(d, F.lit(":")))
    value = F.element_at(F.transform(parts, lambda d: F.lower(u_trim(F.substring(d, F.instr(d, ":") + 1, F.length(d))))), F.lit(-1))
    return F.when(F.size(parts) > 0, value)


def image_width(style: Column) -> Column:
    """``width:N%`` for whole N from 1 to 100, else nothing."""
    n = F.regexp_extract(F.coalesce(_last(style, "width"), F.lit("")), r"^([0-9]{1,3})\s*%$", 1).try_cast("int")
    return F.when(n.between(1, 100), F.concat(F.lit("width:"), n.cast("string"), F.lit("%"))).otherwise("")


def _length(v: Column) -> Column:
    pattern = r"^([0-9]{1,4}(?:\.[0-9]{1,2})?)\s*(%|px|em)$"
    num, unit = F.regexp_extract(v, pattern, 1).try_cast("double"), F.regexp_extract(v, pattern, 2)
    ok = F.lit(False)
    for u, (lo, hi) in LENGTHS.items():
        ok = ok | ((unit == u) & num.between(lo, hi))
    shown = F.regexp_replace(F.regexp_replace(num.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(ok, F.concat(shown, unit))


def cell_style(style: Column) -> Column:
    """Width, height and vertical alignment of a table cell, within bounds, in this order."""
    valign = _last(style, "vertical-align")
    parts = [F.concat(F.lit(f"{p}:"), _length(_last(style, p))) for p in ("width", "height")]
    return F.concat_ws(";", *parts, F.when(valign.isin("top", "middle", "bottom"), F.concat(F.lit("vertical-align:"), valign)))


def table_style(style: Column) -> Column:
    return F.when(_last(style, "table-layout") == "fixed", "table-layout:fixed").otherwise("")


def ruby(c: Column) -> Column:
    """Ruby markup with its text alone: attributes and fallback brackets go."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<rp\b[^>]*>.*?</rp\s*>", ""), r"(?i)<(ruby|rt)\b[^>]*>", "<$1>")


NOTE = "注释："
NOTE_CLASS = f"{CLASS_PREFIX}note-label"


def note_labels(html: Column) -> Column:
    """Bold note labels in one form, and a class on the block that holds one or begins with a bare one; tables stay."""
    bold = F.regexp_replace(html, r"(?i)<(strong|b)\b[^>]*>\s*注\s*释\s*[:：]?\s*</\1\s*>\s*[:：]?", f"<strong>{NOTE}</strong>")
    opened = r"(?is)<(p|h[1-6]|div)((?:(?!\bclass=)[^>])*)>((?:(?!</?(?:p|h[1-6]|div|table)\b).)*?(?:<strong>注释：</strong>))"
    classed = F.regexp_replace(bold, opened, f'<$1$2 class="{NOTE_CLASS}">$3')
    bare = r"(?is)<(p|div)((?:(?!\bclass=)[^>])*)>(\s*注释[:：]?\s*</)"
    return F.when(F.contains(html, F.lit("注释")), F.regexp_replace(classed, bare, f'<$1$2 class="{NOTE_CLASS}">$3')).otherwise(html)


def _number(attrs: Column, name: str) -> Column:
    return F.regexp_extract(attrs, rf'{name}="\s*(-?[0-9]+(?:\.[0-9]+)?)\s*"', 1).try_cast("double")


def _shown(x: Column) -> Column:
    return F.regexp_replace(F.round(x, 4).cast("decimal(12,4)").cast("string"), r"\.?0+$", "")


def indent_style(attrs: Column) -> Column:
    """Indents and spacing in data attributes as inline declarations."""
    a = F.coalesce(attrs, F.lit(""))
    pl, pr, iv = _number(a, "data-pl"), _number(a, "data-pr"), F.coalesce(_number(a, "data-indv"), F.lit(2.0))
    mode = F.regexp_extract(a, r'data-ind="\s*(first|hang)\s*"', 1)
    em = lambda name, x: F.concat(F.lit(name), _shown(x), F.lit("em"))
    lh = _number(a, "data-lh")
    return F.concat_ws(
        ";", F.when(mode == "hang", em("margin-left:", F.coalesce(pl, F.lit(0.0)) + iv)).otherwise(em("margin-left:", pl)),
        F.when(mode == "hang", F.concat(F.lit("text-indent:-"), _shown(iv), F.lit("em"))).when(mode == "first", em("text-indent:", iv)),
        em("margin-right:", pr), em("margin-top:", _number(a, "data-spb") * 1.5), em("margin-bottom:", _number(a, "data-spa") * 1.5), F.when(lh > 0, F.concat(F.lit("line-height:"), _shown(lh))),
    )


#: A few common characters in both scripts; a full table is a parameter.
SIMPLIFIED = {"們": "们", "這": "这", "個": "个", "來": "来", "說": "说", "國": "国", "時": "时", "會": "会", "學": "学", "對": "对", "過": "过", "後": "后", "書": "书", "經": "经", "發": "发", "長": "长", "開": "开", "關": "关", "點": "点", "頁": "页"}
TRADITIONAL = {v: k for k, v in SIMPLIFIED.items()}


#: What the classes of formatted pages stand for in a book's style sheet.
CLASS_STYLES = {
    "note": "font-size: .85em", "flush": "text-indent: 0", "indent": "text-indent: 2em", "underline": "text-decoration: underline", "strike": "text-decoration: line-through",
    "shade": "background: #eef1f4", "highlight": "background: #e0e0e0", "highlight-green": "background: #c8e6c9", "highlight-blue": "background: #bbdefb", "highlight-pink": "background: #f8bbd0",
    "highlight-orange": "background: #ffe0b2", "highlight-purple": "background: #e1bee7", "wavy": "text-decoration: underline wavy", "double": "text-decoration: underline double",
    "overline": "text-decoration: overline", "emphasis": "text-emphasis: dot", "sup": "vertical-align: super; font-size: .7em", "sub": "vertical-align: sub; font-size: .7em",
    "align-left": "text-align: left", "align-center": "text-align: center", "align-right": "text-align: right", "page-break": "page-break-before: always",
}


def stylesheet(pages: DataFrame, by: str, html: str) -> DataFrame:
    """by and css: for each book the rules of the classes that stand in its pages, in the order of the sheet.

    Classes are told apart before they are gathered, so a book of any length sends each class once a task.
    """
    names = F.flatten(F.transform(F.regexp_extract_all(F.col(html), F.lit('class="([^"]*)"'), F.lit(1)), lambda c: F.split(c, r"\s+")))
    used = pages.select(F.col(by), F.explode_outer(F.array_distinct(names)).alias("class")).distinct()
    rules = F.array(*[F.struct(F.lit(CLASS_PREFIX + c).alias("class"), F.lit(f".{CLASS_PREFIX}{c} {{ {s} }}").alias("rule")) for c, s in CLASS_STYLES.items()])
    held = used.groupBy(by).agg(F.collect_set("class").alias("held"))
    return held.select(by, F.array_join(F.transform(F.filter(rules, lambda r: F.array_contains("held", r["class"])), lambda r: r["rule"]), "\n").alias("css"))


def ink(pages: DataFrame, key: str, threshold: int = 200, border: float = 0.01, pad: float = 0.015, least: float = 0.25, most: float = 0.97) -> DataFrame:
    """Each grey page's (key, h, w, gray bytes) share of dark pixels and the box of its ink, null where a crop is of no use."""
    px = pages.select(key, "h", "w", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("gray")), lambda i: F.conv(F.hex(F.substring("gray", i, F.lit(1))), 16, 10).cast("int"))).alias("i", "v"))
    px = px.withColumns({"x": F.col("i") % F.col("w"), "y": F.floor(F.col("i") / F.col("w")), "bx": F.greatest(F.lit(1), F.floor(F.col("w") * border)), "by": F.greatest(F.lit(1), F.floor(F.col("h") * border))})
    inside = (F.col("v") < threshold) & F.col("x").between(F.col("bx"), F.col("w") - F.col("bx") - 1) & F.col("y").between(F.col("by"), F.col("h") - F.col("by") - 1)
    q = lambda c, p: F.floor(F.percentile(F.when(inside, F.col(c) - F.col("b" + c)), p)) + F.first("b" + c)
    b = px.groupBy(key, "h", "w").agg(F.avg((F.col("v") < threshold).cast("double")).alias("ink"), q("x", 0.005).alias("x1"), q("x", 0.995).alias("x2"), q("y", 0.005).alias("y1"), q("y", 0.995).alias("y2"))
    dx, dy = F.floor(F.col("w") * pad), F.floor(F.col("h") * pad)
    b = b.withColumns({"x1": F.greatest(F.lit(0), F.col("x1") - dx), "x2": F.least(F.col("w"), F.col("x2") + dx + 1), "y1": F.greatest(F.lit(0), F.col("y1") - dy), "y2": F.least(F.col("h"), F.col("y2") + dy + 1)})
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    use = (area < most * F.col("w") * F.col("h")) & (area >= least * F.col("w") * F.col("h")) & (F.col("x2") - F.col("x1") >= 8) & (F.col("y2") - F.col("y1") >= 8)
    return b.select(key, "ink", F.when(use, F.array(*[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")])).alias("box"))


def render_pages(files: DataFrame, render, n_pages: str = "n_pages") -> DataFrame:
    """path, page and image of ``render(bytes, page) -> bytes`` for each page of (path, content, n_pages) rows."""
    rows = files.select("path", "content", F.explode(F.sequence(F.lit(1), F.col(n_pages))).alias("page"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "page": pdf["page"], "image": [render(bytes(c), int(p)) for c, p in zip(pdf["content"], pdf["page"])]})

    return rows.mapInPandas(run, "path string, page int, image binary")


def preprocess(df: DataFrame, image: str, process) -> DataFrame:
    """Images through ``process(bytes) -> bytes``; one that fails stays as it is."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def run(v):
        import pyarrow as pa

        out = []
        for x in v.to_pylist():
            try:
                out.append(process(x))
            except Exception:  # the page is used unprocessed
                out.append(x)
        return pa.array(out, pa.binary())

    return df.withColumn(image, run(F.col(image)))
