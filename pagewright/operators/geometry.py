"""From lines with boxes to visual rows and paragraphs, by windows over lines in reading order.

Lines: page key columns, seq (input order), text and box (array<double>: 4 corners or 8 polygon numbers, or null).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import join_fragments, u_trim

# Marks that end a sentence, and characters that begin a block.
SENTENCE_END = r"[。！？；：.!?;:)）】」』》〉\"'”]$"
BLOCK_START = r"^[0-9a-zA-Z(\[{（【〔\"'“‘，、。：；！？第]"


def normal_box(box: Column) -> Column:
    """x1, y1, x2, y2 of a box or polygon; null where it has no area."""
    at = lambda parity: F.filter(box, lambda v, i: i % 2 == parity)
    ok = box.isNotNull() & F.size(box).isin(4, 8) & ~F.exists(box, lambda v: v.isNull())
    b = F.array(F.array_min(at(0)), F.array_min(at(1)), F.array_max(at(0)), F.array_max(at(1)))
    return F.when(ok & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1))), b)


def upper_median(values: Column, default: float = 20.0) -> Column:
    v = F.array_sort(F.filter(values, lambda x: x > 0))
    return F.coalesce(F.get(v, F.floor(F.size(v) / 2).cast("int")), F.lit(default))


def visual_rows(lines: DataFrame, by: list[str]) -> DataFrame:
    """Adds box corners, median height h, band and row numbers in reading order; boxless lines follow, a row each.

    Bands part where the next centre is more than 0.35 h below; a band parts at gaps of more than 2 h between boxes.
    """
    b = lines.withColumn("box", normal_box(F.col("box")))
    for i, n in enumerate(("x1", "y1", "x2", "y2")):
        b = b.withColumn(n, F.get("box", F.lit(i)))
    pages = b.groupBy(*by).agg(upper_median(F.collect_list(F.col("y2") - F.col("y1"))).alias("h"))
    pages = pages.toDF(*[f"page_{c}" for c in by], "h")
    same = [F.col(c).eqNullSafe(F.col(f"page_{c}")) for c in by]
    b = b.join(pages, functools.reduce(lambda x, y: x & y, same)).drop(*[f"page_{c}" for c in by])
    b = b.withColumns({"free": F.col("box").isNull(), "cy": (F.col("y1") + F.col("y2")) / 2})
    down = Window.partitionBy(*by, "free").orderBy("cy", "x1", "seq")
    gap = F.col("cy") - F.lag("cy").over(down)
    b = b.withColumn("new_band", F.when(F.col("free") | gap.isNull() | (gap > 0.35 * F.col("h")), 1).otherwise(0))
    b = b.withColumn("band", F.sum("new_band").over(down))
    across = Window.partitionBy(*by, "free", "band").orderBy("x1", "seq")
    b = b.withColumn("new_row", F.when(F.lag("x2").over(across).isNull() | (F.col("x1") - F.lag("x2").over(across) > 2.0 * F.col("h")), 1).otherwise(0))
    order = Window.partitionBy(*by).orderBy("free", "band", "x1", "seq")
    return b.withColumn("row", F.sum("new_row").over(order)).withColumn("place", F.row_number().over(order)).drop("new_band", "new_row")


def merges(prev: dict[str, Column], cur: dict[str, Column], h: Column) -> Column:
    """Whether a row goes on the paragraph of the row before it, told by their first fragments."""
    boxed = prev["x1"].isNotNull() & cur["x1"].isNotNull()
    centre = lambda r: (r["x1"] + r["x2"]) / 2
    overlap = (F.least(prev["x2"], cur["x2"]) - F.greatest(prev["x1"], cur["x1"])) / F.least(prev["x2"] - prev["x1"], cur["x2"] - cur["x1"])
    aligned = (F.abs(cur["x1"] - prev["x1"]) <= 0.5 * h) | (F.abs(centre(cur) - centre(prev)) <= 0.5 * h)
    near = ~boxed | (((cur["y1"] - prev["y2"]) < 1.5 * h) & aligned & (overlap >= 0.3))
    a, b = u_trim(F.coalesce(prev["text"], F.lit(""))), u_trim(F.coalesce(cur["text"], F.lit("")))
    return near & (a != "") & (b != "") & ~a.rlike(SENTENCE_END) & ~b.rlike(BLOCK_START)


def paragraphs(lines: DataFrame, by: list[str]) -> DataFrame:
    """The paragraphs of each page in order (columns of ``by``, paragraph, text)."""
    rows = visual_rows(lines, by)
    any_box = F.max((~F.col("free")).cast("int")).over(Window.partitionBy(*by)) == 1
    rows = rows.withColumn("any_box", any_box)
    head = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by, "row").orderBy("place"))).where("k = 1")
    seen = Window.partitionBy(*by).orderBy("row")
    names = ("x1", "y1", "x2", "y2", "text")
    head = head.withColumns({f"p_{n}": F.lag(n).over(seen) for n in names})
    joins = F.col("any_box") & F.lag("row").over(seen).isNotNull() & merges({n: F.col(f"p_{n}") for n in names}, {n: F.col(n) for n in names}, F.col("h"))
    head = head.withColumn("paragraph", F.sum(F.when(joins, 0).otherwise(1)).over(seen)).select(*by, "row", "paragraph")
    placed = rows.join(head, [*by, "row"])
    ordered = F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("t"))))
    text = F.aggregate(ordered, F.lit(""), lambda a, x: join_fragments(a, x["t"]))
    return placed.groupBy(*by, "paragraph").agg(text.alias("text"))
