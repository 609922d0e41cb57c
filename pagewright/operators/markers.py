"""Editors' marks in corrected pages: where an article ends, which paragraphs are one, and where notes belong.

Marks are empty elements in a paragraph's HTML. A paragraph mark at its start joins a paragraph to the one before it, at
its end to the one after it. An article mark ends the article; what follows in the paragraph begins the next. Note marks
are replaced by the notes of the book, one by one in order, in wide brackets; without note marks notes stay where they
are, and where their numbers differ the book has an error and no articles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.names import CLASS_PREFIX

ARTICLE, PARAGRAPH, NOTE = (f'<span data-marker="{n}"></span>' for n in ("article", "paragraph", "note"))
NOTE_CLASS = f'class="{CLASS_PREFIX}note"'


def _quoted(mark: str) -> str:
    return f"\\Q{mark}\\E"


def _bracketed(text):
    """A note for the running text: one pair of wide brackets around it, none but wide ones inside."""
    bare = F.translate(F.trim(F.regexp_replace(text, "</?p\\b[^>]*>", "")), "()", "（）")
    own = F.startswith(bare, F.lit("（")) & F.endswith(bare, F.lit("）"))
    return F.concat(F.lit(f'<span class="{CLASS_PREFIX}note-inline">'), F.when(own, bare).otherwise(F.concat(F.lit("（"), bare, F.lit("）"))), F.lit("</span>"))


def apply_markers(rows: DataFrame) -> DataFrame:
    """book, article (from 0), body (paragraphs by line) and error of paragraphs (book, page, n, html)."""
    order = Window.partitionBy("book").orderBy("page", "n")
    mark = lambda c: F.trim(F.col(c))
    placed = rows.select("book", F.row_number().over(order).alias("at"), F.coalesce("html", F.lit("")).alias("html"))
    down = Window.partitionBy("book").orderBy("at")
    before = F.lag(mark("html")).over(down)
    joined = F.startswith(mark("html"), F.lit(PARAGRAPH)) | F.endswith(before, F.lit(PARAGRAPH))
    grouped = placed.withColumn("part", F.sum(F.when(before.isNotNull() & joined, 0).otherwise(1)).over(down))
    pieces = F.array_sort(F.collect_list(F.struct("at", F.replace("html", F.lit(PARAGRAPH), F.lit("")).alias("x"))))
    whole = grouped.groupBy("book", "part").agg(F.array_join(F.transform(pieces, lambda p: p["x"]), "").alias("html"))
    whole = whole.withColumn("is_note", F.contains("html", F.lit(NOTE_CLASS)))
    # Notes and their marks are numbered through the book.
    through = Window.partitionBy("book").orderBy("part")
    marks = F.when(F.col("is_note"), 0).otherwise(F.size(F.split("html", _quoted(NOTE))) - 1)
    counted = whole.withColumn("marks", marks).withColumns(
        {"first_mark": F.sum("marks").over(through) - F.col("marks"), "note": F.sum(F.col("is_note").cast("int")).over(through)}
    )
    book = Window.partitionBy("book")
    counted = counted.withColumns({"n_marks": F.sum("marks").over(book), "n_notes": F.max("note").over(book)})
    wrong = (F.col("n_marks") > 0) & (F.col("n_marks") != F.col("n_notes"))
    error = F.when(wrong, F.concat(F.col("n_marks").cast("string"), F.lit(" note marks, "), F.col("n_notes").cast("string"), F.lit(" notes")))
    counted = counted.withColumn("error", error)
    notes = counted.where("is_note and n_marks > 0 and error is null").select(F.col("book").alias("b"), F.col("note").alias("number"), _bracketed(F.col("html")).alias("said"))
    shown = counted.where("not is_note or n_marks = 0").select("book", "part", "error", "first_mark", F.posexplode(F.split("html", _quoted(NOTE))).alias("k", "x"))
    filled = shown.join(notes, F.col("book").eqNullSafe(F.col("b")) & (F.col("first_mark") + F.col("k") == F.col("number")) & (F.col("k") > 0), "left")
    text = F.array_sort(F.collect_list(F.struct("k", F.concat(F.coalesce("said", F.lit("")), "x").alias("t"))))
    full = filled.groupBy("book", "part", "error").agg(F.array_join(F.transform(text, lambda p: p["t"]), "").alias("html"))
    # Article marks cut what is by now one paragraph.
    cut = full.select("book", "part", "error", F.posexplode(F.split("html", _quoted(ARTICLE))).alias("k", "x"))
    number = F.sum((F.col("k") > 0).cast("int")).over(Window.partitionBy("book").orderBy("part", "k"))
    bodies = F.array_sort(F.collect_list(F.struct("part", "k", "x")))
    out = cut.withColumn("article", number).where("trim(x) <> ''").groupBy("book", "article", "error").agg(F.array_join(F.transform(bodies, lambda p: p["x"]), "\n").alias("body"))
    failed = F.col("error").isNotNull()
    return out.select("book", F.when(~failed, F.col("article")).alias("article"), F.when(~failed, F.col("body")).alias("body"), "error").distinct()
