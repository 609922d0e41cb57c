"""Quality rules from counts of a text, and cross-document line frequency per host.

Only DataFrame functions are used. Lines are normalised (ASCII white space to one space, ends trimmed, lower case,
digits to 0) and hashed. Documents of a host (column ``host_col``) are told apart by their texts, so exact copies count
as one. A line is frequent when more distinct documents of its host hold it than ``line_share`` of the host's distinct
documents, but at least ``line_floor`` and at most ``line_docs``; hosts of any size, with any number of copies, can reach
that. Frequent lines are removed from all documents but the first (smallest id) that holds one: without this a group of
near copies, whose lines are all frequent, would be lost whole. A document is depleted, and rejected, when lines were
removed and fewer than ``left_words`` words or ``left_share`` of its words remain.

Line hashes are written once. Up to ``most_listed`` frequent lines are sent to the tasks, beyond that lines and frequent
lines meet in a shuffled join; both ways give the same rows. Only the documents that lose lines are in what is joined to
the table, and texts take part in that join only where the cleaned text is asked for.

Defined results: null and empty texts have no words, so the base rules fail them; a null host is a host of its own;
a frequent line whose documents all lack an id is removed from all; rows with a repeated id are documents like any
other; a text of any length is one row and is read whole; an empty table gives no rows. The stage hands on columns of
any name; ``judge`` gives its own columns in place of columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import SPACE_CLASS, materialise, numbered, read_table, restored, word_array

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = [*COUNTS, "base_failed", "n_removed_lines", "left_words", "kept", "clean_text"]


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def normalised_line(line: Column) -> Column:
    """The form in which lines are compared."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, SPACE_CLASS + "+", " "))), "[1-9]", "0")


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) for a column without nulls.

    n_repeat_words counts the words that lie in an 8-word window which the text holds twice or more. Windows are
    compared by 64-bit hashes; only texts in which two agree have theirs sorted.
    """
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), _has_word)
    out = df.withColumns({"__w": word_array(t), "__l": lines})
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": (F.length(t) - F.regexp_count(t, F.lit(SPACE_CLASS))).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__h": F.transform("__w", lambda w: F.xxhash64(w)),
        }
    ).drop("__w", "__l")
    starts = F.slice("__h", F.lit(1), F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0)))
    windows = F.when(
        F.size("__h") > WINDOW, F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(F.col("__h"), i + k) for k in range(1, WINDOW)]))
    )
    out = out.withColumn("__v", windows).drop("__h")
    again = F.size(F.array_distinct("__v")) < F.size("__v")
    out = out.withColumn("__s", F.when(again, F.sort_array(F.transform("__v", lambda v, i: F.struct(v.alias("v"), i.alias("i")))))).drop("__v")
    twice = F.filter("__s", lambda x, j: (x["v"] == F.get(F.col("__s"), j - 1)["v"]) | F.coalesce(x["v"] == F.get(F.col("__s"), j + 1)["v"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(places, none, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).cast("long").alias("n")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("__s").isNotNull(), total), F.lit(0)).cast("long")).drop("__s")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def line_table(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, host, copy, own and lines (hash and words of each line that holds a word) of each row.

    ``copy`` tells texts apart, ``copy`` and ``own`` together rows of different text, id or host.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    normal = F.transform(F.filter(F.split("text", "\n"), _has_word), normalised_line)
    words = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("int")
    lines = F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line"), words(x).alias("words")))
    return docs.select("id", "host", *_row_key(F.col("text"), F.col("id"), F.col("host")), lines.alias("lines"))


def _row_key(text: Column, id_: Column, host: Column) -> list[Column]:
    return [F.xxhash64(text).alias("copy"), F.xxhash64(id_, host, id_.isNull()).alias("own")]


def frequent_lines(lines: DataFrame, line_docs: int, line_share: float, line_floor: int) -> DataFrame:
    """host, line and the first document of each line above its host's limit, of a table made by ``line_table``."""
    rows = lines.select("id", "host", "copy", F.explode("lines.line").alias("line"))
    held = rows.groupBy("host", "line").agg(F.count_distinct("copy").alias("n"), F.min("id").alias("first"))
    hosts = lines.groupBy("host").agg(F.count_distinct("copy").alias("docs")).select(F.col("host").alias("of"), "docs")
    limit = F.least(F.greatest(F.col("docs") * line_share, F.lit(float(line_floor))), F.lit(float(line_docs)))
    above = held.where(F.col("n") > line_floor).join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > limit)
    return above.select(F.col("host").alias("of"), F.col("line").alias("known"), "first")


def _judged(
    df: DataFrame, id_col: str, text_col: str, host_col: str, line_docs: int, line_share: float, line_floor: int,
    left_words: int, left_share: float, most_listed: int,
) -> DataFrame:
    """The columns of ``df``, whose names must not be used here, with those of the verdict."""
    lines = materialise(line_table(df, id_col, text_col, host_col), "lines")
    frequent = materialise(frequent_lines(lines, line_docs, line_share, line_floor), "frequent-lines")
    n = frequent.count()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = base_counts(df.withColumn("__text", text), "__text")
    # A generator: no later filter on a count is moved below it, where the arrays would be made anew for each element.
    out = out.select(*[c for c in out.columns if c not in COUNTS], F.inline(F.array(F.struct(*COUNTS))))
    gone = F.lit(None).cast("array<struct<at:int,line:bigint,words:int>>")
    if n:
        met = lines.select("id", "host", "copy", "own", F.posexplode("lines").alias("at", "x"))
        met = met.select("id", "host", "copy", "own", "at", "x.line", "x.words")
        met = met.join(F.broadcast(frequent) if n <= most_listed else frequent, (F.col("line") == F.col("known")) & F.col("host").eqNullSafe(F.col("of")))
        hits = met.where(~F.col("first").eqNullSafe(F.col("id")))
        # A set, as rows alike in id, host and text all give the same.
        per = hits.groupBy(F.col("copy").alias("__c"), F.col("own").alias("__o")).agg(F.collect_set(F.struct("at", "line", "words")).alias("__gone"))
        per = materialise(per, "removed-lines")
        out = out.withColumns(dict(zip(["__copy", "__own"], _row_key(F.col("__text"), F.col(id_col).cast("long"), F.col(host_col).cast("string")))))
        out = out.join(per, (F.col("__copy") == F.col("__c")) & (F.col("__own") == F.col("__o")), "left")
        gone = F.col("__gone")
    n_gone = F.coalesce(F.array_size(gone), F.lit(0)).cast("long")
    words_gone = F.coalesce(F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0))
    clean = F.filter(
        F.split(F.col("__text"), "\n"), lambda x: ~(_has_word(x) & F.array_contains(gone["line"], F.xxhash64(normalised_line(x))))
    )
    out = out.withColumns(
        {
            "base_failed": base_failed(), "n_removed_lines": n_gone, "left_words": F.col("n_words") - words_gone,
            "clean_text": F.when(gone.isNotNull(), F.array_join(clean, "\n")).otherwise(F.col("__text")),
        }
    )
    few = (F.col("left_words") < left_words) | (F.col("left_words") < F.col("n_words") * left_share)
    depleted = (F.col("n_removed_lines") > 0) & few
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("__text", "__copy", "__own", "__c", "__o", "__gone")


def judge(
    df: DataFrame, line_docs: int = 100, line_share: float = 0.01, line_floor: int = 5, left_words: int = 20,
    left_share: float = 0.3, most_listed: int = 100_000, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """The columns of ``df`` with the base counts, base_failed, n_removed_lines, left_words, kept and clean_text."""
    inner, names = numbered(df)
    out = _judged(
        inner, names[id_col], names[text_col], names[host_col], line_docs, line_share, line_floor, left_words, left_share, most_listed
    )
    carried = [F.col(new).alias(old) for old, new in names.items() if old not in VERDICT]
    return out.select(*carried, *VERDICT)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' verdict on every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept", "n_removed_lines", "left_words")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without frequent lines; n_chars follows the text."""
    inner, names = numbered(docs)
    out = _judged(inner, names["doc_id"], names["text"], names["source"], 100, 0.01, 5, 20, 0.3, 100_000).where("kept")
    instead = {"text": F.col("clean_text")}
    if "n_chars" in names:
        instead["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return restored(out, names, **instead)
