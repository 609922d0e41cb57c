"""Operators over page rows: page specifications, resume joins, ordered aggregates, versions, samples and waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import WS, running, u_trim


def page_numbers(spec: Column) -> Column:
    """The pages of a list such as ``1-15, 17``: ranges may be reversed, what is not a page is left out."""
    def pages(part):
        p = u_trim(part)
        a, b = F.regexp_extract(p, r"^([0-9]{1,9})(?:[WS]*-[WS]*([0-9]{1,9}))?$".replace("WS", WS), 1), F.regexp_extract(p, r"^[0-9]{1,9}[WS]*-[WS]*([0-9]{1,9})$".replace("WS", WS), 1)
        lo = a.try_cast("int")
        hi = F.coalesce(b.try_cast("int"), lo)
        return F.when(lo.isNotNull(), F.sequence(F.least(lo, hi), F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    all_pages = F.flatten(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), pages))
    return F.array_sort(F.array_distinct(F.filter(all_pages, lambda n: n >= 1)))


def included_pages(spec: Column) -> Column:
    """As ``page_numbers``, null for all pages: nothing, ``all``, ``*`` or no valid page given."""
    s = F.lower(u_trim(F.coalesce(spec, F.lit(""))))
    n = page_numbers(spec)
    return F.when(~s.isin("", "all", "*", "全部") & (F.size(n) > 0), n)


def exclusion(given: Column, configured: Column) -> Column:
    """The given specification unless it is blank."""
    return F.coalesce(F.when(u_trim(given) != "", given), configured)


def pages_to_do(pages: DataFrame, cached: DataFrame, excluded: DataFrame, on: list[str]) -> DataFrame:
    """Pages that are neither done nor left out."""
    return pages.join(cached.select(*on), on, "left_anti").join(excluded.select(*on), on, "left_anti")


def merge_results(cached: DataFrame, fresh: DataFrame, excluded: DataFrame, on: list[str]) -> DataFrame:
    """Old and new texts, the new ones first choice; pages left out are empty."""
    both = cached.withColumnRenamed("text", "old").join(fresh.withColumnRenamed("text", "new"), on, "full_outer")
    gone = excluded.select(*on).distinct().withColumn("gone", F.lit(True))
    return both.join(gone, on, "left").select(*on, F.when(F.col("gone"), "").otherwise(F.coalesce("new", "old")).alias("text"))


def finished_pages(progress: DataFrame) -> DataFrame:
    """page and text of the done pages of checkpoint rows with a column pages (a map by page number as text)."""
    rows = progress.select("*", F.explode("pages").alias("key", "entry"))
    page = F.col("key").try_cast("int")
    return rows.where((F.col("entry.status") == "done") & (F.coalesce(F.col("entry.result"), F.lit("")) != "") & page.isNotNull()).select(*[c for c in progress.columns if c != "pages"], page.alias("page"), F.col("entry.result").alias("text"))


def joined_text(rows: DataFrame, by: str, order: str, text: str, sep: str, skip_blank: bool = False) -> DataFrame:
    """The texts of each group, joined in order (ties: by text)."""
    kept = rows.where(u_trim(F.col(text)) != "") if skip_blank else rows
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return kept.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), sep).alias("body"))


def newest(rows: DataFrame, by: str, updated: str, tie: str) -> DataFrame:
    """Numbers a group's versions from the newest, 1, on; those without a time come last, ties go by ``tie``."""
    at = F.col(updated)
    since = F.unix_micros(at.cast("timestamp")) if dict(rows.dtypes)[updated].startswith("timestamp") else at
    keyed = rows.withColumns({"no_time": at.isNull(), "since": -since})
    return with_group_number(keyed, by, ["no_time", "since", tie], "version").drop("no_time", "since")


def even_sample(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """At most n rows of each group: of m rows in order those at the places floor(i * (m / n)) from 0, in doubles."""
    sizes = rows.groupBy(F.col(by).alias("of")).agg(F.count("*").alias("total"))
    placed = with_group_number(rows, by, [order], "at").join(sizes, F.col(by).eqNullSafe(F.col("of")))
    step = F.col("total") / F.lit(float(n))
    near = F.ceil((F.col("at") - 1) / step)
    hit = lambda i: (i >= 0) & (i < n) & (F.floor(i * step) == F.col("at") - 1)
    return placed.where((F.col("total") <= n) | hit(near - 1) | hit(near) | hit(near + 1)).drop("at", "total", "of")


def waves(rows: DataFrame, by: str, width: str, height: str, order: str, k: int) -> DataFrame:
    """Pages of like size in waves of k: by width, then height, unknown sizes last, ties in input order."""
    known = F.col(width).isNotNull() & F.col(height).isNotNull()
    keyed = rows.withColumns({"no_size": ~known, "size_w": F.when(known, F.col(width)), "size_h": F.when(known, F.col(height))})
    out = with_group_number(keyed, by, ["no_size", "size_w", "size_h", order], "wave")
    return out.withColumn("wave", F.floor((F.col("wave") - 1) / max(k, 1)).cast("long")).drop("no_size", "size_w", "size_h")


def worker_count(explicit: Column, of_model: Column, default: int = 3) -> Column:
    """How many pages to recognise at a time: what was asked for, else the model's number, both from 1 to 64."""
    asked = lambda c: F.when(c.between(1, 64), c.cast("int"))
    return F.coalesce(asked(explicit), asked(of_model), F.lit(default))


def truncation_cause(completion: Column, prompt: Column, most: Column, context: Column) -> Column:
    """Why an answer was cut, told by counts of tokens: ``limit``, ``context`` or null."""
    return F.when(completion >= most, "limit").when(prompt + completion >= context, "context")


def newest_of_open(opened: DataFrame, live: DataFrame) -> DataFrame:
    """The pages that are open (book, page, version) with the newest live row that is newer than what they show."""
    newest = live.groupBy(F.col("book").alias("b"), F.col("page").alias("p")).agg(F.max_by(F.struct("version", "text"), "version").alias("r"))
    joined = opened.join(newest, F.col("book").eqNullSafe(F.col("b")) & (F.col("page") == F.col("p")))
    return joined.where("version is null or r.version > version").select("book", "page", "r.version", "r.text")


def pruned_log(rows: DataFrame, by: str, order: str, keep: int = 30) -> DataFrame:
    """The newest rows of each group; no group is held in memory whole."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).drop("place")


def throttled(writes: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Of the state writes of each job (job, seq, now) those that are made: the first, then one when at least so many
    seconds have gone since the one before, and the last."""
    seen = F.array_sort(F.collect_list(F.struct("seq", "now")))
    zero = lambda a: F.struct(F.lit(None).cast("double").alias("at"), F.lit(False).alias("made"), F.lit(None).cast("long").alias("seq"))

    def step(last, x):
        due = last["at"].isNull() | (x["now"] - last["at"] >= seconds)
        return F.struct(F.when(due, x["now"]).otherwise(last["at"]).alias("at"), due.alias("made"), x["seq"].cast("long").alias("seq"))

    folded = writes.groupBy("job").agg(seen.alias("w")).withColumn("r", running(F.col("w"), zero(None), step))
    made = F.filter("r", lambda x, i: x["made"] | (i == F.size("r") - 1))
    return folded.select("job", F.explode(made).alias("x")).select("job", "x.seq")


#: Rows for which a range of their own is worth its cost, and bounds that are compared at a time.
RANGE_ROWS, STEP = 1 << 14, 16


def _ranged(df: DataFrame, order: list[str], parts: int, sampled: int, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``range``, the number of a range of rows in the order of some columns, with bounds from a hash sample of keys."""
    total = df.count()
    parts = min(parts, -(-total // rows))
    keyed = df.withColumn("range_key", F.struct(*order))
    if parts < 2:
        return keyed.withColumn("range", F.lit(0)).drop("range_key")
    some = keyed.where(F.pmod(F.xxhash64(*order), F.lit(max(1, total // sampled))) == 0).select("range_key").distinct().sort("range_key").toArrow()
    n = some.num_rows
    bounds = some.take(sorted({n * k // parts for k in range(1, parts)} - {0}))["range_key"].to_pylist() if n else []
    kinds = dict(keyed.dtypes)["range_key"]
    listed = lambda of: F.array(*[F.struct(*[F.lit(b[c]).alias(c) for c in order]) for b in of]).cast(f"array<{kinds}>")
    below = lambda some: F.size(F.filter(some, lambda b: b <= F.col("range_key")))
    # Every sixteenth bound first, then those after the last that is not above the key.
    coarse = keyed.withColumn("range_step", below(listed(bounds[::STEP])))
    fine = (F.col("range_step") - 1) * STEP + below(F.slice(listed(bounds), (F.col("range_step") - 1) * STEP + 1, F.lit(STEP)))
    return coarse.withColumn("range", F.when(F.col("range_step") > 0, fine).otherwise(0)).drop("range_key", "range_step")


def with_group_number(df: DataFrame, by: str, order: list[str], name: str, parts: int = 256, sampled: int = 20_000, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the place of each row, from 1, within its group in the order of some columns; a task sees a range of a group.

    How many rows of a group lie in earlier ranges is counted per group and range, and joined by both.
    """
    ranged = _ranged(df, [by, *order], parts, sampled, rows)
    sizes = ranged.groupBy(F.col(by).alias("range_of"), F.col("range").alias("range_at")).count()
    earlier = Window.partitionBy("range_of").orderBy("range_at").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("range_of", "range_at", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("range_begins"))
    met = ranged.join(begins, F.col(by).eqNullSafe(F.col("range_of")) & (F.col("range") == F.col("range_at")))
    place = F.row_number().over(Window.partitionBy(by, "range").orderBy(*order)) + F.col("range_begins")
    return met.withColumn(name, place.cast("long")).drop("range", "range_of", "range_at", "range_begins")


def with_global_number(df: DataFrame, order: list[str], name: str, parts: int = 256, sampled: int = 20_000) -> DataFrame:
    """Adds the place of each row, from 1, in the order of some columns, without one task that sees all rows.

    The sizes of the ranges (``parts`` numbers at most, on the driver) give where each begins.
    """
    ranged = _ranged(df, order, parts, sampled)
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    starts, at = [], 0
    for k in range(parts + 1):
        starts.append(at)
        at += sizes.get(k, 0)
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.get(F.array(*[F.lit(x) for x in starts]), F.col("range"))
    return ranged.withColumn(name, place.cast("long")).drop("range")
