"""Sinks that write and are read back: text files of books, page checkpoints, user dictionaries and reports.

A store that changes is a log. A change writes its own rows into a folder of its own and then claims the next number of the
log, which only one writer can have; a writer that comes second takes the number after it, so both changes are kept. Readers
see the folders of the numbers that are claimed, and of each key the newest row. When many changes have come since the last
time, one writer also writes the store as a whole, which takes the place of the changes before it. A writer that dies
leaves a folder that no number names.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_LINE = "[图片]"
BOOKS = "book string, body string"


def store_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or, on one machine, the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_block(kind: Column, text: Column, indent: Column) -> Column:
    """A block as plain text: images as a line of their own, a first indent as 1 to 8 wide spaces."""
    wide = F.repeat(F.lit("　"), F.least(F.greatest(indent, F.lit(0)), F.lit(8)).cast("int"))
    return F.when(kind == "image", IMAGE_LINE).otherwise(F.concat(wide, F.coalesce(text, F.lit(""))))


def markdown_block(kind: Column, text: Column, level: Column) -> Column:
    """A block as Markdown: headings by level, quotes line by line, list items, images without a source."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6)).cast("int")), F.lit(" "), body))
        .when(kind == "quote", F.concat(F.lit("> "), F.replace(body, F.lit("\n"), F.lit("\n> "))))
        .when(kind == "item", F.concat(F.lit("- "), body))
        .when(kind == "image", F.lit("![]()"))
        .otherwise(body)
    )


def books_of(blocks: DataFrame, shown: Column, book: str = "book", order: str = "n") -> DataFrame:
    """book and body: the blocks in order, a blank line between two."""
    placed = blocks.select(F.col(book).alias("book"), F.struct(F.col(order).alias("n"), shown.alias("x")).alias("b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["x"]), "\n\n")
    return placed.groupBy("book").agg(body.alias("body"))


def write_texts(books: DataFrame, path: str) -> None:
    """Books (columns book and body) as text, a line of JSON each, as many files as there are partitions."""
    books.select(F.col("book").cast("string").alias("book"), "body").write.option("ignoreNullFields", False).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """book and body of a folder that ``write_texts`` wrote, as they were: ids are strings, line ends and nulls stay."""
    return spark.read.schema(BOOKS).json(path)


@dataclass(frozen=True)
class Store:
    """What a store holds: its columns, those that name a row, and those by which the newest row is told."""

    schema: str
    keys: tuple[str, ...]
    newest: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def merged(self, rows: DataFrame) -> DataFrame:
        """Of each key the newest row."""
        rest = [n for n in self.names if n not in self.keys]
        found = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.newest)).alias("r"))
        return found.select(*[F.col(n) if n in self.keys else F.col(f"r.{n}") for n in self.names])


PAGES = Store("pdf string, page int, total int, status string, result string, error string, seq long", ("pdf", "page"), ("seq", "status", "result"))
DICTIONARY = Store("kind string, wrong string, fixed string, seq long", ("kind", "wrong"), ("seq", "fixed"))
#: Changes after which the store is written as a whole.
MOST_CHANGES = 16


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, path: str) -> dict[int, tuple[str, int]]:
    """The log: by number the folder and the last number that it takes the place of, or -1."""
    log, fs = _files(spark, f"{path}/log")
    found = fs.listStatus(log) if fs.exists(log) else []
    texts = {int(f.getPath().getName()): _content(spark, f.getPath(), fs) for f in found if f.getPath().getName().isdigit()}
    # A number whose writer died before it named a folder is as good as none.
    return {n: (t.split()[0], int(t.split()[1])) for n, t in sorted(texts.items()) if t.endswith("\n")}


def _content(spark: SparkSession, target, fs) -> str:
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, number: int, text: str) -> bool:
    """Make a number of the log, unless it is there; only one of several writers can."""
    target, fs = _files(spark, f"{path}/log/{number:012d}")
    fs.mkdirs(target.getParent())
    try:
        if fs.getScheme() == "file":  # there making a file that must be new is no single step in Hadoop's layer
            with open(target.toUri().getPath(), "x") as f:
                f.write(text)
            return True
        stream = fs.create(target, False)
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def _commit(spark: SparkSession, path: str, folder: str, upto: int = -1) -> int:
    number = max(_entries(spark, path), default=-1) + 1
    while not _claim(spark, path, number, f"{folder} {upto}\n"):
        number += 1
    return number


def append(rows: DataFrame, path: str, store: Store) -> None:
    """Add rows to a store; what is written is as large as they are."""
    spark, folder = rows.sparkSession, f"rows-{uuid.uuid4().hex}"
    rows.select(*store.names).write.parquet(f"{path}/{folder}")
    _commit(spark, path, folder)
    live = _live(_entries(spark, path))
    if len(live) > MOST_CHANGES:
        compact(spark, path, store)


def _live(entries: dict[int, tuple[str, int]]) -> dict[int, str]:
    """The numbers and folders that make up the store now."""
    whole = max((n for n, (_, upto) in entries.items() if upto >= 0), default=None)
    upto = entries[whole][1] if whole is not None else -1
    return {n: f for n, (f, u) in entries.items() if n == whole or (n > upto and u < 0)}


def compact(spark: SparkSession, path: str, store: Store) -> None:
    """Write a store as a whole; folders that the whole before it had replaced are deleted, so readers have time to end."""
    entries = _entries(spark, path)
    live = _live(entries)
    if not live:
        return
    folder = f"rows-{uuid.uuid4().hex}"
    store.merged(spark.read.schema(store.schema).parquet(*[f"{path}/{f}" for f in live.values()])).write.parquet(f"{path}/{folder}")
    _commit(spark, path, folder, max(live))
    for n, (f, _) in entries.items():
        if n < min(live):
            target, fs = _files(spark, f"{path}/{f}")
            fs.delete(target, True)


def read_store(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """The newest row of each key."""
    live = _live(_entries(spark, path))
    folders = [f"{path}/{f}" for f in live.values()]
    return store.merged(spark.read.schema(store.schema).parquet(*folders)) if folders else spark.createDataFrame([], store.schema)


def save_pages(spark: SparkSession, path: str, pages: DataFrame) -> None:
    """Add rows to a checkpoint: of each page of a book the row of the greatest seq counts."""
    append(pages, path, PAGES)


def resume_pages(spark: SparkSession, path: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the pages wanted (pdf, page and total): those that are done, with their results, and those that are still to do.

    A checkpoint of another file, or of one with another number of pages, is not used.
    """
    done = read_store(spark, path, PAGES).where("status = 'done' AND coalesce(result, '') <> ''")
    return wanted.join(done, ["pdf", "page", "total"]), wanted.join(done, ["pdf", "page", "total"], "left_anti")


def save_dictionary(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Accepted fixes (kind ``fix``) and words to ignore (kind ``ignore``): the newest of each word stays.

    Saving the same changes again changes nothing.
    """
    append(changes, path, DICTIONARY)


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Fixes (wrong, fixed) and words to ignore (word), in order of the words."""
    rows = read_store(spark, path, DICTIONARY)
    return rows.where("kind = 'fix'").select("wrong", "fixed").sort("wrong"), rows.where("kind = 'ignore'").select(F.col("wrong").alias("word")).sort("word")


def write_report(results: DataFrame, path: str, by: list[str]) -> None:
    """A Markdown table and one JSON line a row, in order of ``by``."""
    names = results.columns
    line = F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names]), " | "), F.lit(" |"))
    head = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    rows = results.sort(*by).select(line.alias("value"))
    top = results.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1)
    top.union(rows.coalesce(1)).coalesce(1).write.text(f"{path}/table")
    results.sort(*by).coalesce(1).write.json(f"{path}/results")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(f"{path}/table")
