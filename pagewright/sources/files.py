"""File rows (path, content) and what their bytes tell: kinds, hashes, sizes and cached splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length and content of files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def _head(content: Column, n: int) -> Column:
    return F.hex(F.substring(content, 1, n))


def is_pdf(content: Column) -> Column:
    """The PDF mark within the first 1024 bytes (whole bytes of the hex form)."""
    at = F.instr(_head(content, 1024), "255044462D")
    return (at > 0) & (at % 2 == 1)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def image_mime(content: Column) -> Column:
    """The kind of image by its first bytes; JPEG where none fits."""
    h = _head(content, 12)
    starts = lambda x: F.startswith(h, F.lit(x))
    webp = starts("52494646") & (F.substring(h, 17, 8) == "57454250")
    return F.when(starts("89504E470D0A1A0A"), "image/png").when(starts("FFD8FF"), "image/jpeg").when(starts("474946383761") | starts("474946383961"), "image/gif").when(webp, "image/webp").when(starts("424D"), "image/bmp").otherwise("image/jpeg")


def png_size(content: Column) -> Column:
    """width and height from a PNG's header; null for other content."""
    num = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(_head(content, 8) == "89504E470D0A1A0A", F.struct(num(17).alias("width"), num(21).alias("height")))


def jpeg_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from a JPEG's frame header."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + (int.from_bytes(data[at + 2 : at + 4], "big") if kind not in (0xD8, 0x01, 0xFF, *range(0xD0, 0xD8)) else 0)
    return None


def as_base64(content: Column) -> Column:
    return F.base64(content)


def reusable_splits(wanted: DataFrame, cached: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (sha, dpi, fmt, prep) that a cached split (also: split, pages) meets with all of its page files.

    ``files``: split and page of the files that are there.
    """
    hits = wanted.join(cached, ["sha", "dpi", "fmt", "prep"])
    needed = hits.select("split", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page")).distinct()
    broken = needed.join(files, ["split", "page"], "left_anti").select("split").distinct()
    return hits.join(broken, "split", "left_anti")


def infer_pages(df: DataFrame, infer, image: str = "content", key: str = "img", page: str = "page") -> DataFrame:
    """img, page, result and error of ``infer(bytes) -> str`` on each row; an exception is a row's error, not the job's."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, p, data in zip(pdf[key], pdf[page], pdf[image]):
                try:
                    rows.append((k, p, infer(bytes(data)), None))
                except Exception as e:  # whatever a backend raises is that page's result
                    rows.append((k, p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["img", "page", "result", "error"])

    return df.select(key, page, image).mapInPandas(run, f"img {df.schema[key].dataType.simpleString()}, page {df.schema[page].dataType.simpleString()}, result string, error string")


def fake_backend(data: bytes) -> str:
    """A stand-in for a recognition backend, for queries and tests: the number of bytes; pages that begin with x fail."""
    if data[:1] == b"x":
        raise ValueError("not a page")
    return str(len(data))


def bench_sources(pages: DataFrame, least: int = 2) -> DataFrame:
    """dir, dpi and pages of the folders of split pages (dir, dpi, name) with at least two PNGs, finest first."""
    images = pages.where(F.lower("name").endswith(".png") & (F.col("dpi") > 0))
    return images.groupBy("dir", "dpi").agg(F.count("*").alias("pages")).where(F.col("pages") >= least).sort(F.desc("dpi"), F.desc("pages"), "dir")
