"""Filter interaction audit: what each filter removes in every order of the filters, from one count per failure mask.

Every document gets a mask with a bit per filter that it fails. Masks are counted per part, so all that follows has one
row per part. A subset-zeta transform (for each bit, a cell with the bit adds the cell without it) turns the counts into
the documents whose failures lie within a set of filters; the survivors of a set of filters are those whose failures lie
within the others. What a step of an order removes is the difference between the survivors before and after it, for all
documents as for those of a label, and a filter's Shapley sum is the same difference weighed by the number of orders.

A document is a copy when a document of a smaller id anywhere in the table has the same text. Texts are told apart by two
64-bit hashes. The smallest id of each text meets the documents on text and id together, so a text on a third of all rows
is spread like any other; rows alike are counted as one before that.

Defined results: a null text is an empty one; a null part is the empty string; rows without an id are copies of none, have
no label and make no other row a copy; rows of one id and text are not copies of each other; a label holds for an id when any of
its rows says so; texts of any length are read whole; columns of other names do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import discard, materialise, read_table

MEASURES = ("n", "good", "toxic")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
#: Bytes that go on a code point in UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))


def failed_mask(raw: bytes) -> int:
    """Bits 0 to 3 for the filters A to D that a text in UTF-8 fails. White space is ASCII's, as in ``bytes.split``."""
    words = raw.split()
    n, signs = len(words), len(raw) - len(raw.translate(None, CONTINUED))
    upper = len(raw) - len(raw.translate(None, CAPITALS))
    held = len(raw.translate(None, MARKS)) < len(raw)
    return (n < 200) + 2 * (100 * len(set(words)) < 50 * n) + 4 * (100 * upper > 2 * (len(raw) - signs)) + 8 * held


def text_failures(text: Column) -> Column:
    """``failed_mask`` of a column without nulls, in batches."""

    @F.arrow_udf("int")
    def masks(texts: pa.Array) -> pa.Array:
        return pa.array([failed_mask(x) for x in texts.cast(pa.large_binary()).to_pylist()], pa.int32())

    return masks(text)


def mask_counts(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, copy_bit: int) -> DataFrame:
    """part, mask, n, good and toxic: documents by the filters that they fail, bit i of a mask for filter i.

    The bits of a text are those of ``text_failures``, ``copy_bit`` is that of copies. The narrow rows are written, so that
    texts are read once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col).cast("long")
    # Without an id a row is nobody's copy, so its text does not matter.
    keys = [F.when(id_.isNotNull(), h).alias(k) for k, h in (("k1", F.xxhash64(text)), ("k2", F.xxhash64(F.lit(1), text)))]
    rows = df.select(id_.alias("id"), *keys, F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"))
    rows = materialise(rows, "masks", batch_rows=500)
    alike = rows.groupBy("id", "k1", "k2", "part", "mask").agg(F.count("*").alias("n"))
    firsts = rows.where("id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    out = alike.join(firsts, ["k1", "k2", "id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 1 << copy_bit).otherwise(0))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(says("quality").alias("q"), says("toxic").alias("x"))
    out = out.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).join(marked, "id", "left")
    label = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    counts = out.groupBy("part", "mask").agg(F.sum("n").alias("n"), label("q").alias("good"), label("x").alias("toxic"))
    done = materialise(counts, "mask-counts")
    discard(rows)
    return done


def survivors(counts: DataFrame, k: int) -> DataFrame:
    """part and, for each measure, an array: documents whose failures lie within the set of filters that the place names."""
    cell = lambda m, i: F.coalesce(F.sum(F.when(F.col("mask") == i, F.col(m))), F.lit(0)).cast("long")
    out = counts.groupBy("part").agg(*[F.array(*[cell(m, i) for i in range(1 << k)]).alias(m) for m in MEASURES])
    for bit in (1 << i for i in range(k)):
        zeta = lambda m, bit=bit: F.transform(m, lambda v, i: v + F.when(i.bitwiseAND(bit) != 0, F.get(F.col(m), i - bit)).otherwise(0))
        out = out.select("part", *[zeta(m).alias(m) for m in MEASURES])
    return out


def audit(counts: DataFrame, filters: list[str]) -> DataFrame:
    """The report on every order and step: part, filter_order, step, filter and the counts of that step.

    ``counts`` as ``mask_counts`` gives them. Filters have names of one letter; there are k! orders of k steps per part.
    """
    k = len(filters)
    every, all_ = (1 << k) - 1, survivors(counts, k)
    at = lambda m, failing: F.get(F.col(m), failing)
    left = lambda m, applied: at(m, every - applied)
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(filters)])
    out = all_.withColumn("filter_order", F.explode(orders))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    out = out.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bits = F.create_map(*[F.lit(v) for i, f in enumerate(filters) for v in (f, 1 << i)])
    earlier = F.slice(F.split("filter_order", "(?!^)"), F.lit(1), F.col("step") - 1)
    applied = F.aggregate(earlier, F.lit(0), lambda a, c: a + F.element_at(bits, c))
    out = out.withColumn("before", applied).withColumn("bit", F.element_at(bits, F.col("filter")))
    out = out.withColumn("after", F.col("before") + F.col("bit"))
    lost = lambda m, before, own: left(m, before) - left(m, before + own)
    weigh = lambda s: math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())
    shares = [F.when(F.col("bit").bitwiseAND(s) == 0, lost("n", F.lit(s), F.col("bit")) * weigh(s)).otherwise(0) for s in range(every)]
    removed = lost("n", F.col("before"), F.col("bit"))
    return out.select(
        "part", "filter_order", "step", "filter", left("n", F.col("after")).alias("kept"), removed.alias("removed"),
        (left("n", F.lit(0)) - left("n", F.col("bit")) - removed).alias("redundant"), lost("n", every - F.col("bit"), F.col("bit")).alias("unique_fails"),
        lost("good", F.col("before"), F.col("bit")).alias("good_lost"), lost("toxic", F.col("before"), F.col("bit")).alias("toxic_lost"),
        sum(shares, F.lit(0)).cast("long").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents, per source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counts = mask_counts(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "source", copy_bit=4)
    return audit(counts, list("ABCDE")).drop("filter")
