"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Each task packs the pieces that it has, longest first, into the fullest sequence that still has room; of more than
``WINDOW`` pieces it packs so many at a time. Sequences that are nearly full are final. The others go up a tree as items
of their fill: groups of tasks merge the underfull sequences of their members by further best-fit rounds, and what is
nearly full by then is final. A node of more than ``fan_in * carry`` items is dealt by hash into parts of about that
size, so that memory is bounded; all underfull sequences go up, whatever their number.

What is still underfull at the root cannot be filled by whole sequences, as where one task held long pieces and another
those that would fill the gaps. A last round deals these sequences by hash into parts, packs their pieces anew, and
keeps the outcome of a part where it needs fewer sequences.

Only documents longer than a sequence are cut: their first piece takes the remainder, all others are full.

Defined results: a null or empty text is a document of the end id alone; a text of any length is cut into pieces of one
row each; rows with a null or repeated doc_id are documents like any other (rows alike in all columns give rows alike in
doc_id and piece); an empty table gives no rows. Columns other than the two named ones, whatever their names, are not
read.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import discard, materialise, read_table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"
#: Bins that one task may number.
TASK_BINS = 1 << 40
#: Pieces that a task holds before it packs them.
WINDOW = 200_000
#: Rows of a batch of texts, and bytes of those that are encoded at a time.
BATCH_ROWS = 1000
SLICE = 2 << 20


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Pack items in the given order, each into the fullest bin with room; ties go to the newest bin.

    Gives each item's bin and offset, and each bin's fill.
    """
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: some bin has a gap of g
    bins, offsets, fill = [], [], []
    for n in lengths:
        fits = gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            b, gap = len(fill), capacity
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        if gap > n:
            by_gap[gap - n].append(b)
            gaps |= 1 << (gap - n)
    return bins, offsets, fill


def pack_documents(
    df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, slack: int = 4, carry: int = 8192, fan_in: int = 8,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Tokenise whole texts, cut the longer ones and give every piece its sequence and its place in it.

    The result has doc_id, piece, start, length, ids_crc32, sequence_id and offset. Sequences have no gaps and
    hold at most ``capacity`` ids.
    """
    spark = df.sparkSession

    def cut(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        from pagewright.llm.encoding import encoder, slices, trim

        trim()
        encode = encoder(tokenizer).encode
        end = struct.pack("<I", end_id)
        number = TaskContext.get().partitionId() * TASK_BINS
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def packed(held):
            nonlocal number
            held.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[4]))
            bins, offsets, fill = best_fit([r[3] for r in held], capacity)
            rows = [r + (number + b, at, capacity - fill[b] > slack) for r, b, at in zip(held, bins, offsets)]
            number += len(fill)
            return [rows[i : i + 20_000] for i in range(0, len(rows), 20_000)]

        held: list[tuple] = []
        for given in batches:
            for some in slices(given, SLICE):
                full = []
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    ids += end
                    total = len(ids) // 4
                    first = total % capacity or capacity
                    cuts = [0, *range(first, total + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row = (doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))
                        if b - a == capacity:
                            full.append((*row, number, 0, False))
                            number += 1
                        else:
                            held.append(row)
                if full:
                    yield batch(full)
                if len(held) >= WINDOW:
                    yield from map(batch, packed(held))
                    held = []
        if held:
            yield from map(batch, packed(held))

    plain = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(plain.mapInArrow(cut, PIECES), "pieces", BATCH_ROWS)
    loose = pieces.where("open")
    tasks = (loose.agg(F.max("sequence_id")).first()[0] or 0) // TASK_BINS + 1
    # Where each underfull sequence of a task has gone so far: its sequence by now, and its place in that.
    gone = materialise(loose.groupBy(F.col("sequence_id").alias("own")).agg(F.sum("length").alias("fill")).select("own", F.col("own").alias("now"), F.lit(0).cast("long").alias("shift"), F.col("fill"), F.lit(True).alias("open")), "underfull")
    width = fan_in
    while True:
        items = gone.where("open and shift = 0 and own = now").select(F.col("now").alias("item"), "fill")
        dealt = _dealt(items.withColumn("node", F.expr(f"item div {TASK_BINS * width}")), fan_in * carry)
        merged = materialise(dealt.groupBy("node", "part").applyInArrow(_merge(capacity, slack), "item long, bin long, at long, total long, still boolean"), "merged")
        moved = gone.join(merged, F.col("now") == F.col("item"), "left")
        after = moved.select(
            "own", F.coalesce("bin", "now").alias("now"), (F.col("shift") + F.coalesce("at", F.lit(0))).alias("shift"),
            F.coalesce("total", "fill").alias("fill"), F.coalesce("still", "open").alias("open"),
        )
        after = materialise(after, "underfull")
        discard(gone, merged)
        gone = after
        if width >= tasks:
            break
        width *= fan_in
    placed = loose.join(gone.withColumnRenamed("open", "still"), F.col("sequence_id") == F.col("own")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("now").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"), "still"
    )
    placed = materialise(placed, "placed")
    left = placed.where("still")
    parts = max(1, -(-left.count() // (fan_in * carry)))
    left = left.withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(parts)))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    again = left.groupBy("part").applyInArrow(_repack(capacity), columns)
    names = [c.split()[0] for c in columns.split(", ")]
    return pieces.where("not open").select(names).unionByName(placed.where("not still").select(names)).unionByName(again)


def _dealt(items: DataFrame, most: int) -> DataFrame:
    """Items with the part of their node, of about ``most`` items, that a hash deals them to."""
    parts = items.groupBy(F.col("node").alias("of")).agg(F.ceil(F.count("*") / most).alias("parts"))
    return items.join(F.broadcast(parts), F.col("node") == F.col("of")).drop("of").withColumn("part", F.pmod(F.xxhash64("item"), "parts"))


def _merge(capacity: int, slack: int):
    """A node of the tree, or a part of it: one best-fit round over underfull sequences, each as a whole.

    A sequence takes the number of the fullest that is merged into it, which stands at its start.
    """

    def merge(table):
        import pyarrow as pa

        table = table.sort_by([("fill", "descending"), ("item", "ascending")])
        items = table["item"].to_pylist()
        bins, offsets, fill = best_fit(table["fill"].to_pylist(), capacity)
        first: dict[int, int] = {}
        for item, b in zip(items, bins):
            first.setdefault(b, item)
        total = [fill[b] for b in bins]
        return pa.table({"item": items, "bin": [first[b] for b in bins], "at": offsets, "total": total, "still": [capacity - n > slack for n in total]})

    return merge


def _repack(capacity: int):
    """A part of what is underfull at the root: its pieces packed anew, if that takes fewer sequences."""

    def repack(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        table = table.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        bins, offsets, fill = best_fit(table["length"].to_pylist(), capacity)
        names = pc.unique(table["sequence_id"]).to_pylist()
        if len(fill) < len(names):
            table = table.set_column(5, "sequence_id", pa.array([names[b] for b in bins], pa.int64()))
            table = table.set_column(6, "offset", pa.array(offsets, pa.int64()))
        return table

    return repack


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
