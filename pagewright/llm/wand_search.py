"""Ranked lexical search: WAND over shards of documents, whose heaps are merged.

A pass over the documents counts in each text the terms that any item asks for, and all its terms; this table of postings
is written once. Its partitions are the shards. A task turns a stretch of its shard into posting lists with the impact of
each posting and the highest impact of each term, and walks them for every item: the cursors are kept in order of their
documents, the pivot is the first document at which the highest impacts of the cursors so far reach the worst score
of a full heap, and cursors before it move to it by bisection, so that documents which cannot enter the heap are never
scored. Heaps go on from stretch to stretch. What the shards' heaps hold is ranked once more; a shard sends at most
``k`` rows for an item.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A to Z as a to z. Items are dealt
into blocks of about ``block_chars`` characters, so what goes to the tasks is bounded by that (terms, weights, items of a
block), however many items there are; each block is searched over all documents.

Defined results: null and empty texts have no term and count nowhere; every row is a document, so rows that share an id
are ranked each; a null id comes last among equal scores; items alike in id and text are one, items of one id and
different texts are ranked apart; an item without a hit has no row; texts of any length are read whole; other columns do
not matter; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import collected, discard, materialise, read_table

#: Bytes of a text as they are compared: capitals as small letters, what parts terms as a blank.
FOLDED = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: Postings that a task holds as lists at a time.
STRETCH = 1_000_000
POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
HITS = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(FOLDED).split()


def _postings(vocabulary) -> object:
    """Batches of doc_id and text to batches of ``POSTINGS``; documents without a term are left out."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = vocabulary.value
        for batch in it:
            ids, ns, ends, terms, tfs = [], [], [0], [], []
            for id_, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                words = terms_of(raw)
                if words:
                    found = Counter(map(places.__getitem__, filter(places.__contains__, words)))
                    terms += found.keys()
                    tfs += found.values()
                    ids.append(id_)
                    ns.append(len(words))
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], schema=POSTINGS)

    return batches


class Lists:
    """Posting lists of a stretch of documents: places of documents, impacts, and the highest impact of each term."""

    def __init__(self, ids: list, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, words: int):
        norm = 25 + 75 * n * documents // words
        impact = weights[term] * (10**9 * tf // (1000 * tf + 8 * norm[doc]))
        kept = np.flatnonzero(impact > 0)
        kept = kept[np.argsort(term[kept], kind="stable")]  # documents stay in order within a term
        cuts = np.flatnonzero(np.diff(term[kept], prepend=-1))
        self.ids, self.of = ids, {}
        for a, b in zip(cuts, [*cuts[1:], len(kept)]):
            hits = kept[a:b]
            self.of[int(term[hits[0]])] = (doc[hits].tolist(), impact[hits].tolist(), int(impact[hits].max()))


def walk(lists: Lists, item: list[tuple[int, int]], heap: list[tuple], k: int) -> int:
    """Bring a heap of (score, tie, doc_id), worst first, up to date for the terms and repeats of an item.

    Returns how many documents were scored.
    """
    found = [(*lists.of[t], r) for t, r in item if t in lists.of]
    docs, impacts, tops, repeats = ([x[0] for x in found], [x[1] for x in found], [x[2] * x[3] for x in found], [x[3] for x in found])
    at = [0] * len(found)
    cursors = sorted((d[0], j) for j, d in enumerate(docs))
    least, scored = heap[0][0] if len(heap) == k else 1, 0
    while cursors:
        bound = 0
        for pivot, j in cursors:
            bound += tops[j]
            if bound >= least:
                break
        else:
            break  # all cursors together cannot reach the heap
        moved = cursors[: bisect_left(cursors, (pivot, -1))]
        if moved:
            for _, j in moved:
                at[j] = bisect_left(docs[j], pivot, at[j])
        else:
            moved = cursors[: bisect_left(cursors, (pivot + 1, -1))]
            score = 0
            for _, j in moved:
                score += impacts[j][at[j]] * repeats[j]
                at[j] += 1
            scored += 1
            id_ = lists.ids[pivot]
            entry = (score, -(2**64) if id_ is None else -id_, id_ if id_ is not None else 0, id_ is None)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            least = heap[0][0] if len(heap) == k else 1
        del cursors[: len(moved)]
        for _, j in moved:
            if at[j] < len(docs[j]):
                insort(cursors, (docs[j][at[j]], j))
    return scored


def _searched(items, weights, documents: int, words: int, k: int) -> object:
    """Batches of ``POSTINGS``, the rows of a shard, to the shard's best hits for each item."""

    def stretches(it):
        held: list = []
        size = 0
        for batch in it:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= STRETCH:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in items.value]
        for table in stretches(it):
            if not len(table):
                continue
            lengths = np.asarray(table["terms"].combine_chunks().value_lengths())
            doc = np.repeat(np.arange(len(table)), lengths)
            flat = lambda c: np.asarray(table[c].combine_chunks().flatten()).astype(np.int64)  # noqa: E731, B023
            lists = Lists(table["doc_id"].to_pylist(), np.asarray(table["n"].combine_chunks()), doc, flat("terms"), flat("tfs"), weights.value, documents, words)
            for item, heap in zip(items.value, heaps):
                walk(lists, item, heap, k)
        rows = [(i, None if none else id_, score) for i, heap in enumerate(heaps) for score, _, id_, none in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(HITS.types)], schema=HITS)

    return batches


def _block(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    """item_id, rank, doc_id and score for the items of a block; nothing where no item or document has a term."""
    asked = [(x.item_id, Counter(terms_of(x.text))) for x in items.collect()]
    places = {t: i for i, t in enumerate(sorted({t for _, c in asked for t in c}))}
    if not places:
        return None
    sent = spark.sparkContext.broadcast(places)
    postings = materialise(docs.mapInArrow(_postings(sent), "doc_id long, n long, terms array<int>, tfs array<int>"), "postings", batch_rows=500, codec="zstd")
    total = collected(postings.agg(F.count("*").alias("documents"), F.sum("n").alias("words"))).to_pylist()[0]
    documents, words = total["documents"], total["words"]
    if not documents:
        discard(postings)
        return None
    # At most one row a term of the block.
    held = collected(postings.select(F.explode("terms").alias("term")).groupBy("term").count()).to_pylist()
    weights = np.zeros(len(places), np.int64)
    for x in held:
        weights[x["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * x["count"] + 1)))
    queries = spark.sparkContext.broadcast([[(places[t], r) for t, r in sorted(c.items())] for _, c in asked])
    hits = postings.mapInArrow(_searched(queries, spark.sparkContext.broadcast(weights), documents, words, k), "item int, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = materialise(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
    discard(postings)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(asked)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents.

    ``docs`` has doc_id and text, ``items`` item_id and text; their other columns are not used.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = collected(asked.agg(F.sum(F.length("text")).alias("n"))).to_pylist()[0]["n"] or 0
    n = -(-size // block_chars) or 1
    parts = [_block(spark, rows, asked.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == b), k) for b in range(n)]
    found = [p for p in parts if p is not None]
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for p in found:
        out = out.unionByName(p)
    return found[0] if len(found) == 1 else out


def op13_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
