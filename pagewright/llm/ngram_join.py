"""N-gram Jaccard join: pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Texts with the same words are copies; they share a class, whose representative is the smallest doc_id. Each
   different text gets a number of its own, by which everything below tells texts apart.
2. Each text's set of shingle hashes is sketched by MinHash. Band and row counts are chosen for a target recall at
   the threshold, and band hashes are shuffled.
3. The texts of a bucket are compared on their full shingle sets. Buckets of the same texts, which near copies fill in
   most of the bands, are compared once, and a pair that shares several buckets counts in the first band that it shares.
   No pair is written out: a bucket is cut into square cells of ``block`` by ``block`` texts, so that one of any size is
   spread over tasks, and a cell counts links by products of incidence matrices and returns a row for each text.
4. Texts tied by verified links form near-duplicate classes.

Words are separated by ASCII white space and compared as they are. A text of fewer than five words has one shingle,
all its words. Defined results: null and empty texts have no shingles; they are copies of each other and similar to
no other text. Rows with a null doc_id take part under a number drawn from their words and keep their null id; rows
that repeat a doc_id with other words are texts of their own, which have links and classes like any other. A text of
any length is shingled whole. An empty table gives no rows. The join reads the two named columns alone, and the stage
hands on columns of any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import SPACE_CLASS, discard, materialise, numbered, read_table, restored
from pagewright.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9998
BLOCK = 768


def bands_for(threshold: float, recall: float, most_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which pairs at the threshold are found."""
    best = (most_hashes, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, size: int = SHINGLE):
        import numpy as np

        class Words(dict):
            def __missing__(self, word):
                import xxhash

                if len(self) > 200_000:
                    self.clear()
                h = self[word] = xxhash.xxh64_intdigest(word)
                return h

        self._find = Words().__getitem__
        self.size = size
        self._powers = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, size + 1)]

    def __call__(self, text: str | None):
        import numpy as np

        words = (text or "").encode("utf-8", "surrogatepass").split()
        n = len(words)
        h = np.fromiter(map(self._find, words), np.uint64, n)
        if n >= self.size:
            m = n - self.size + 1
            out = np.zeros(m, np.uint64)
            for k, p in enumerate(self._powers):
                out = (out ^ h[k : k + m]) * p
        elif n:
            out = np.full(1, n, np.uint64)
            for x in h:
                out = (out ^ x) * self._powers[0]
        else:
            return h
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def _sketch(bands: int, rows: int):
    """Arrow function: node, words key and text to node, key, number of shingles and band hashes."""

    def sketch(batches):
        import numpy as np
        import pyarrow as pa

        from pagewright.llm.encoding import forget, slices

        forget()
        r = np.random.default_rng(5)
        mul = r.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        add = r.integers(0, 1 << 63, bands * rows, np.uint64)
        mix = r.integers(1, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        shingles = Shingler()
        for batch in batches:
            for some in slices(batch):
                sizes, hashes = [], []
                for text in some.column(3).to_pylist():
                    h = shingles(text)
                    sizes.append(len(h))
                    if not len(h):
                        hashes.append([])
                        continue
                    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(h), 256):
                        part = h[at : at + 256, None] * mul
                        part += add
                        np.minimum(low, part.min(axis=0), out=low)
                    table = (low.reshape(bands, rows) >> np.uint64(3)) * mix
                    key = np.bitwise_xor.reduce(table, axis=1)
                    key ^= key >> np.uint64(31)
                    hashes.append((key * np.uint64(0x94D049BB133111EB)).view(np.int64))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["node", "k1", "k2", "n", "bands"])

    return sketch


def _words_key(text):
    """Two hashes of a text's words, equal for texts with the same words."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " "))
    return F.xxhash64(words), F.xxhash64(F.lit(7), words)


def link_counts(sets: list, sizes, copies, threshold: float, half: int | None, bands, band: int):
    """Links between texts of one cell.

    ``half`` None: all pairs of ``sets``; else the pairs of a text before ``half`` with one from there on. Of the pairs
    only those count whose first common band is ``band``; ``bands`` has a row of band hashes for each text. Gives for each text its
    number of links, the copies of the texts that it links to, and the smallest place of its tied texts.
    """
    import numpy as np

    n = len(sets)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    names, at = np.unique(at[shared], return_inverse=True)
    owner = owner[shared]
    links, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(names):
        # Shingles beyond a few thousand are taken a stretch at a time; the sums of products stay exact below 2**24.
        both = np.zeros((n, n), np.float32)
        for a in range(0, len(names), 4096):
            here = (at >= a) & (at < a + 4096)
            table = np.zeros((n, min(4096, len(names) - a)), np.float32)
            table[owner[here], at[here] - a] = 1
            both += table @ table.T
        for i in range(n):
            row = both[i]
            hit = row >= threshold * (sizes[i] + sizes - row) - 1e-6
            hit[i] = False
            if half is not None:
                if i < half:
                    hit[:half] = False
                else:
                    hit[half:] = False
            hit &= row > 0
            found = np.flatnonzero(hit)
            if len(found):
                found = found[(bands[found] == bands[i]).argmax(axis=1) == band]
            links[i], weight[i] = len(found), copies[found].sum()
            for j in found[found > i]:
                a, b = top(i), top(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return links, weight, [top(i) for i in range(n)]


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node, the two hashes of a row's words and its text. Rows without an id get a number below zero as node."""
    text = F.col(text_col).cast("string")
    k1, k2 = _words_key(text)
    keyed = df.select(F.col(id_col).cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    return keyed.withColumn("node", F.coalesce("id", -F.abs(F.shiftright("k1", 1)) - 1))


def near_classes(keyed: DataFrame, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows (node, k1, k2), and a row for each different text: c1, c2, class_id, text_id and counts.

    ``first`` marks one text of each class, whose text_id is the class_id.
    """
    bands, rows = bands_for(threshold, recall)
    schema = "node long, k1 long, k2 long, n int, bands array<bigint>"
    sketched = materialise(keyed.select("node", "k1", "k2", "text").mapInArrow(_sketch(bands, rows), schema), "sketch")
    # Rows of the same words have the same sketch, so it does not matter whose is kept. The number of a text is that
    # of its row in the table as it is written, and is read from there only.
    texts = sketched.groupBy("k1", "k2").agg(F.min("node").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = materialise(texts.withColumn("t", F.monotonically_increasing_id()), "texts")
    keys = texts.where("n > 0").select("t", F.posexplode("bands").alias("band", "hash"))
    members = F.sum(F.xxhash64("t").cast("decimal(20,0)")).alias("members")
    buckets = keys.groupBy("band", "hash").agg(F.count("*").alias("m"), members).where("m > 1")
    once = buckets.groupBy("m", "members").agg(F.min(F.struct("band", "hash")).alias("of"))
    once = materialise(once.select(F.col("of.band").alias("b"), F.col("of.hash").alias("h"), "m"), "buckets")
    met = keys.join(once, (F.col("band") == F.col("b")) & (F.col("hash") == F.col("h"))).select("t", "band", "hash", "m")
    met = materialise(met, "met")
    found = _verified(keyed, texts, met, threshold, block)
    discard(once, met)
    groups = connected_components(found.where("t <> tie").select(F.col("t").alias("a"), F.col("tie").alias("b")))
    per = found.groupBy(F.col("t").alias("r")).agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
    told = texts.drop("bands").join(per, F.col("t") == F.col("r"), "left").join(groups, F.col("t") == F.col("node"), "left")
    told = materialise(
        told.select(
            F.col("k1").alias("c1"), F.col("k2").alias("c2"), "component", F.col("rep").alias("text_id"), F.col("copies").alias("n_copies"),
            (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"),
        ),
        "told",
    )
    discard(found, texts)
    # A class is named by its smallest id; one of its texts with that id, whose keys are least, is its first.
    low = told.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min(F.struct("text_id", "c1", "c2")).alias("low"))
    named = told.join(materialise(low, "names"), F.col("component") == F.col("c"), "left")
    first = F.coalesce((F.col("low.c1") == F.col("c1")) & (F.col("low.c2") == F.col("c2")), F.lit(True))
    named = named.select("c1", "c2", F.coalesce("low.text_id", "text_id").alias("class_id"), "text_id", "n_copies", "n_links", "n_text_links", first.alias("first"))
    return sketched.select("node", "k1", "k2"), named


def ngram_jaccard_join(
    df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row for each row of ``df``.

    doc_id; class_id: smallest id of its near-duplicate class; text_id: smallest id of the rows with its words;
    n_copies: rows with its words; n_links: other rows whose similarity reaches the threshold, copies among them;
    n_text_links: different texts among these.
    """
    rows, named = near_classes(_keyed(df, id_col, text_col), threshold, recall, block)
    members = rows.join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    own = F.when(F.col("node") >= 0, F.col("node")).otherwise(_own(F.col("node"), F.col("k1")))
    return members.select(own.alias("doc_id"), "class_id", "text_id", "n_copies", "n_links", "n_text_links")


def _own(node, k1):
    """A negative node is a row's own id unless it was drawn from its words."""
    return F.when(node != -F.abs(F.shiftright(k1, 1)) - 1, node)


def _verified(keyed: DataFrame, texts: DataFrame, met: DataFrame, threshold: float, block: int) -> DataFrame:
    """t, links, weight and tie (the smallest text it is tied to) from every cell that a text is in.

    ``met``: texts by band, hash and m, the number of texts of the bucket.
    """
    chosen = texts.join(met.select("t").distinct(), "t", "left_semi")
    chosen = chosen.select("t", "copies", "bands", F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep")
    # One row of each text: that of its smallest node, or any of those that share it.
    source = keyed.join(chosen, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("node") == F.col("rep")))

    def pack(batches):
        import pyarrow as pa

        from pagewright.llm.encoding import slices

        shingles = Shingler()
        for batch in batches:
            for some in slices(batch):
                sets = [shingles(t).tobytes() for t in some.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(sets, pa.binary())], names=["t", "copies", "bands", "hashes"])

    packed = source.dropDuplicates(["t"]).select(F.col("t").alias("x"), "copies", "bands", "text")
    packed = materialise(packed.mapInArrow(pack, "x long, copies long, bands array<bigint>, hashes binary"), "sets")
    groups = met.withColumn("parts", F.ceil(F.col("m") / block).cast("long")).withColumn("part", F.pmod(F.xxhash64("t"), "parts"))
    # A text of part p meets part q in the cell of both; cell (p, p) holds the pairs inside the part.
    cells = groups.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select("t", "band", "hash", "part", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"))
    cells = cells.join(packed, F.col("t") == F.col("x")).drop("x")
    schema = "t long, links long, weight long, tie long"
    found = materialise(cells.groupBy("band", "hash", "row", "col").applyInArrow(_compare(threshold), schema), "links")
    discard(packed)
    return found


def _compare(threshold: float):
    def compare(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("part", "ascending"), ("t", "ascending")])
        sets = [np.frombuffer(b, np.uint64) for b in table["hashes"].to_pylist()]
        sizes = np.asarray([len(s) for s in sets], np.float64)
        parts = table["part"].to_numpy()
        half = None if parts[0] == parts[-1] else int(np.searchsorted(parts, parts[-1]))
        texts, band = table["t"].to_numpy(), table["band"][0].as_py()
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(sets), -1)
        links, weight, tops = link_counts(sets, sizes, table["copies"].to_numpy(), threshold, half, bands, band)
        return pa.table({"t": texts, "links": links, "weight": weight, "tie": texts[tops]})

    return compare


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and links of all documents."""
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: a row of its first text, one of them where several rows have its words and id."""
    inner, names = numbered(docs)
    id_, text = F.col(names["doc_id"]).cast("long"), F.col(names["text"]).cast("string")
    _, told = near_classes(_keyed(inner, names["doc_id"], names["text"]), THRESHOLD, RECALL, BLOCK)
    first = told.where("first").select("c1", "c2", F.col("text_id").alias("c3"))
    k1, k2 = _words_key(text)
    rows = inner.withColumns({"k1": k1, "k2": k2}).withColumn("k3", F.coalesce(id_, -F.abs(F.shiftright("k1", 1)) - 1))
    kept = rows.join(first, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("k3") == F.col("c3")), "left_semi")
    return restored(kept.dropDuplicates(["k1", "k2", "k3"]), names)
