"""Quality scores from random-indexing word vectors and a two-layer network with calibrated probabilities.

Each text gives two sequences of tokens: its words (lower case, without the marks that end them) and their shapes
(case, digits, the marks; a word that repeats the one before it has a shape of its own). Each word has a sparse random
index vector, which its 64-bit hash gives. The word vector of a word adds up the index vectors of its neighbours over
all texts (random indexing) and its own index vector. Words that are at least ``WORD_SHARE`` of all have a vector of
their own, so there are at most ``1 / WORD_SHARE`` of these whatever the corpus; a rarer word is its index vector
alone. Shapes are hashed to ``SHAPES`` kinds, which have vectors in the same way. A text is the mean of its words'
vectors beside that of its shapes'.

The network (numpy, one hidden layer) learns from at most about ``most_rows`` labelled rows, chosen by hash, and a
temperature fitted on a fifth of these turns its outputs into probabilities. Labels, language, source and id are
never inputs. Word counts and word vectors cover all texts.

Defined results: null and empty texts have zero vectors and get the network's score for these; a text of any length
counts whole; a null doc_id is not held out and has no label; several labels of one id are averaged, and rows whose
mean is not 0 or 1 are not learnt from; repeated rows are scored each; without labels of both kinds all scores are 0.5;
an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import discard, materialise, read_table

SHAPES = 1 << 10
#: Share of all words from which on a word has a vector of its own.
WORD_SHARE = 1e-5
DIM = 64
NONZERO = 4
MARKS = ".,;:!?#$%&*|<>\"'()-_=+@/\\~^"
COUNTS = "word long, n long"
SUMS = "seq int, row int, n double, vec array<double>"
#: Counts of words in texts that are in memory at a time.
CELLS = 1 << 21


def index_vectors(h):
    """Places and signs of the nonzero components of the index vectors of hashes, a row for each component."""
    import numpy as np

    places = np.stack([(h >> np.uint64(6 * k)) & np.uint64(DIM - 1) for k in range(NONZERO)]).astype(np.int64)
    signs = np.stack([1.0 - 2.0 * ((h >> np.uint64(48 + k)) & np.uint64(1)).astype(np.float64) for k in range(NONZERO)])
    return places, signs


def shape_hashes():
    """A hash for each kind of shape."""
    import numpy as np
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(f"shape {i}") for i in range(SHAPES)), np.uint64, SHAPES)


class Tokens:
    """Hashes of words and kinds of shapes of texts, with a bounded table of words."""

    def __init__(self, most: int = 300_000):
        import numpy as np

        self.most = most
        self.known: dict[str, int] = {}
        self.hashes, self.shapes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]):
        """Places of words in the table, which new ones are added to; it starts anew when it is too long."""
        import numpy as np

        if len(self.known) > self.most:
            self.__init__(self.most)
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            added = [words[i] for i in new.tolist()]
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(added, at[new].tolist()))
            pairs = list(map(self._pair, added))
            self.hashes = np.concatenate([self.hashes, np.fromiter((p[0] for p in pairs), np.uint64, len(pairs))])
            self.shapes = np.concatenate([self.shapes, np.fromiter((p[1] for p in pairs), np.int64, len(pairs))])
        return at

    @staticmethod
    def _pair(word: str) -> tuple[int, int]:
        import zlib

        import xxhash

        stem = word.rstrip(MARKS)
        marks = word[len(stem) :]
        case = "u" if stem.isupper() and len(stem) > 1 else "t" if stem[:1].isupper() else "l" if stem.islower() else "n"
        digits = "d" if any(c.isdigit() for c in stem) else ""
        shape = zlib.crc32(f"{case}{digits}{marks[:3]}".encode()) % (SHAPES - 1)
        return xxhash.xxh64_intdigest(stem.lower().encode("utf-8", "surrogatepass")), shape

    def __call__(self, texts):
        """Distinct words' hashes, each token's word and shape, and the number of tokens of each text."""
        import numpy as np
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        full = pc.not_equal(flat, "")
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        sizes = np.diff(before[bounds - bounds[0]])
        coded = flat.filter(full).dictionary_encode()
        at = self._learn(coded.dictionary.to_pylist())
        hashes, of = np.unique(self.hashes[at], return_inverse=True)
        codes = coded.indices.to_numpy()
        lexical, shape = of[codes], self.shapes[at][codes]
        if len(lexical) > 1:
            again = np.flatnonzero(lexical[1:] == lexical[:-1]) + 1
            first = np.zeros(len(lexical) + 1, bool)
            first[np.cumsum(sizes) - sizes] = True
            shape[again[~first[again]]] = SHAPES - 1
        return hashes, lexical, shape, sizes


def _count(batches):
    """How often each word stands in the texts."""
    import numpy as np
    import pyarrow as pa

    from pagewright.llm.encoding import forget, slices

    forget()
    tokens = Tokens()
    parts, held = [], 0

    def rows():
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], names=["word", "n"])

    for batch in batches:
        for some in slices(batch):
            hashes, lexical, _, _ = tokens(some.column(0))
            parts.append((hashes, np.bincount(lexical, minlength=len(hashes))))
            held += len(hashes)
            if held > 2_000_000:
                yield from rows()
                parts, held = [], 0
    if parts:
        yield from rows()


def vocabulary(texts: DataFrame, word_share: float = WORD_SHARE):
    """Hashes, in order, of the words that have a vector of their own."""
    import numpy as np

    counts = materialise(texts.mapInArrow(_count, COUNTS).groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    chosen = counts.where(F.col("n") >= max(2, math.ceil(word_share * total))).select("word").toArrow()
    discard(counts)
    return np.sort(chosen["word"].to_numpy().view(np.uint64))


def _rows_of(words, hashes):
    """Places of hashes among the words; ``len(words)`` stands for those that are not there."""
    import numpy as np

    at = np.searchsorted(words, hashes)
    at[at == len(words)] = 0
    return np.where(words[at] == hashes, at, len(words)) if len(words) else np.zeros(len(hashes), np.int64)


def _neighbours(shared):
    """Arrow function: sums of neighbours' index vectors by word (seq 0) and shape (seq 1), and how many there were."""

    def neighbours(batches):
        import numpy as np
        import pyarrow as pa

        from pagewright.llm.encoding import slices

        words = shared.value
        tokens = Tokens()
        kinds = (len(words), SHAPES)
        total, count = [np.zeros(k * DIM) for k in kinds], [np.zeros(k) for k in kinds]
        shape_places, shape_signs = index_vectors(shape_hashes())
        for batch in batches:
            for some in slices(batch):
                hashes, lexical, shape, sizes = tokens(some.column(0))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                inner = owner[1:] == owner[:-1]
                of_word = _rows_of(words, hashes)[lexical]
                for seq, rows, ids, (places, signs) in ((0, of_word, lexical, index_vectors(hashes)), (1, shape, shape, (shape_places, shape_signs))):
                    for side in (0, 1):
                        a, b = (rows[:-1], ids[1:]) if side else (rows[1:], ids[:-1])
                        chosen = inner & (a < kinds[seq])
                        a, b = a[chosen], b[chosen]
                        count[seq] += np.bincount(a, minlength=kinds[seq])
                        for k in range(NONZERO):
                            total[seq] += np.bincount(a * DIM + places[k][b], signs[k][b], kinds[seq] * DIM)
        for seq in (0, 1):
            used = np.flatnonzero(count[seq])
            table = total[seq].reshape(kinds[seq], DIM)
            for at in range(0, len(used), 4096):
                part = used[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), seq, np.int32)), pa.array(part.astype(np.int32)), pa.array(count[seq][part]), _lists(table[part])], names=["seq", "row", "n", "vec"])

    return neighbours


def _lists(table):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)), pa.array(table.ravel()))


def _summed(table):
    import numpy as np
    import pyarrow as pa

    keys, at = np.unique(table["seq"].to_numpy().astype(np.int64) << 32 | table["row"].to_numpy(), return_inverse=True)
    vec = table["vec"].combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    total = np.zeros((len(keys), DIM))
    np.add.at(total, at, vec)
    n = np.bincount(at, table["n"].to_numpy(), len(keys))
    return pa.table({"seq": (keys >> 32).astype(np.int32), "row": (keys & 0xFFFFFFFF).astype(np.int32), "n": n, "vec": _lists(total)})


def word_vectors(texts: DataFrame, words):
    """Vectors of the words and of the shapes, from all texts (column text): two tables with a row for each.

    That of the words has a row of zeros at its end, for words that have none.
    """
    import numpy as np
    import pyarrow.compute as pc

    shared = texts.sparkSession.sparkContext.broadcast(words)
    sums = texts.mapInArrow(_neighbours(shared), SUMS).groupBy((F.col("row") % 256).alias("g")).applyInArrow(lambda t: _summed(t), SUMS)
    found = sums.toArrow()  # at most a row for each word of the vocabulary and each shape
    out = []
    for seq, hashes in enumerate((words, shape_hashes())):
        places, signs = index_vectors(hashes)
        table = np.zeros((len(hashes), DIM))
        for k in range(NONZERO):
            np.add.at(table, (np.arange(len(hashes)), places[k]), signs[k])
        mine = found.filter(pc.equal(found["seq"], seq))
        if mine.num_rows:
            vec = mine["vec"].combine_chunks().flatten().to_numpy().reshape(-1, DIM)
            table[mine["row"].to_numpy()] += vec / mine["n"].to_numpy()[:, None] * 2
        out.append((table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32))
    return np.vstack([out[0], np.zeros((1, DIM), np.float32)]), out[1]


def pooled(docs: DataFrame, words, vectors) -> DataFrame:
    """doc_id, held_out and the pooled vector (2 * DIM floats) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((words, *vectors))

    def pool(batches):
        import numpy as np
        import pyarrow as pa

        from pagewright.llm.encoding import slices

        words, of_words, of_shapes = shared.value
        tokens = Tokens()
        for batch in batches:
            for some in slices(batch, 4 << 20):
                hashes, lexical, shape, sizes = tokens(some.column(2))
                out = np.zeros((len(sizes), 2 * DIM), np.float32)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                rows = _rows_of(words, hashes)[lexical]
                # Counts of each word in each of some texts, times the words' vectors.
                ends, step = np.cumsum(sizes), max(1, CELLS // len(of_words))
                for at in range(0, len(sizes), step):
                    last = min(at + step, len(sizes))
                    part = slice(ends[at] - sizes[at], ends[last - 1])
                    for table, ids, to in ((of_words, rows, slice(0, DIM)), (of_shapes, shape, slice(DIM, 2 * DIM))):
                        cells = (owner[part] - at) * len(table) + ids[part]
                        counts = np.bincount(cells, minlength=(last - at) * len(table)).reshape(-1, len(table))
                        out[at:last, to] = counts.astype(np.float32) @ table
                rare = rows == len(words)
                if rare.any():
                    places, signs = index_vectors(hashes)
                    own, which = owner[rare] * DIM, lexical[rare]
                    for k in range(NONZERO):
                        more = np.bincount(own + places[k][which], signs[k][which] / NONZERO**0.5, len(sizes) * DIM)
                        out[:, :DIM] += more.reshape(-1, DIM).astype(np.float32)
                out /= np.maximum(sizes[:, None], 1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), _lists(out)], names=["doc_id", "held_out", "vec"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(pool, "doc_id long, held_out boolean, vec array<float>")


class Network:
    """Two layers: inputs standardised, one hidden layer of rectified units, one output."""

    def __init__(self, x, y, hidden: int = 48, epochs: int = 60, seed: int = 5):
        import numpy as np

        r = np.random.default_rng(seed)
        self.constant = len(np.unique(y)) < 2
        if self.constant:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        order = r.permutation(len(x))
        kept, apart = order[len(x) // 5 :], order[: len(x) // 5]
        d = x.shape[1]
        self.w = [r.normal(size=(d, hidden)) * (2 / d) ** 0.5, np.zeros(hidden), r.normal(size=hidden) * (1 / hidden) ** 0.5, np.zeros(1)]
        first, second = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        step = 0
        for _ in range(epochs):
            r.shuffle(kept)
            for at in range(0, len(kept), 128):
                i = kept[at : at + 128]
                h = np.maximum(x[i] @ self.w[0] + self.w[1], 0)
                gap = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -40, 40))) - y[i]) / len(i)
                back = gap[:, None] * self.w[2] * (h > 0)
                grads = [x[i].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ gap + 1e-4 * self.w[2], gap.sum(keepdims=True)]
                step += 1
                for p, g, m, v in zip(self.w, grads, first, second):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(apart) > 20:
            logit = self._logit(x[apart])
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            losses = [np.logaddexp(0, -(2 * y[apart] - 1) * logit / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(losses))])

    def _logit(self, x):
        import numpy as np

        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3][0]

    def chances(self, x):
        import numpy as np

        if self.constant:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -40, 40)))


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, held_out, text).

    ``labels``: doc_id and quality; only those of rows that are not held out are read.
    """
    import numpy as np

    spark = docs.sparkSession
    words = vocabulary(docs.select("text"))
    rows = materialise(pooled(docs, words, word_vectors(docs.select("text"), words)), "pooled")
    marks = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("double").alias("quality")).where("of is not null and quality is not null").groupBy("of").agg(F.avg("quality").alias("y")).where("y in (0, 1)")
    known = rows.where("not held_out").join(marks, F.col("doc_id") == F.col("of")).select("doc_id", "vec", "y")
    total = known.count()
    share = min(1.0, most_rows / max(total, 1))
    # By id and vector, and each once: an id on many rows is sampled like any other, and rows alike are one.
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "vec"), F.lit(1_000_003)) < share * 1_000_003)
    sample = chosen.distinct().orderBy("doc_id", "vec").toArrow()
    x = sample["vec"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * DIM).astype(np.float64)
    network = spark.sparkContext.broadcast(Network(x, sample["y"].to_numpy()))

    def rate(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, 2 * DIM)
            score = network.value.chances(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")


def op8_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labels of those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return classify(docs, read_table(spark, sf_dir, "labels"))
