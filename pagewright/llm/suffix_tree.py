"""Language-model scores from a probabilistic suffix tree over words.

A state is a context, the last one to ``depth`` words. A context is a candidate when it occurs at least
``least_context`` times in the training texts, its own suffix is a state and so is what precedes its newest word; it
becomes a state when a likelihood-ratio test finds that what follows it diverges from what its suffix predicts. A state
keeps the next words that follow it at least ``least_next`` times, and leaves the rest of its mass, smoothed by ``mu``
tokens, to its suffix in proportion; each state's distribution sums to one. The root is the add-one distribution over
all training words, the end and one unknown word. A token is scored from the longest state that ends before it.

The limits are numbers of occurrences, so states and entries grow with the corpus. They are rows of a work table that is
looked up when texts are scored (``fit_tables``, ``score_tables``); only the commonest, 2 million at most, and bit
filters of fixed size are sent to the tasks, and both only spare the shuffle work. N-grams are shuffled as packed arrays,
one for each task and bucket; there are as many buckets as the number of tokens needs, so that each fits in memory. ``fit`` and ``score`` are the same model in
memory, with limits as shares of the corpus; tests hold the tables against it. Counts cover all training texts.

In the tables a word is 64 bits of a salted digest of its bytes; 64 more tell whether two words of any text share them,
and if so all is coded anew with another salt. ``fit`` compares words by 64-bit hashes. Defined results: null and empty texts hold the end alone; a null
doc_id is text to learn from; repeated rows count and are scored each; a text of any length is scored whole; an empty
table gives no rows. Columns other than the two named ones, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import math
from itertools import repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import collected, discard, materialise, read_table, remove

END_ID = 0
COUNTS = "word long, n long"


def word_codes(texts):
    """Distinct lower-case words of an Arrow array of texts, each word's code, and each text's number of words."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    sizes = np.diff(before[bounds - bounds[0]])
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), sizes


def hashes(words: list[str]):
    """64-bit hashes of words as signed integers; none is 0, which stands for the end."""
    import numpy as np
    import xxhash

    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
    h[h == 0] = 1
    return h


def digests(words: list[str], salt: int):
    """64 bits of a digest of each word as signed integers, none of which is 0, and 64 more that tell words apart."""
    import hashlib

    import numpy as np

    salted = hashlib.blake2b(digest_size=16, salt=salt.to_bytes(8, "little"))

    def digest(word):
        h = salted.copy()
        h.update(word.encode())
        return h.digest()

    both = np.frombuffer(b"".join(map(digest, words)), np.int64).reshape(-1, 2)
    key = both[:, 0].copy()
    key[key == 0] = 1
    return key, both[:, 1]


class Tally:
    """Sums counts by key in bounded memory."""

    def __init__(self, most: int = 2_000_000):
        self.parts, self.held, self.most = [], 0, most

    def add(self, keys, counts):
        self.parts.append((keys, counts))
        self.held += len(keys)
        return self.take() if self.held > self.most else None

    def take(self):
        import numpy as np

        if not self.parts:
            return None
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in self.parts]), len(keys)).astype(np.int64)
        self.parts, self.held = [], 0
        return keys, counts


def _rows(found):
    import pyarrow as pa

    for at in range(0, len(found[0]) if found else 0, 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 200_000]) for c in found], names=["word", "n"])


def _count_words(batches):
    import numpy as np

    from pagewright.llm.encoding import slices

    tally = Tally()
    for batch in batches:
        for some in slices(batch):
            words, codes, sizes = word_codes(some.column(0))
            out = tally.add(np.append(hashes(words), 0), np.append(np.bincount(codes, minlength=len(words)), len(sizes)))
            if out:
                yield from _rows(out)
    yield from _rows(tally.take())


class Tree:
    """States and their distributions; state 0 is the root. Everything is in sorted arrays."""

    def __init__(self, words, counts, tokens: int, kinds: int, mu: float):
        import numpy as np

        order = np.argsort(words)
        # The end is common by definition and has id 0; other common words follow in order of their hashes.
        self.words, counts = words[order], counts[order]
        self.words, counts = np.concatenate([[0], self.words[self.words != 0]]), np.concatenate([counts[self.words == 0], counts[self.words != 0]])
        self.sorted = self.words[1:]
        self.width = len(self.words) + 1  # the last id is that of every word that is not common
        self.tokens, self.kinds, self.mu = tokens, kinds, mu
        self.counts = counts
        self.unknown = -math.log10(tokens + kinds + 1)
        self.root = np.log10(counts + 1) + self.unknown
        self.children = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # state * width + older word: state
        self.entries = (np.zeros(0, np.int64), np.zeros(0))  # state * width + next word: log10 of its chance
        self.rest = np.zeros(1)  # log10 of the factor that a state leaves to its suffix
        self.parent = np.zeros(1, np.int64)
        self.depth = 0
        self._known: dict[str, int] = {}

    def ids(self, words: list[str]):
        """Ids of words; those that are not common have the last id."""
        import numpy as np

        if len(self._known) > 400_000:
            self._known = {}
        known = self._known
        ids = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(ids < 0)
        if len(new):
            h = hashes([words[i] for i in new.tolist()])
            at = np.searchsorted(self.sorted, h)
            fits = at < len(self.sorted)
            fits[fits] = self.sorted[at[fits]] == h[fits]
            ids[new] = np.where(fits, at + 1, self.width - 1)
            known.update(zip([words[i] for i in new.tolist()], ids[new].tolist()))
        return ids

    @staticmethod
    def find(table, keys):
        """Places of keys in a sorted table, -1 where there is none."""
        import numpy as np

        if not len(table):
            return np.full(len(keys), -1)
        at = np.searchsorted(table, keys)
        at[at == len(table)] = 0
        return np.where(table[at] == keys, at, -1)

    def states(self, ids, starts, depth: int, children=None):
        """The longest state before each token, of at most ``depth`` words; ``starts``: where each token's text starts.

        With ``children``, only what these extend of full-length states counts, else 0.
        """
        import numpy as np

        state = np.zeros(len(ids), np.int64)
        live = np.arange(len(ids))
        for d in range(1, depth + 1):
            live = live[live - d >= starts[live]]
            keys = state[live] * self.width + ids[live - d]
            table, to = (children if children and d == depth else self.children)
            at = self.find(table, keys)
            live, at = live[at >= 0], at[at >= 0]
            if children and d == depth:
                out = np.zeros(len(ids), np.int64)
                out[live] = to[at]
                return out
            state[live] = to[at]
        return state

    def log_chances(self, state, ids):
        """log10 of each token's chance in its state; tokens that are not common lack the root's part."""
        import numpy as np

        out = np.zeros(len(ids))
        state = state.copy()
        live = np.flatnonzero(state > 0)
        while len(live):
            at = self.find(self.entries[0], state[live] * self.width + ids[live])
            hit = at >= 0
            out[live[hit]] += self.entries[1][at[hit]]
            state[live[hit]] = -1
            live = live[~hit]
            out[live] += self.rest[state[live]]
            state[live] = self.parent[state[live]]
            live = live[state[live] > 0]
        at_root = (state == 0) & (ids < self.width - 1)
        out[at_root] += self.root[ids[at_root]]
        return out

    def candidates(self, least: int):
        """Contexts one word longer than the tree is deep, that occur often enough: keys and counts."""
        import numpy as np

        if self.depth == 0:
            chosen = np.flatnonzero(self.counts >= least)
            chosen = chosen[chosen != END_ID]
            return chosen.astype(np.int64), self.counts[chosen]
        # The pair (older, state's words) occurs as often as the state's words follow what ends in older.
        return self._longer(least)

    def _longer(self, least: int):
        import numpy as np

        keys, counts = [], []
        names = self.names
        by_name = {n: s for s, n in enumerate(names)}
        for (state, word), n in self.seen.items():
            if n >= least and word not in (END_ID, self.width - 1) and len(names[state]) == self.depth:
                longer = (*names[state], word)  # oldest first; as a context it extends the state of all but the oldest
                own = by_name.get(longer[1:])
                if own is not None:
                    keys.append(own * self.width + longer[0])
                    counts.append(n)
        order = np.argsort(np.asarray(keys, np.int64))
        return np.asarray(keys, np.int64)[order], np.asarray(counts, np.int64)[order]

    def grow(self, keys, totals, found) -> int:
        """Test candidate contexts against their suffixes and add those that diverge.

        ``found``: arrays of candidate place, next word and count. Gives how many states were added.
        """
        import numpy as np

        place, word, count = (np.asarray(x, np.int64) for x in found)
        suffix = keys // self.width
        own_total = totals[place].astype(float)
        below = 10 ** self.log_chances(suffix[place], word)
        expect = own_total * below
        g = np.bincount(place, 2 * count * np.log(count / expect), len(keys))
        kinds = np.bincount(place, minlength=len(keys))
        taken, taken_below = np.bincount(place, count, len(keys)), np.bincount(place, below, len(keys))
        left, left_below = totals - taken, np.maximum(totals * (1 - taken_below), 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(left > 0, 2 * left * np.log(left / left_below), 0)
        # Under the suffix's predictions g has about as many degrees of freedom as there are kinds.
        kept = np.flatnonzero((kinds > 0) & (g > kinds + 4 * np.sqrt(2 * kinds)))
        first = len(self.parent)
        number = np.full(len(keys), -1)
        number[kept] = np.arange(first, first + len(kept))
        mine = number[place] >= 0
        chance = count / (own_total + self.mu)
        given = np.bincount(place, chance, len(keys))
        rest = (1 - given) / np.maximum(1 - taken_below, 1e-12)
        self.parent = np.concatenate([self.parent, suffix[kept]])
        self.rest = np.concatenate([self.rest, np.log10(np.maximum(rest[kept], 1e-300))])
        for name, new_keys, values in (("children", keys[kept], number[kept]), ("entries", number[place[mine]] * self.width + word[mine], np.log10(chance[mine]))):
            all_keys, all_values = np.concatenate([getattr(self, name)[0], new_keys]), np.concatenate([getattr(self, name)[1], values])
            order = np.argsort(all_keys)
            setattr(self, name, (all_keys[order], all_values[order]))
        names = getattr(self, "names", [()])
        names = names + [(int(k % self.width), *names[int(k // self.width)]) for k in keys[kept]]
        self.names, self.seen = names, {(int(number[p]), int(w)): int(c) for p, w, c in zip(place, word, count) if number[p] >= 0}
        self.depth += 1
        return len(kept)


def _code(tree: Tree):
    """Arrow function: doc_id, held_out and text to a row's number, its ids with an end, and its rarer words' hashes."""

    def code(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from pagewright.llm.encoding import slices

        tree_ = tree.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in slices(batch):
                words, codes, sizes = word_codes(some.column(2))
                n, known = len(sizes), tree_.ids(words)
                ends = np.cumsum(sizes + 1)
                ids = np.zeros(int(ends[-1]) if n else 0, np.int32)
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                ids[inner] = known[codes]
                rare = known[codes] == tree_.width - 1
                h = np.zeros(len(words), np.int64)
                of_rare = np.flatnonzero(known == tree_.width - 1)
                h[of_rare] = hashes([words[i] for i in of_rare.tolist()])
                before = np.concatenate([[0], np.cumsum(rare)])
                cuts = before[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
                bounds = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), some.column(0), some.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[codes[rare]]))],
                    names=["row", "doc_id", "held_out", "ids", "rare"],
                )
                row += n

    return code


CODED = "row long, doc_id long, held_out boolean, ids array<int>, rare array<bigint>"


def _laid_out(ids):
    """The tokens of an Arrow array of id lists one after another, where each one's text starts, and the texts' sizes."""
    import numpy as np

    bounds = ids.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(bounds)
    return ids.flatten().to_numpy().astype(np.int64), np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def fit(docs: DataFrame, depth: int = 3, context_share: float = 5e-5, next_share: float = 1e-6, common_share: float = 5e-7, mu: float = 5.0) -> tuple[Tree, DataFrame, DataFrame]:
    """The tree of the texts (doc_id, held_out, text) that are not held out, their word counts (word 0: the end), and
    all rows with their words as ids, which the passes for longer contexts and the scores read instead of the texts."""
    import numpy as np

    spark = docs.sparkSession
    counts = materialise(docs.where("not held_out").select("text").mapInArrow(_count_words, COUNTS).groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, kinds = total[0] or 0, total[1]
    common = counts.where((F.col("n") >= max(2, math.ceil(common_share * tokens))) | (F.col("word") == 0)).toPandas()
    tree = Tree(common["word"].to_numpy(np.int64), common["n"].to_numpy(np.int64), tokens, kinds, mu)
    coded = materialise(docs.select("doc_id", "held_out", "text").mapInArrow(_code(spark.sparkContext.broadcast(tree)), CODED), "coded")
    least_next = max(3, math.ceil(next_share * tokens))
    for d in range(1, depth + 1):
        keys, totals = tree.candidates(max(20, math.ceil(context_share * tokens)))
        if not len(keys):
            break
        shared = spark.sparkContext.broadcast((tree, keys))

        def count(batches, d=d, shared=shared):
            import numpy as np

            from pagewright.llm.encoding import slices

            tree, keys = shared.value
            children = (keys, np.arange(1, len(keys) + 1))
            tally = Tally()
            for batch in batches:
                for some in slices(batch):
                    ids, starts, _ = _laid_out(some.column(0))
                    place = tree.states(ids, starts, d, children)
                    hit = (place > 0) & (ids < tree.width - 1)
                    got, n = np.unique((place[hit] - 1) * tree.width + ids[hit], return_counts=True)
                    out = tally.add(got, n)
                    if out:
                        yield from _rows(out)
            yield from _rows(tally.take())

        found = coded.where("not held_out").select("ids").mapInArrow(count, COUNTS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_next).toPandas()
        key = found["word"].to_numpy(np.int64)
        order = np.argsort(key)
        key, n = key[order], found["n"].to_numpy(np.int64)[order]
        if not tree.grow(keys, totals, (key // tree.width, key % tree.width, n)):
            break
    tree.names, tree.seen, tree._known = [], {}, {}
    return tree, counts, coded


def score(coded: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of each coded row."""
    shared = coded.sparkSession.sparkContext.broadcast(tree)

    def rate(batches):
        import numpy as np
        import pyarrow as pa

        from pagewright.llm.encoding import slices

        tree = shared.value
        for batch in batches:
            for some in slices(batch):
                ids, starts, sizes = _laid_out(some.column(3))
                n = len(sizes)
                owner = np.repeat(np.arange(n), sizes)
                log = tree.log_chances(tree.states(ids, starts, tree.depth), ids)
                common = ids < tree.width - 1
                base = np.bincount(owner[common], tree.root[ids[common]], n)
                known = np.bincount(owner[common], tree.counts[ids[common]] > 0, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], pa.array(sizes), pa.array(known), pa.array(base), pa.array(np.bincount(owner, log, n))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    part = coded.select("row", "doc_id", "held_out", "ids").mapInArrow(rate, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    rare = coded.select("row", F.explode("rare").alias("w")).groupBy("row", "w").agg(F.count("*").alias("times"))
    met = rare.join(counts, F.col("w") == F.col("word"), "left").select(F.col("row").alias("r"), "times", F.coalesce("n", F.lit(0)).alias("n"))
    log = F.col("times") * (F.log10(F.col("n") + 1.0) + tree.unknown)
    sums = met.groupBy("r").agg(F.sum(log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("of_known"))
    out = part.join(sums, F.col("row") == F.col("r"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("of_known", F.lit(0))).alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


#: log2 of the bits of a filter: keys are looked up in it before they are shuffled, and however many there are it has this size.
FILTER_BITS = 27
#: log2 of the places of a table that leads from a key to its common n-gram; where two share one, both are searched for.
SLOT_BITS = 22
FOUND = "ctx long, word long, n long"
#: Tokens for each bucket of n-grams: a bucket is counted, or looked up, by one call. What a bucket looks up goes back
#: to the documents, a row of sums for each that asks, so these buckets are larger.
BUCKET_TOKENS = 1 << 19
LOOKED_UP_TOKENS = 1 << 21
#: Texts are scored in at most so many rounds of rows, and n-grams of a length counted in at most so many of contexts, so
#: that the shuffles of one round are on disk at a time. A round of counting takes the keys of all words again; one of
#: scoring only reads them again, and shuffles the values of n-grams again, so there can be more of these.
ROUNDS = 4
COUNT_ROUNDS = 2
#: Most documents of a chunk, whose places take two bytes.
CHUNK = 60_000
#: Rows of a batch of lists of words.
WORD_LISTS = 500
#: Rows of a batch of texts that are coded, about 8 MB where texts have the usual length; longer ones are cut up.
TEXTS = 2_000
COUNTED = "bucket int, ctx binary, word binary, n binary"
DOCS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, more double"
#: Rows of documents, and rows of the n-grams of a chunk of documents that are to be looked up in one bucket.
PLACED = f"chunk long, {DOCS}, bucket int, at binary, keys binary"
#: Values of n-grams of a bucket, as arrays.
NAMED = "bucket int, keys binary, known binary, base binary, more binary"
#: Rows of documents, and rows of the sums that one bucket gives to the documents of a chunk.
LOOKED_UP = f"chunk long, {DOCS}, at binary, sum_known binary, sum_base binary, sum_more binary"


def mixed(a, b):
    """Spark's xxhash64 of two arrays of longs."""
    import numpy as np

    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, n):
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    h = np.uint64(42)
    with np.errstate(over="ignore"):
        for x in (a, b):
            h = (h + p5 + np.uint64(8)) ^ (turned(x.view(np.uint64) * p2, 31) * p1)
            h = turned(h, 27) * p1 + p4
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def key_filter(df: DataFrame, key: str):
    """A bit set of the keys. A key that is not in it is not in the table; how full it is only changes the cost."""
    import numpy as np

    place = F.col(key).bitwiseAND((1 << FILTER_BITS) - 1)
    bits = collected(df.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return out


def may_hold(bits, keys):
    import numpy as np

    return (bits[(keys & ((1 << FILTER_BITS) - 1)) >> 6] >> (keys & 63)) & 1 != 0 if len(keys) else np.zeros(0, bool)


WORDS = "row long, doc_id long, held_out boolean, words array<bigint>, checks array<bigint>, counts array<bigint>, met boolean"
#: A word's key is 8 bytes, its place in the dictionary of a file at most 3; the default of 1 MB holds too few words.
DICTIONARY = {"parquet.dictionary.page.size": str(16 << 20)}


def _to_words(salt: int, digest=digests, most: int = 2_000_000):
    """Arrow function: doc_id, held_out and text to a row's number and its words' keys with an end.

    Rows that are ``met`` follow: keys of words with their checks and how often they come in what is not held out.
    """

    def to_words(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from pagewright.llm.encoding import slices

        names = [x.split()[0] for x in WORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 3, pa.bool_()]

        def met(parts):
            key, check, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key)
            key, check, n = key[order], check[order], n[order]
            firsts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]))
            found = key[firsts], check[firsts], np.add.reduceat(n, firsts)
            for at in range(0, len(firsts), 50_000):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (c[at : at + 50_000] for c in found)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:3]), *lists, pa.array([True])], names=names)

        row = TaskContext.get().partitionId() << 40
        parts, held = [], 0
        for batch in batches:
            for some in slices(batch):
                words, codes, sizes = word_codes(some.column(2))
                n, ends = len(sizes), np.cumsum(sizes + 1)
                key, check = digest(words, salt)
                ids = np.zeros(int(ends[-1]) if n else 0, np.int64)
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                ids[inner] = key[codes]
                bounds = np.concatenate([[0], ends]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), some.column(0), some.column(1), lists, *(pa.nulls(n, k) for k in kinds[4:6]), pa.array(np.zeros(n, bool))], names=names)
                row += n
                learnt = ~some.column(1).to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(codes[np.repeat(learnt, sizes)], minlength=len(words))
                parts.append((np.append(key, 0), np.append(check, 0), np.append(counts, learnt.sum())))
                held += len(words) + 1
                if held > most:
                    yield from met(parts)
                    parts, held = [], 0
        if parts:
            yield from met(parts)

    return to_words


def _coded(docs: DataFrame, salt: int = 0) -> tuple[DataFrame, DataFrame, int, int]:
    """All rows' words, the counts of those that are not held out, and the numbers of tokens and of kinds of these.

    No two words of any row have one key: where two do, another salt is tried.
    """
    while True:
        coded = materialise(docs.select("doc_id", "held_out", "text").mapInArrow(_to_words(salt), WORDS), "words", TEXTS, codec="zstd", parted="met", options=DICTIONARY)
        met = coded.where("met").select(F.inline(F.arrays_zip("words", "checks", "counts")))
        counts = met.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("n"), (F.min("checks") != F.max("checks")).alias("shared"))
        counts = materialise(counts, "word-counts")
        tokens, kinds, shared = counts.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.bool_or("shared")).first()
        if not shared:
            remove(docs.sparkSession, f"{coded._work_path}/met=true")
            rows = coded.where("not met").select("row", "doc_id", "held_out", "words")
            rows._work_path = coded._work_path
            return rows, counts, tokens or 0, kinds
        discard(coded, counts)
        salt += 1


def bucket_count(tokens: int, of_bucket: int | None = None) -> int:
    return max(1, -(-tokens // (of_bucket or BUCKET_TOKENS)))


def bucket_of(key, buckets: int):
    """A key's bucket; the same for a column and for an array."""
    if isinstance(key, Column):
        return F.pmod(F.shiftright(key, 20), F.lit(buckets)).cast("int")
    return (key >> 20) % buckets


def turn_of(key, turns: int):
    """A key's round, from bits that its bucket of a round does not depend on."""
    return ((key >> 44 & 0xFFFF) * turns) >> 16


def _split(bucket, *columns):
    """Each bucket in order with its parts of the columns, as bytes; what is in a bucket stays in order."""
    import numpy as np

    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(firsts[1:], len(bucket))
    sorted_ = [c[order] for c in columns]
    return bucket[firsts].astype(np.int32), [[c[a:b].tobytes() for a, b in zip(firsts.tolist(), ends.tolist())] for c in sorted_]


def _count_next(d: int, contexts, nexts, buckets: int, turn: int = 0, turns: int = 1, most: int = 1_200_000):
    """Arrow function: counts of contexts of d words, which may be candidates, with each next word, by bucket.

    ``nexts`` holds what can follow: the same n-gram without its oldest word. Only contexts of the round ``turn`` count.
    """

    def count(batches):
        import numpy as np
        import pyarrow as pa

        from pagewright.llm.encoding import forget, slices, trim

        forget()
        contexts_, nexts_ = contexts.value, nexts.value

        def summed(parts):
            c, w = (np.concatenate(x) for x in zip(*parts))
            key, first, n = np.unique(mixed(c, w), return_index=True, return_counts=True)
            c, w = c[first], w[first]
            # In order of contexts, so that the many n-grams of one are packed well.
            order = np.argsort(c)
            names, parts = _split(bucket_of(key, buckets)[order], c[order], w[order], n[order].astype(np.int32))
            for at in range(0, len(names), 64):
                some = slice(at, at + 64)
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), *(pa.array(x[some], pa.binary()) for x in parts)], names=["bucket", "ctx", "word", "n"])

        parts, held = [], 0
        for batch in batches:
            for some in slices(batch, 2 << 20):
                words = some.column(0).flatten().to_numpy()
                # What goes on in a next text has an end in its context, and no candidate has one.
                n = max(0, len(words) - d)
                key = words[:n]
                for k in range(1, d):
                    key = mixed(key, words[k : k + n])
                at = np.flatnonzero(turn_of(key, turns) == turn) if turns > 1 else np.arange(n)
                at = at[may_hold(contexts_, key[at])]
                after = words[at + 1]
                for k in range(2, d + 1):
                    after = mixed(after, words[at + k])
                at = at[may_hold(nexts_, after)]
                parts.append((key[at], words[at + d]))
                held += len(at)
                if held > most:
                    yield from summed(parts)
                    parts, held = [], 0
                    trim()
        if held:
            yield from summed(parts)

    return count


def _joined(column, kind):
    import numpy as np

    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()] or [np.zeros(0, kind)])


def _total(least: int):
    """A bucket's n-grams (ctx, word) with their counts of all tasks, those below ``least`` left out."""

    def total(table):
        import numpy as np
        import pyarrow as pa

        c, w, n = _joined(table["ctx"], np.int64), _joined(table["word"], np.int64), _joined(table["n"], np.int32)
        _, first, at = np.unique(mixed(c, w), return_index=True, return_inverse=True)
        sums = np.bincount(at, n, len(first)).astype(np.int64)
        first, sums = first[sums >= least], sums[sums >= least]
        return pa.table({"ctx": c[first], "word": w[first], "n": sums})

    return total


def fit_tables(docs: DataFrame, depth: int = 3, least_context: int = 20, least_next: int = 3, mu: float = 5.0) -> tuple[DataFrame, DataFrame, int, int]:
    """The tree of the texts that are not held out, as a table of n-grams, with all rows' words, and the numbers of
    training tokens and of their kinds.

    An n-gram's key is its word's key, or the xxhash64 of the key of all but its newest word and that word. ``base``
    is what it adds to the base score, ``more`` what it adds to the difference of score and base score: a context
    its state's rest, an entry the ratio of its chance to what its suffix and the rest would give. A token's score is
    the sum over the n-grams that end in it (entries) or before it (contexts), as the suffixes of states are states
    and those of entries are entries.
    """
    spark = docs.sparkSession
    share = lambda x: spark.sparkContext.broadcast(x)
    coded, all_counts, tokens, kinds = _coded(docs)
    train = coded.where("not held_out").select("words")
    counts = all_counts.where("n > 0").select("word", "n")
    unknown = -math.log10(tokens + kinds + 1)
    # Of each length: the candidates (ctx, total, and the key without its oldest word) and the chances in their suffixes.
    contexts = counts.where((F.col("n") >= least_context) & (F.col("word") != END_ID)).select(F.col("word").alias("ctx"), F.col("n").alias("total"), F.lit(None).cast("long").alias("older"))
    below = counts.where(F.col("n") >= least_next).select(F.col("word").alias("suffix"), (F.log10(F.col("n") + 1.0) + unknown).alias("below"))
    grams = counts.select(F.col("word").alias("key"), "n", F.log10(F.col("n") + 1.0).alias("base"), F.lit(1).alias("known"), F.lit(0.0).alias("delta"))
    values, used = [], [all_counts]
    for d in range(1, depth + 1):
        inner, after = share(key_filter(contexts, "ctx")), share(key_filter(below, "suffix"))
        # Each place of a context has one next word, so what is shuffled follows the number of these places.
        places = contexts.agg(F.sum("total")).first()[0] or 0
        turns = max(1, min(COUNT_ROUNDS, -(-COUNT_ROUNDS * places // max(1, tokens)), bucket_count(places)))
        buckets, parts = bucket_count(-(-places // turns)), []
        for turn in range(turns):
            counted = train.mapInArrow(_count_next(d, inner, after, buckets, turn, turns), COUNTED)
            parts.append(materialise(counted.groupBy("bucket").applyInArrow(_total(least_next), FOUND), "found", WORD_LISTS))
        found = functools.reduce(DataFrame.unionByName, parts)
        keys = {"key": F.xxhash64("ctx", "word"), "suffix": F.col("word") if d == 1 else F.xxhash64("older", "word")}
        tested = materialise(found.join(contexts, "ctx").withColumns(keys).join(below, "suffix").drop("older"), "entries")
        discard(*parts)
        inner.destroy()
        after.destroy()
        p, chance = F.pow(F.lit(10.0), F.col("below")), F.col("n") / (F.col("total") + mu)
        sums = tested.groupBy("ctx").agg(
            F.sum(2 * F.col("n") * F.log(F.col("n") / (F.col("total") * p))).alias("g"), F.count("*").alias("kinds"), F.sum("n").alias("taken"),
            F.sum(p).alias("p"), F.sum(chance).alias("given"), F.first("total").alias("all"),
        )
        left = F.col("all") - F.col("taken")
        g = F.col("g") + F.when(left > 0, 2 * left * F.log(left / F.greatest(F.col("all") * (1 - F.col("p")), F.lit(1e-9)))).otherwise(0.0)
        # Under the suffix's predictions g has about as many degrees of freedom as there are kinds.
        diverging = sums.where(g > F.col("kinds") + 4 * F.sqrt(2.0 * F.col("kinds")))
        rest = F.log10(F.greatest((1 - F.col("given")) / F.greatest(1 - F.col("p"), F.lit(1e-12)), F.lit(1e-300)))
        states = materialise(diverging.select("ctx", rest.alias("rest")), "states")
        # Rarer n-grams are no contexts, and need not meet the states.
        values.append(grams.where(F.col("n") < least_context).select("key", "n", "base", "known", F.col("delta").alias("more")))
        values.append(grams.where(F.col("n") >= least_context).join(states.select(F.col("ctx").alias("key"), "rest"), "key", "left").select("key", "n", "base", "known", (F.col("delta") + F.coalesce("rest", F.lit(0.0))).alias("more")))
        log = F.log10(chance)
        entries = materialise(tested.join(states, "ctx").select("key", "suffix", "word", "n", log.alias("log"), (log - F.col("below") - F.col("rest")).alias("delta")), "kept-entries")
        discard(tested)
        longer = entries.where((F.col("n") >= least_context) & (F.col("word") != END_ID)).join(states.select(F.col("ctx").alias("suffix")), "suffix")
        contexts = materialise(longer.select(F.col("key").alias("ctx"), F.col("n").alias("total"), F.col("suffix").alias("older")), "contexts")
        used += [states, entries, contexts]
        below = entries.select(F.col("key").alias("suffix"), F.col("log").alias("below"))
        grams = entries.select("key", "n", F.lit(0.0).alias("base"), F.lit(0).alias("known"), "delta")
    values.append(grams.select("key", "n", "base", "known", F.col("delta").alias("more")))
    table = values[0]
    for more in values[1:]:
        table = table.unionByName(more)
    table = materialise(table, "n-grams")
    discard(*used)
    return table, coded, tokens, kinds


def score_tables(coded: DataFrame, table: DataFrame, tokens: int, kinds: int, depth: int = 3, common_share: float = 2e-6, last: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of each coded row.

    N-grams of at least ``common_share`` of the tokens (at most 2 million) are sent to the tasks, which spares them the
    shuffle; all others meet their values in their bucket. ``last``: rows and table are not needed any more.
    """
    import numpy as np

    sc = coded.sparkSession.sparkContext
    is_common = F.col("n") >= max(2, math.ceil(common_share * tokens))
    common = table.where(is_common).select("key", "base", "known", "more").toArrow()
    order = np.argsort(common["key"].to_numpy())
    cold = table.where(~is_common)
    hot = [common[c].to_numpy()[order] for c in ("key", "base", "known", "more")]
    slots = np.zeros(1 << SLOT_BITS, np.int32)
    slots[hot[0] & ((1 << SLOT_BITS) - 1)] = np.arange(1, len(order) + 1)
    shared = sc.broadcast((*hot, slots, key_filter(cold, "key")))

    # Of a bucket only what the rows of one round ask is in memory.
    turns = min(ROUNDS, bucket_count(tokens, LOOKED_UP_TOKENS))
    buckets = bucket_count(tokens, LOOKED_UP_TOKENS * turns)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        from pagewright.llm.encoding import forget, slices

        forget()
        keys, base, known, more, slots, cold_bits = shared.value
        schema = _schema(PLACED)
        for batch in batches:
            for some in (x.slice(at, CHUNK) for x in slices(batch, 2 << 20) for at in range(0, x.num_rows, CHUNK)):
                words, starts, sizes = _laid_out(some.column(3))
                n = len(sizes)
                if not n:
                    continue
                owner = np.repeat(np.arange(n), sizes)
                sums = np.zeros((3, n))
                owners, colds = [], []
                live, key = np.arange(len(words)), words
                for length in range(1, depth + 2):
                    if length > 1:
                        # Both parts of an n-gram that has a value have one.
                        had = np.zeros(len(words), bool)
                        had[live] = ok
                        full = np.zeros(len(words), np.int64)
                        full[live] = key
                        live = live[ok & (live - (length - 1) >= starts[live])]
                        live = live[had[live - 1]]
                        key = mixed(full[live - 1], words[live])
                    ok = may_hold(cold_bits, key)
                    at = slots[key & ((1 << SLOT_BITS) - 1)]
                    asked = np.flatnonzero(at)
                    at = at[asked].astype(np.int64) - 1
                    other = np.flatnonzero(keys[at] != key[asked])
                    at[other] = Tree.find(keys, key[asked[other]])
                    asked, at = asked[at >= 0], at[at >= 0]
                    for i, column in enumerate((known, base, more)):
                        sums[i] += np.bincount(owner[live[asked]], column[at], n)
                    ok[asked] = False
                    owners.append(owner[live[ok]])
                    colds.append(key[ok])
                    ok[asked] = True
                of, key = np.concatenate(owners).astype(np.uint16), np.concatenate(colds)
                names, (places, asked) = _split(bucket_of(key, buckets), of, key)
                first = some.column(0)[0].as_py()
                chunk = pa.array(np.full(n + len(names), first))
                told = [*some.columns[:3], pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
                none = lambda count, kind: pa.nulls(count, kind)
                # Rows of documents pass through one bucket or another on their way to what is summed for them.
                docs = [*told, pa.array(np.full(n, (first + (first >> 40)) % buckets, np.int32)), none(n, pa.binary()), none(n, pa.binary())]
                packed = [*(none(len(names), x.type) for x in told), pa.array(names, pa.int32()), pa.array(places, pa.binary()), pa.array(asked, pa.binary())]
                both = [chunk, *(pa.concat_arrays([x, y]) for x, y in zip(docs, packed))]
                yield pa.RecordBatch.from_arrays(both, schema=schema)

    named = materialise(cold.select("key", "known", "base", "more").mapInArrow(_name(buckets), NAMED), "named")
    if last:
        discard(table)
    parts = []
    for turn in range(turns):
        rows = coded.where(F.pmod("row", F.lit(turns)) == turn).select("row", "doc_id", "held_out", "words")
        asked = rows.mapInArrow(place, PLACED)
        found = asked.groupBy("bucket").cogroup(named.groupBy("bucket")).applyInArrow(_look_up, LOOKED_UP)
        parts.append(materialise(found.groupBy("chunk").applyInArrow(_add_up, DOCS), "scored", WORD_LISTS))
    if last:
        discard(coded)
    shared.destroy()
    base = F.col("base") - math.log10(tokens + kinds + 1) * F.col("n_tokens")
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", base.alias("base_score"), (base + F.col("more")).alias("score"))


def _schema(ddl: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _name(buckets: int, most: int = 500_000):
    """Arrow function: n-grams and their values as arrays of a bucket, in order of their keys."""

    def name(batches):
        import numpy as np
        import pyarrow as pa

        def packed(parts):
            columns = [np.concatenate(x) for x in zip(*parts)]
            order = np.argsort(columns[0])
            key, known, base, more = (c[order] for c in columns)
            names, columns = _split(bucket_of(key, buckets), key, known.astype(np.int8), base, more)
            for at in range(0, len(names), 8):
                some = slice(at, at + 8)
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), *(pa.array(x[some], pa.binary()) for x in columns)], schema=_schema(NAMED))

        parts, held = [], 0
        for batch in batches:
            parts.append([c.to_numpy() for c in batch.columns])
            held += batch.num_rows
            if held > most:
                yield from packed(parts)
                parts, held = [], 0
        if held:
            yield from packed(parts)

    return name


def _look_up(asked, named):
    """What the n-grams of a bucket give the documents of each chunk, summed for each document; documents pass."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = _joined(named["keys"], np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    columns = [_joined(named[c], kind)[order] for c, kind in (("known", np.int8), ("base", np.float64), ("more", np.float64))]
    rows = []
    asks = asked.filter(pc.is_valid(asked["keys"]))
    for chunk, at, key in zip(asks["chunk"].to_pylist(), asks["at"], asks["keys"]):
        place = Tree.find(keys, np.frombuffer(key.as_buffer(), np.int64))
        owner, mine = np.unique(np.frombuffer(at.as_buffer(), np.uint16)[place >= 0], return_inverse=True)
        sums = [np.bincount(mine, c[place[place >= 0]], len(owner)) for c in columns]
        rows.append((chunk, owner.tobytes(), *(x.tobytes() for x in sums)))
    schema = _schema(LOOKED_UP)
    names = ["chunk", "at", "sum_known", "sum_base", "sum_more"]
    sums = dict(zip(names, zip(*rows) if rows else [[]] * 5))
    docs = asked.filter(pc.is_null(asked["keys"]))
    given = [pa.table([docs[f.name] if f.name in docs.column_names and f.name != "at" else pa.nulls(docs.num_rows, f.type) for f in schema], schema=schema)]
    given.append(pa.table([pa.array(sums[f.name], f.type) if f.name in sums else pa.nulls(len(rows), f.type) for f in schema], schema=schema))
    return pa.concat_tables(given)


def _add_up(found):
    """The documents of a chunk with what their n-grams of all buckets give them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    docs = found.filter(pc.is_valid(found["row"])).sort_by("row")
    sums = found.filter(pc.is_null(found["row"]))
    n = docs.num_rows
    owner = _joined(sums["at"], np.uint16).astype(np.int64)
    known, base, more = (np.bincount(owner, _joined(sums[f"sum_{c}"], np.float64), n) for c in ("known", "base", "more"))
    out = {c.split()[0]: docs[c.split()[0]] for c in DOCS.split(", ")}
    out["n_known"] = pa.array(docs["n_known"].to_numpy() + known.astype(np.int64))
    out["base"], out["more"] = pa.array(docs["base"].to_numpy() + base), pa.array(docs["more"].to_numpy() + more)
    return pa.table(out)


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a tree of those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    table, coded, tokens, kinds = fit_tables(docs)
    scored = score_tables(coded, table, tokens, kinds, last=True)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
