"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents. The whole part is taken
as it is; the fractions are rounded together. Two documents at a time, a random amount of mass, counted in words,
moves from one to the other until one of them has a whole number of copies; each keeps its expectation, and the
words of the two together do not change. Within a source, documents are dealt by a hash of their content into
groups of about ``group_rows``. A group takes its documents largest first: the one that is still open meets the next
largest. If one that matters is open at the end, smaller ones that were rounded the other way make up for its rounding
(``exchanged``), until a small one is open; this shifts the chances of single documents a little, in small sources most. Each group's last document goes up a reduction tree, where documents are
paired alike, until one is left for the source, which gets the nearer whole number. So a source misses its target by at
most half of that document's words; it is among the smallest unless one document outweighs the rest of its source.

Rows alike in all columns are one item with as many copies to expect as they have together; the copies are then dealt
evenly to the rows, so a row repeated any number of times is neither numbered nor listed.

Choices follow from a seed and the documents alone, not from how Spark deals them, so reruns agree.

Defined results: a null source is a source of its own, the last; a null or empty text has no words and keeps the
whole part of its copies, the rest being drawn; a text of any length counts whole; rows with a null or repeated doc_id
are documents like any other; a table without words takes nothing (targets 0); an empty table gives no rows. The stage
hands on columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import discard, materialise, numbered, read_table, restored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
#: Nearer to a whole number than this counts as whole.
WHOLE = 1e-9
#: Share of a group's words to take by which its last document may miss them without an exchange.
NEAR = 1e-3


def targets(sizes: list[int], weights: list[float], most: float = MOST_COPIES) -> list[float]:
    """Shares of all sizes by weight, none above ``most`` times its source's size, the excess reshared by weight.

    Sources reach their limits in the order of limit over weight: once one does not, no later one does.
    """
    out = [0.0] * len(sizes)
    left, scale = float(sum(sizes)), float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for k, i in enumerate(order):
        if left * weights[i] <= most * sizes[i] * scale:
            for j in order[k:]:
                out[j] = left * weights[j] / scale
            break
        out[i] = most * sizes[i]
        left, scale = left - out[i], scale - weights[i]
    return out


def pivotal(sizes: list[int], parts: list[float], keys: list[int], seed: int) -> tuple[list[int], list[float], int]:
    """Round fractions in the given order; -1 stands for not settled in the first list of the result.

    Gives 0 or 1 for each settled item, all fractions as they end, and the place of the item that is left (-1: none).
    """
    up = [-1] * len(sizes)
    parts = list(parts)
    left = -1
    for i, size in enumerate(sizes):
        if parts[i] <= WHOLE or parts[i] >= 1 - WHOLE or size <= 0:
            # Items without words do not move mass; they round by themselves.
            up[i] = int(_draw(keys[i], keys[i], seed) < parts[i]) if WHOLE < parts[i] < 1 - WHOLE else int(parts[i] > 0.5)
            continue
        if left < 0:
            left = i
            continue
        a, b = left, i
        to_a = min((1 - parts[a]) * sizes[a], parts[b] * sizes[b])
        to_b = min(parts[a] * sizes[a], (1 - parts[b]) * sizes[b])
        if _draw(keys[a], keys[b], seed) * (to_a + to_b) < to_b:
            parts[a] += to_a / sizes[a]
            parts[b] -= to_a / sizes[b]
        else:
            parts[a] -= to_b / sizes[a]
            parts[b] += to_b / sizes[b]
        left = -1
        for k in (a, b):
            if parts[k] <= WHOLE or parts[k] >= 1 - WHOLE:
                up[k] = int(parts[k] > 0.5)
            else:
                left = k
    return up, parts, left


def exchanged(sizes: list[int], given: list[float], up: list[int], part: float, left: int, keys: list[int], seed: int) -> tuple[list[int], float, int]:
    """Move the open place from a large item to a small one of the same group.

    The open item becomes whole, up with the chance of its fraction. The words that this takes or sets free are made up
    for by items of at most its size that were rounded the other way, in the order of their hashes; the one that would
    be too many stays open for the rest and is the next to become whole. Words are the same throughout, and in
    expectation as many leave the items rounded up as reach those rounded down. Ends when no smaller item can make up
    for it. Gives the items, the fraction of the one that is open by then, and its place.
    """
    up = list(up)
    free = [i for i in range(len(sizes)) if sizes[i] > 0 and WHOLE < given[i] < 1 - WHOLE]
    order = sorted(free, key=lambda i: _draw(keys[i], 17, seed))
    while True:
        size = sizes[left]
        drawn = _draw(keys[left], size, seed + 1) < part
        for rise in (drawn, not drawn):  # the other way only where smaller items do not have the words
            rest = (1 - part if rise else part) * size
            pool = [i for i in order if up[i] == int(rise) and sizes[i] < size]
            swapped = []
            for i in pool:
                if sizes[i] <= rest + WHOLE:
                    swapped.append(i)
                    rest -= sizes[i]
            taken = set(swapped)
            opened = min((i for i in pool if i not in taken and sizes[i] > rest), key=lambda i: sizes[i], default=-1)
            if rest <= WHOLE or opened >= 0:
                break
        else:
            return up, part, left
        up[left] = int(rise)
        for i in swapped:
            up[i] = int(not rise)
        if rest <= WHOLE:
            return up, 0.0, -1
        left, part = opened, 1 - rest / sizes[opened] if rise else rest / sizes[opened]
        up[left] = -1


def _draw(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) from two keys and a seed."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def source_targets(items: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target and items of each source. A row per source of the mixture goes to the driver."""
    sums = items.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.count("*").alias("n")).collect()
    rows = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["s"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))])
    told = [(r["source"], r["s"], g, r["n"]) for r, g in zip(rows, goal)]
    return items.sparkSession.createDataFrame(told, "of string, source_size long, target double, n_items long")


KEPT = "source string, size long, n long, key long, key2 long, source_size long, target double, node long"
SETTLED = KEPT + ", copies long, part double, is_open boolean"


def mix(items: DataFrame, seed: int = 20, group_rows: int = 1024, fan_in: int = 16, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Copies to take of each item, all its rows together.

    ``items``: source, size (words of a row), n (rows), key and key2, two longs that tell items apart.
    Adds source_size, target and copies.
    """
    goal = source_targets(items, weights)
    n_groups = F.ceil(F.col("n_items") / group_rows)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    dealt = items.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "size", "n", "key", "key2", "source_size", "target", F.lit(0).cast("long").alias("copies"), (share * F.col("n")).alias("part"),
        F.pmod(F.xxhash64("key", "key2", F.lit(seed)), n_groups).cast("long").alias("node"), (n_groups > 1).alias("more"),
    )
    first = materialise(dealt.groupBy("source", "node").applyInArrow(_settle(seed), SETTLED), "mixed")
    done, rest = [first.where("not is_open")], first.where("is_open")
    nodes = first.agg(F.max("node")).first()[0]
    while nodes:
        nodes = nodes // fan_in
        up = rest.withColumn("node", F.expr(f"node div {fan_in}")).withColumn("more", F.lit(nodes > 0))
        level = materialise(up.groupBy("source", "node").applyInArrow(_settle(seed), SETTLED), "mixed")
        done.append(level.where("not is_open"))
        rest = level.where("is_open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("source", "size", "n", "key", "key2", "source_size", "target", "copies")


def _settle(seed: int):
    """One group: settles all items but one; the root of a source's tree settles that as well."""

    def settle(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.sort_by([("size", "descending"), ("key", "ascending"), ("key2", "ascending")])
        sizes, keys, part = table["size"].to_pylist(), table["key"].to_pylist(), table["part"].to_pylist()
        whole = [int(p + WHOLE) for p in part]
        given = [max(0.0, p - w) for p, w in zip(part, whole)]
        up, part, left = pivotal(sizes, given, keys, seed)
        if left >= 0 and sizes[left] * min(part[left], 1 - part[left]) > NEAR * sum(a * b for a, b in zip(given, sizes)):
            up, own, left = exchanged(sizes, given, up, part[left], left, keys, seed)
            part = [own] * len(part)
        if left >= 0 and not table["more"][0].as_py():
            up[left] = int(part[left] >= 0.5)  # the nearer number: one document a source is not left to chance
            left = -1
        copies = [c + w + max(u, 0) for c, w, u in zip(table["copies"].to_pylist(), whole, up)]
        kept = {c.split()[0]: table[c.split()[0]] for c in KEPT.split(", ")}
        is_open = pc.equal(pa.array(range(table.num_rows), pa.int64()), left)
        return pa.table(kept | {"copies": pa.array(copies, pa.int64()), "part": pa.array(part, pa.float64()), "is_open": is_open})

    return settle


def _repeated(df: DataFrame, times, name: str = "nth") -> DataFrame:
    """Each row ``times`` times, numbered from 0; no array holds more than 65,536 numbers."""
    chunked = df.where(times > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / 65_536))))
    last = F.least(times - 1, F.col("chunk") * 65_536 + 65_535)
    return chunked.withColumn(name, F.explode(F.sequence(F.col("chunk") * 65_536, last))).drop("chunk")


def _copies_of_row(nth):
    """The share of its item's copies that the row of this number gets."""
    return F.floor(F.col("copies") / F.col("n")) + (nth < F.col("copies") % F.col("n")).cast("long")


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = read_table(spark, sf_dir, "documents")
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    id_ = F.col("doc_id").cast("long")
    keys = _keys([id_, source, text])
    rows = docs.select(id_.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), *keys)
    items = rows.groupBy("key", "key2").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")], F.count("*").alias("n"))
    items = materialise(items, "items")
    mixed = mix(items.drop("doc_id")).join(items.select(F.col("key").alias("a"), F.col("key2").alias("b"), "doc_id"), (F.col("key") == F.col("a")) & (F.col("key2") == F.col("b")))
    each = _repeated(mixed, F.col("n")).withColumn("copies", _copies_of_row(F.col("nth")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _keys(columns: list) -> list:
    """Two hashes that tell rows apart by some columns, their nulls included."""
    seen = [x for c in columns for x in (c, c.isNull())]
    return [F.xxhash64(*seen).alias("key"), F.xxhash64(F.lit(1), *seen[::-1]).alias("key2")]


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or up to three times."""
    inner, names = numbered(docs)
    # Other than strings and numbers, columns are compared as JSON, as maps have no hash.
    plain = ("string", "bigint", "int", "double", "float", "boolean", "smallint", "tinyint", "date", "timestamp", "binary")
    compared = [F.col(c) if kind in plain or kind.startswith("decimal") else F.to_json(F.struct(c)) for c, kind in inner.dtypes]
    source, text = F.col(names["source"]).cast("string"), F.col(names["text"]).cast("string")
    keyed = inner.withColumns(dict(zip(("key", "key2"), _keys(compared))))
    rows = keyed.select("key", "key2", source.alias("source"), word_count(text).alias("size"))
    items = materialise(rows.groupBy("key", "key2").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("n")), "items")
    mixed = mix(items)
    taken = materialise(mixed.where("copies > 0").select(F.col("key").alias("a"), F.col("key2").alias("b"), "copies"), "taken")
    discard(items)
    one = keyed.dropDuplicates(["key", "key2"])
    joined = one.join(taken, (F.col("key") == F.col("a")) & (F.col("key2") == F.col("b")))
    return restored(_repeated(joined, F.col("copies")), names)
