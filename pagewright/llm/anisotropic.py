"""Approximate maximum inner product search with score-aware quantisation.

Vectors are put into cells (k-means) and what is left of them after their cell's centre is quantised in 2-wide
subspaces of 16 codewords, four bits each. Codewords and codes minimise an anisotropic loss that penalises the part
of a vector's residual error along the vector ``eta`` times as much as the rest, for it moves the inner products
with the queries that matter. A query visits the cells whose centres are nearest, adds up entries of its lookup
tables by the codes, and reranks the best by exact inner products in double precision: at least ``keep`` of a block,
and all that come within the codes' usual error of its k-th best, so that many rows that are nearly alike are told
apart by their vectors.

The index has about a third of the square root of the number of rows as cells, ``MOST_CELLS`` at most. It is fitted on a
sample of at least ``sample_rows`` vectors and twelve a cell (by hash), and so is the number of cells that a query
visits: the fewest that hold ``cell_recall`` of the sample's exact neighbours. Every row is indexed. Cells are cut into
blocks of about ``block_rows`` rows, so that a large cell is searched by many tasks. A query that finds too few rows in
its cells is searched again in all of them.

Defined results: rows are told apart by a number of their own, so rows that share an id, or have none, are candidates
and queries like any other (a query is never its own candidate, but rows with its id are); vectors that are null, empty,
zero, or hold null or non-finite components take no part, nor do those of another length than most, with which there is
no inner product; equal scores rank by id, null last, and all copies of a vector have the same code; fewer than k
candidates give them all; an empty table gives no rows. Columns other than the two named ones, whatever their names, are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import discard, materialise, read_table

SUB = 2
WORDS = 16
#: Most cells of an index, whose centres are fitted on the driver. Beyond, cells have more blocks.
MOST_CELLS = 16_384
#: Vectors of the sample on which codewords are fitted.
CODED = 12_000


def k_means(x, k: int, seed: int, rounds: int = 12):
    import numpy as np

    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=len(centres))
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = x[r.choice(len(x), int((~full).sum()))]
    return centres


def nearest(x, centres):
    import numpy as np

    square, step = (centres**2).sum(1), max(1, (1 << 22) // len(centres))
    return np.concatenate([(square - 2 * (x[at : at + step] @ centres.T)).argmin(axis=1) for at in range(0, max(len(x), 1), step)])


class Index:
    """Cells, codewords and how many cells a query visits."""

    def __init__(self, x, cells: int, eta: float, seed: int = 7, rounds: int = 5):
        import numpy as np

        self.dim = x.shape[1]
        self.pad = -self.dim % (2 * SUB)
        self.eta = eta
        self.centres = k_means(x, cells, seed)
        x = x[:CODED]
        own = nearest(x, self.centres)
        rest, unit = self._split(x, own)
        subs = rest.shape[1] // SUB
        self.words = np.stack([self._fill(k_means(rest[:, SUB * m : SUB * m + SUB], WORDS, seed + m, 6)) for m in range(subs)])
        for _ in range(rounds):
            codes = self._codes(rest, unit)
            self._fit(rest, unit, codes)

    @staticmethod
    def _fill(words):
        import numpy as np

        return np.vstack([words, np.repeat(words[-1:], WORDS - len(words), axis=0)]) if len(words) < WORDS else words

    def _split(self, x, own):
        """Residuals and directions, padded to whole bytes of codes."""
        import numpy as np

        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        wide = ((0, 0), (0, self.pad))
        return np.pad(x - self.centres[own], wide), np.pad(unit, wide)

    def _codes(self, rest, unit, passes: int = 2):
        """Codes by coordinate descent on the anisotropic loss, starting from the nearest codewords."""
        import numpy as np

        subs = len(self.words)
        codes = np.empty((len(rest), subs), np.int64)
        along = np.zeros(len(rest))
        parts = []
        for m in range(subs):
            gap = rest[:, None, SUB * m : SUB * m + SUB] - self.words[m]
            square, dot = (gap**2).sum(2), np.einsum("ncs,ns->nc", gap, unit[:, SUB * m : SUB * m + SUB])
            codes[:, m] = square.argmin(1)
            along += np.take_along_axis(dot, codes[:, m : m + 1], 1)[:, 0]
            parts.append((square, dot))
        for _ in range(passes):
            for m, (square, dot) in enumerate(parts):
                other = along - np.take_along_axis(dot, codes[:, m : m + 1], 1)[:, 0]
                codes[:, m] = (square + (self.eta - 1) * (other[:, None] + dot) ** 2).argmin(1)
                along = other + np.take_along_axis(dot, codes[:, m : m + 1], 1)[:, 0]
        return codes

    def _fit(self, rest, unit, codes) -> None:
        """Codewords that minimise the loss for given codes, a subspace at a time."""
        import numpy as np

        subs = len(self.words)
        error = rest - self.words[np.arange(subs), codes].reshape(rest.shape)
        along = (error * unit).sum(1)
        for m in range(subs):
            at = slice(SUB * m, SUB * m + SUB)
            own, u, x = codes[:, m], unit[:, at], rest[:, at]
            other = along - (error[:, at] * u).sum(1)
            left, right = np.zeros((WORDS, SUB, SUB)), np.zeros((WORDS, SUB))
            np.add.at(left, own, np.eye(SUB) + (self.eta - 1) * u[:, :, None] * u[:, None, :])
            np.add.at(right, own, x + (self.eta - 1) * u * (other + (x * u).sum(1))[:, None])
            used = np.bincount(own, minlength=WORDS) > 0
            self.words[m][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            error[:, at] = x - self.words[m][own]
            along = other + (error[:, at] * u).sum(1)

    def encode(self, x):
        """Cells and packed codes, two codes to a byte."""
        import numpy as np

        own = nearest(x, self.centres)
        codes = self._codes(*self._split(x, own))
        return own, (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def decode(self, own, packed):
        """The vectors that cells and codes stand for."""
        import numpy as np

        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)
        return self.centres[own] + self.words[np.arange(len(self.words)), codes].reshape(len(packed), -1)[:, : self.dim]

    def tables(self, q):
        """For each query and byte of codes, the inner products with the 256 pairs of codewords."""
        import numpy as np

        wide = np.pad(q, ((0, 0), (0, self.pad)))
        single = np.einsum("qms,mcs->qmc", wide.reshape(len(q), -1, SUB), self.words)
        low, high = single[:, 0::2], single[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), low.shape[1], 256).astype(np.float32)


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row (a number), id and vec (doubles) of each row that takes part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.where(F.col("vec").isNotNull() & fine & F.exists("vec", lambda v: v != 0))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vec"), "vectors")


def fit(vectors: DataFrame, total: int, k: int, sample_rows: int = 12_000, cell_recall: float = 0.99, threshold: float = 0.2) -> Index:
    """Fit an index on a hash sample; sets ``visits``, the number of cells that a query visits."""
    import numpy as np

    n_cells = max(1, min(MOST_CELLS, round(math.sqrt(total) / 3)))
    share = min(1.0, max(sample_rows, 12 * n_cells) / max(total, 1))
    hashed = vectors.select("vec", F.pmod(F.xxhash64("id", "vec"), F.lit(1_000_003)).alias("h"))
    chosen = hashed.where(F.col("h") < share * 1_000_003).select("vec").toArrow()
    if not chosen.num_rows:
        chosen = hashed.orderBy("h", "vec").limit(min(total, sample_rows)).select("vec").toArrow()
    x = chosen["vec"].combine_chunks().flatten().to_numpy().reshape(chosen.num_rows, -1)
    # Copies would make a few directions count for more than all others.
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(3).permutation(len(x))]
    d = x.shape[1]
    # Parallel errors count more by (d - 1) t**2 / (1 - t**2) for queries whose score is at least t of the largest.
    index = Index(x, n_cells, max(1.0, (d - 1) * threshold**2 / (1 - threshold**2)))
    q = x[:: max(1, len(x) // 256)]
    cells = nearest(x, index.centres)
    best = np.concatenate([np.argsort(-(q[at : at + 32] @ x.T), axis=1, kind="stable")[:, : min(k + 1, len(x))] for at in range(0, len(q), 32)])
    rank = np.argsort(np.argsort(-(q @ index.centres.T), axis=1, kind="stable"), axis=1)
    # By how much codes mistake the scores of neighbours, for a query of length 1.
    gap = np.concatenate([x[at : at + 2048] - index.decode(*index.encode(x[at : at + 2048])) for at in range(0, len(x), 2048)])
    error = np.einsum("qkd,qd->qk", gap[best], q) / np.linalg.norm(q, axis=1, keepdims=True)
    index.margin = 2.5 * float(np.sqrt((error**2).mean()))
    needed = np.sort(np.take_along_axis(rank, cells[best], 1).ravel())
    index.visits = int(needed[min(len(needed) - 1, math.ceil(cell_recall * len(needed)) - 1)]) + 1
    return index


def search(df: DataFrame, k: int = 20, every: int = 20, keep: int = 96, block_rows: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row whose id ``every`` divides."""
    spark = df.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    valid = _valid(df, id_col, vec_col)
    usual = valid.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    vectors = valid.where(F.size("vec") == (usual["n"] if usual else 0))
    total = vectors.count()
    if total < 2:
        return spark.createDataFrame([], out)
    index = fit(vectors, total, k)
    shared = spark.sparkContext.broadcast(index)

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        ix = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                x = np.frombuffer(some.column(2).flatten().to_numpy(), np.float64).reshape(some.num_rows, ix.dim)
                cells, codes = ix.encode(x)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], pa.array(cells, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["row", "id", "vec", "cell", "code"],
                )

    coded = materialise(vectors.mapInArrow(encode, "row long, id long, vec array<double>, cell long, code binary"), "codes")
    discard(valid)
    # A row for each cell, of which there are MOST_CELLS at most.
    blocks = {r["cell"]: max(1, math.ceil(r["count"] / block_rows)) for r in coded.groupBy("cell").count().collect()}
    counts = spark.createDataFrame(list(blocks.items()), "c long, n_blocks long")
    dealt = coded.join(F.broadcast(counts), F.col("cell") == F.col("c")).select(
        "row", "id", "vec", "code", "cell", F.pmod(F.xxhash64("row"), "n_blocks").alias("block")
    )

    def visit(all_cells: bool):
        def cells_of(batches):
            import numpy as np
            import pyarrow as pa

            ix = shared.value
            held = np.asarray(sorted(blocks))
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = np.frombuffer(batch.column(2).flatten().to_numpy(), np.float64).reshape(batch.num_rows, ix.dim)
                n = len(held) if all_cells else min(ix.visits, len(held))
                cells = held[np.argsort(-(q @ ix.centres[held].T), axis=1, kind="stable")[:, :n]]
                rows = [(i, c, b) for i, own in enumerate(cells.tolist()) for c in own for b in range(blocks[c])]
                take, cell, block = zip(*rows)
                take = pa.array(take)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(take) for c in batch.columns), pa.array(cell, pa.int64()), pa.array(block, pa.int64())],
                    names=["query", "query_id", "q", "cell", "block"],
                )

        return cells_of

    def scan(rows, queries):
        import numpy as np
        import pyarrow as pa

        ix = shared.value
        found: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # null ids last
            ids, numbers = rows["id"].to_pylist(), rows["row"].to_numpy()
            x = rows["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), ix.dim)
            codes = np.ascontiguousarray(np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1).T)
            qs = queries["q"].combine_chunks().flatten().to_numpy().reshape(queries.num_rows, ix.dim)
            names, own = queries["query"].to_pylist(), queries["query_id"].to_pylist()
            for at in range(0, len(names), 128):
                q = qs[at : at + 128]
                tables = ix.tables(q)
                scores = np.zeros((len(q), len(ids)), np.float32)
                for m, code in enumerate(codes):
                    scores += tables[:, m, code]
                for i, name in enumerate(names[at : at + 128]):
                    row = scores[i]
                    if len(ids) > keep:
                        top = np.partition(row, (len(row) - keep, len(row) - k))
                        least = min(top[len(row) - keep], top[len(row) - k] - ix.margin * np.linalg.norm(q[i]))
                        near = np.flatnonzero(row >= least)
                    else:
                        near = np.arange(len(ids))
                    near = near[numbers[near] != name]
                    exact = (x[near] * q[i]).sum(axis=1)  # unlike a matrix product, the same for copies wherever they stand
                    order = np.argsort(-exact, kind="stable")[:k]  # rows are in order of their ids
                    found += [(name, own[at + i], ids[j], e) for j, e in zip(near[order].tolist(), exact[order].tolist())]
        kinds = {"query": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds.items(), zip(*found) if found else [[]] * 4)})

    def nearest_of(queries: DataFrame, all_cells: bool) -> DataFrame:
        from pyspark.sql import Window

        sent = queries.mapInArrow(visit(all_cells), "query long, query_id long, q array<double>, cell long, block long")
        hits = dealt.groupBy("cell", "block").cogroup(sent.groupBy("cell", "block")).applyInArrow(scan, "query long, query_id long, vec_id long, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return materialise(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")

    queries = coded.where(F.col("id") % every == 0).select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("vec").alias("q"))
    first = nearest_of(queries, False)
    enough = first.where(F.col("rank") == min(k, total - 1)).select("query")
    short = queries.join(enough, "query", "left_anti")
    if short.limit(1).count():
        again = nearest_of(short, True)
        first = first.join(enough, "query", "left_semi").unionByName(again)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return search(read_table(spark, sf_dir, "embeddings"))
