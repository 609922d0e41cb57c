import math

import numpy as np
import pytest

from pagewright.llm import anisotropic as a


def data(n, d=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, d))
    x = (centres[r.integers(0, 8, n)] + 0.5 * r.normal(size=(n, d))).astype(np.float32)
    x[::50] = x[0]
    return x


def exact(x, ids, k=20):
    out = {}
    for i, name in enumerate(ids):
        if name % 20 == 0:
            s = x.astype(float) @ x[i].astype(float)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != name][:k]
            out[name] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_anisotropic_codes_cut_the_parallel_error():
    x = data(3000).astype(float)
    errors = {}
    for eta in (1.0, 4.0):
        ix = a.Index(x, 8, eta)
        rest, unit = ix._split(x, a.nearest(x, ix.centres))
        codes = ix._codes(rest, unit)
        gap = rest - ix.words[np.arange(len(ix.words)), codes].reshape(rest.shape)
        errors[eta] = ((gap * unit).sum(1) ** 2).mean()
        own, packed = ix.encode(x[:50])
        q = x[50:55]
        table = ix.tables(q)
        approx = sum(table[:, m, packed[:, m]] for m in range(packed.shape[1])) + (q @ ix.centres[own].T)
        want = q @ (ix.centres[own] + (rest - gap)[:50, : ix.dim]).T
        assert np.allclose(approx, want, atol=1e-4)
    assert errors[4.0] < 0.7 * errors[1.0]


@pytest.mark.parametrize("n,block", [(4000, 300), (4000, 4096), (15, 10)])
def test_recall_and_scores(spark, n, block):
    x = data(n)
    ids = np.arange(n) * 5
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, cell int").repartition(5)
    got = {}
    for r in a.search(df, block_rows=block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(x, ids)
    assert set(got) == set(want)
    hit = total = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, min(20, n - 1) + 1))
        assert all(math.isclose(s, float(x[q // 5].astype(float) @ x[v // 5].astype(float)), rel_tol=1e-9) for _, v, s in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hit += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
        total += len(want[q])
    assert hit / total >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (9, [5.0, 5.0]), (20, [0.0, 0.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(x) for x in a.search(df).collect()), key=lambda x: x[:2])
    first = [(0, 1, None, 6.0), (0, 2, 7, 1.0), (0, 3, 8, 1.0), (0, 4, 8, 1.0), (0, 5, 20, -6.0)]
    assert got == first + [(20, 1, 7, 0.0), (20, 2, 8, 0.0), (20, 3, 8, 0.0), (20, 4, None, -2.0), (20, 5, 0, -6.0)]
    both = a.search(df.where("vec_id in (0, 7)").union(df.where("vec_id = 0")).withColumns({c: df.vec_id for c in ("row", "q", "code")})).collect()
    assert sorted(tuple(x) for x in both) == [(0, 1, 0, 14.0), (0, 1, 0, 14.0), (0, 2, 7, 1.0), (0, 2, 7, 1.0)]
    assert a.search(df.limit(0)).count() == 0
