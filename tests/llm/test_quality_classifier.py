import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from pagewright.llm import quality_classifier as q


def test_network_is_calibrated():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (r.random(4000) < p).astype(float)
    n = q.Network(x[:3000], y[:3000], hidden=16, epochs=40)
    got = n.chances(x[3000:])
    assert np.abs(got - p[3000:]).mean() < 0.1
    assert q.Network(x[:0], y[:0]).chances(x[:3]).tolist() == [0.5] * 3


def test_rows(spark, tmp_path):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        good = r.random() < 0.6
        w = [f"word{r.randint(0, 200)}" for _ in range(r.randint(20, 60))]
        docs.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good), 0))
    docs += [(None, None), (3, ""), (5, docs[5][1]), (900, "x " * 30000)]
    labels += [(7, 1 - labels[7][1], 0), (8, None, 0), (None, 1, 0), (10**6, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'v' as vec", "1 as n").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = q.op8_random_indexing(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    truth = {i: y for i, y, _ in labels[:400]}
    out = [x.predicted == truth[x.doc_id] for x in got if x.held_out and x.doc_id in truth]
    assert sum(out) / len(out) > 0.95
    none = spark.createDataFrame([], "doc_id long, held_out boolean, text string")
    assert q.classify(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_vectors_against_plain(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["The", "cat,", "cat", "sat!", "DOG", "é", f"rare{r.randint(0, 500)}"]) for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", "the " * 9000]
    df = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").repartition(4)
    hashed = lambda w: xxhash.xxh64_intdigest(w.rstrip(q.MARKS).lower().encode())

    def index(w):
        h, out = hashed(w), np.zeros(q.DIM)
        for k in range(q.NONZERO):
            out[h >> (6 * k) & 63] += 1 - 2 * (h >> (48 + k) & 1)
        return out

    seqs = [(t or "").split() for t in texts]
    n = Counter(hashed(w) for s in seqs for w in s)
    total = sum(n.values())
    words = sorted(h for h, c in n.items() if c >= 0.003 * total)
    got = q.vocabulary(df.select("text"), 0.003)
    assert got.tolist() == words and 3 < len(words) < len(n)
    around, met, own = defaultdict(lambda: np.zeros(q.DIM)), Counter(), {}
    for s in seqs:
        for i, w in enumerate(s):
            own[hashed(w)] = index(w)
            for j in (i - 1, i + 1):
                if 0 <= j < len(s):
                    around[hashed(w)] += index(s[j])
                    met[hashed(w)] += 1
    full = lambda v: v / np.linalg.norm(v)
    want = {h: full(own[h] + 2 * around[h] / max(met[h], 1)) for h in words}
    vectors = q.word_vectors(df.select("text"), got)
    assert np.allclose(vectors[0][:-1], np.stack([want[h] for h in words]), atol=1e-5) and not vectors[0][-1].any()
    assert vectors[1].shape == (q.SHAPES, q.DIM)
    for x in q.pooled(df, got, vectors).collect():
        s = seqs[x.doc_id]
        mean = sum((want.get(hashed(w), index(w) / 2) for w in s), np.zeros(q.DIM)) / max(len(s), 1)
        assert np.allclose(x.vec[: q.DIM], mean, atol=1e-4), x.doc_id


def test_held_out_accuracy_on_the_tables(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        return
    labels = {x.doc_id: x.quality for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [x for x in q.op8_random_indexing(spark, "/root/testdata/sf0.01").collect() if x.held_out and x.doc_id in labels]
    right = sum(x.predicted == labels[x.doc_id] for x in got) / len(got)
    print("held-out accuracy", right, "share of ones", sum(labels[x.doc_id] for x in got) / len(got))
    assert right > 0.9
