import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pagewright.llm import packing as p
from pagewright.llm.encoding import Encoder

P = pytest.importorskip("public_tokenizers")


def check(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity
    return len(at)


def test_best_fit_against_plain():
    r = random.Random(1)
    for _ in range(50):
        xs = sorted((r.randint(1, 30) for _ in range(60)), reverse=True)
        bins, offsets, fill = p.best_fit(xs, 30)
        plain: list[int] = []
        for x in xs:
            fits = [i for i, f in enumerate(plain) if f + x <= 30]
            if fits:
                plain[max(fits, key=lambda i: plain[i])] += x
            else:
                plain.append(x)
        assert sorted(plain) == sorted(fill) and max(fill) <= 30 and sum(fill) == sum(xs)


def test_documents(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["word"] * r.choice([0, 1, 5, 40, 63, 64, 65, 200]))) for i in range(900)]
    rows += [(5, None), (None, "a"), (None, ""), (7, "x y"), (7, "x y"), (8000, "é " * 3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(20)
    path = P.path("byte_bpe_50k.json")
    got = p.pack_documents(df, path, capacity=64, fan_in=3).collect()
    n = check(got, 64)
    t = Encoder(path)._tokenizer
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        for k, a in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[a : first if k == 0 else a + 64]
            want.append((i, k, a, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((x.doc_id, x.piece, x.start, x.length, x.ids_crc32)) for x in got)
    total = sum(x.length for x in got)
    _, _, fill = p.best_fit(sorted((x.length for x in got), reverse=True), 64)
    assert -(-total // 64) <= n <= 1.02 * len(fill) + 1
    few = p.pack_documents(df, path, capacity=64, fan_in=3, carry=2).collect()
    check(few, 64)
    assert len(few) == len(got)
    assert p.pack_documents(df.limit(0), path).count() == 0


def test_lengths_clustered_by_task(spark):
    # Two tasks, each of lengths that do not fit together but fit the other's; far more pieces than carry.
    r = random.Random(5)
    texts = lambda a, b: [" ".join(["word"] * r.randint(a, b)) for _ in range(1500)]
    rows = list(enumerate(texts(34, 38) + texts(22, 23)))
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    # Parts of 300 items differ by chance in how many they have of each kind, larger ones hardly.
    for carry, most in ((100, 1.12), (8192, 1.01)):
        got = p.pack_documents(df, P.path("byte_bpe_50k.json"), capacity=64, fan_in=3, carry=carry).collect()
        assert len(got) == 3000
        _, _, fill = p.best_fit(sorted((x.length for x in got), reverse=True), 64)
        assert check(got, 64) <= most * len(fill), (carry, len(fill))


def test_tasks_take_few_texts_at_a_time(spark, monkeypatch):
    seen, plain = {}, p.materialise

    def kept(df, name, *more):
        seen[name] = more
        return plain(df, name, *more)

    monkeypatch.setattr(p, "materialise", kept)
    df = spark.createDataFrame([(i, "a text " * 9) for i in range(30)], "doc_id long, text string")
    assert p.pack_documents(df, P.path("byte_bpe_50k.json")).count() == 30
    assert seen["pieces"] and seen["pieces"][0] <= 1000 and p.SLICE <= 2 << 20
