import os
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as c
from pagewright.llm import mixing as m
from tests.llm.test_ngram_join import brute as classed
from tests.llm.test_quality_rules import brute as quality
from tests.llm.test_secret_scan import base, plain_random

SF = "/root/testdata/sf0.001"


def docs(spark):
    r = random.Random(21)
    rows = []
    for i in range(240):
        text = " ".join(f"w{r.randint(0, 3000)}" for _ in range(r.randint(21, 120)))
        rows.append((i, text, "en", r.choice(["a", "a", "b", None]), len(text)))
    rows += [(500, rows[0][1], "en", "a", 1), (501, rows[1][1] + " tail", "en", "b", 1), (502, "short", "en", "a", 5), (503, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_stages_keep_columns_and_take_effect(spark):
    now = docs(spark)
    names = now.columns
    counts = [now.count()]
    for name, stage in c.STAGES[:-1]:
        now = c.materialise(stage(spark, now, ""), name)
        assert now.columns == names and [f.dataType for f in now.schema] == [f.dataType for f in docs(spark).schema]
        counts.append(now.count())
    assert counts[1] == 242 and counts[2] == 240 and counts[3] == 240
    last = c.STAGES[-1][1](spark, now, "")
    assert set(last.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert Counter(x.doc_id for x in last.where("piece = 0").collect()) == Counter(x.doc_id for x in now.collect())


def test_mixing_repeats_rows(spark):
    df = docs(spark)
    twice = df.union(df.where("doc_id < 5"))
    got = Counter(x.doc_id for x in m.mixing_stage(spark, twice, "").collect())
    items = twice.selectExpr("doc_id", "source", "size(split(coalesce(text,''),' ')) as size", "1L as n")
    assert max(v for k, v in got.items() if k >= 5) <= 3 and max(got.values()) <= 6
    for source, size, goal, _ in m.source_targets(items).collect():
        taken = sum(n * len((x.text or "").split()) for x in df.where(f"source <=> {'null' if source is None else repr(source)}").collect() for n in [got[x.doc_id]])
        assert abs(taken - goal) < 0.03 * goal + 20, (source, size, goal, taken)


def test_against_plain_stages(spark):
    """The rows after each stage, worked out without Spark but for the hashes of rows."""
    r = random.Random(22)
    common = "This line stands in many documents of the host"
    rows = []
    for i in range(150):
        lines = [" ".join(f"w{r.randint(0, 4000)}" for _ in range(r.randint(6, 25))) for _ in range(r.randint(1, 5))]
        if i % 5 == 0:
            lines.insert(r.randint(0, len(lines)), common)
        if i % 17 == 0:
            lines.append("password = hunter" + str(i) + " AKIA" + "Q7Z4" * 4 + " " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(64)))
        rows.append((i, "\n".join(lines), r.choice(["a", "a", "b", None])))
    rows += [(200 + k, t + (" one more" if k % 2 else ""), s) for k, (_, t, s) in enumerate(rows[:40])] + [(301, "too short", "a"), (302, None, "b"), (303, "x y z " * 40, "a")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    now = df
    got = []
    for name, stage in c.STAGES[:-1]:
        now = c.materialise(stage(spark, now, ""), name)
        got.append(now)
    kept = [(x[0], x[-1], s) for x, (_, _, s) in zip(quality(rows, 100, 0.01, 5), rows) if x[7]]
    plain = lambda df: Counter((x.doc_id, x.text, x.source) for x in df.collect())
    assert plain(got[0]) == Counter(kept) and any(common not in t and common in (dict((i, u) for i, u, _ in rows)[i] or "") for i, t, _ in kept)
    ids = {x[0]: x[1] for x in classed([(i, t) for i, t, _ in kept])}
    one = [(i, t, s) for i, t, s in kept if ids[i] == i]
    assert plain(got[1]) == Counter(one) and len(one) < len(kept) - 10
    masked = []
    for i, t, s in one:
        spans = sorted([(a, b) for a, _, b in base(t)] + plain_random(t))
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        masked.append((i, out + t[at:], s))
    assert plain(got[2]) == Counter(masked) and sum("[SECRET]" in t for _, t, _ in masked) > 3
    hashed = got[2].toDF(*[f"in{k}" for k in range(5)]).select("in0", *m._keys([F.col(f"in{k}") for k in range(5)])).collect()
    keys = {x.in0: (x.key, x.key2) for x in hashed}
    want = Counter()
    sources = sorted({s for _, _, s in masked}, key=lambda s: (s is None, s or ""))
    size = lambda t: len(t.split())
    sums = [sum(size(t) for _, t, s in masked if s == x) for x in sources]
    for goal, total, x in zip(m.targets(sums, [5.0, 2.0, 1.0][: len(sources)]), sums, sources):
        items = sorted(((-size(t), *keys[i], i, t) for i, t, s in masked if s == x))
        sizes, part = [-z[0] for z in items], goal / total
        whole = int(part + m.WHOLE)
        given = [max(0.0, part - whole)] * len(items)
        up, parts, left = m.pivotal(sizes, given, [z[1] for z in items], 20)
        own = 0.0
        if left >= 0:
            own = parts[left]
            if sizes[left] * min(own, 1 - own) > m.NEAR * sum(a * b for a, b in zip(given, sizes)):
                up, own, left = m.exchanged(sizes, given, up, own, left, [z[1] for z in items], 20)
        if left >= 0:
            up[left] = int(own >= 0.5)
        for z, u in zip(items, up):
            if whole + u:
                want[z[3], z[4], x] += whole + u
    assert plain(got[3]) == want and max(want.values()) > 1
    last = c.STAGES[-1][1](spark, now, "").collect()
    assert Counter(x.doc_id for x in last if x.piece == 0) == Counter({i: n for (i, _, _), n in want.items()})
    held = Counter()
    for x in last:
        held[x.sequence_id] += x.length
    total = sum(held.values())
    assert max(held.values()) <= 1024 and len(held) <= total // 1024 + 2


def test_run(spark):
    if os.path.isdir(SF):
        assert c.run(spark, SF).count() > 0
