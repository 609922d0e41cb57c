"""Numbers within groups, waves, samples and rates: against plain Python, with a group of nearly all rows."""

import random

from pyspark.sql import functions as F

from pagewright.operators import pages, scans
from pagewright.streaming import progress


def test_numbers_in_a_hot_group(spark):
    r = random.Random(8)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", "b", None]), r.choice([None, *range(50)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, id long").repartition(5)
    got = {x.id: x.n for x in pages.with_group_number(df, "g", ["k", "id"], "n", parts=40, sampled=500, rows=50).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        some = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want |= {x[2]: n for n, x in enumerate(some, 1)}
    assert got == want and pages.with_group_number(df.limit(0), "g", ["k"], "n").count() == 0
    plan = pages.with_group_number(df, "g", ["k", "id"], "n", rows=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(g" in plan and "range" in plan


def test_even_samples(spark):
    for n in (1, 2, 3, 5, 7, 10):
        rows = [(str(m), i) for m in range(1, 40) for i in range(m)]
        got = sorted(map(tuple, pages.even_sample(spark.createDataFrame(rows, "g string, i int"), "g", "i", n).collect()))
        want = sorted((str(m), i) for m in range(1, 40) for i in (range(m) if n >= m else {int(k * (m / n)) for k in range(n)}))
        assert got == want, n


def test_waves(spark):
    rows = [(0, 20, 40), (1, 10, 500), (2, None, 1), (3, 10, 2), (4, 1, None), (5, 20, 40)]
    df = spark.createDataFrame([("b", *x) for x in rows], "g string, i int, w int, h int")
    by = {x.i: x.wave for x in pages.waves(df, "g", "w", "h", "i", 1).collect()}
    assert sorted(by, key=by.get) == [3, 1, 0, 5, 2, 4]
    assert {x.i: x.wave for x in pages.waves(df, "g", "w", "h", "i", 4).collect()} == {3: 0, 1: 0, 0: 0, 5: 0, 2: 1, 4: 1}


def folded(events):
    """Rates and beginnings of stages one event after another."""
    stage, done, now, rate, begun, out = None, 0, 0.0, 0.0, None, []
    for k, (s, d, t) in enumerate(events):
        if k == 0 or s != stage:
            rate, begun = 0.0, t
        elif t > now and d > done:
            inst = (d - done) / (t - now)
            rate = inst if rate <= 0 else 0.3 * inst + 0.7 * rate
        stage, done, now = s, d, t
        out.append((rate, begun))
    return out


def test_rates_in_blocks(spark):
    r = random.Random(9)
    jobs = {}
    for j, n in (("hot", 2000), ("a", 1), ("b", 17), (None, 40)):
        t, d, jobs[j] = 0.0, 0, []
        for _ in range(n):
            t += r.choice([0.0, 0.5, 3.0])
            d = max(0, d + r.choice([-3, 0, 1, 5]))
            jobs[j].append((r.choice(["ocr", None]) if r.random() < 0.02 else (jobs[j][-1][0] if jobs[j] else "split"), d, t))
    rows = [(j, i, *e) for j, events in jobs.items() for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "job string, seq long, stage string, done long, now double").repartition(4)
    want = {(j, i): x for j, events in jobs.items() for i, x in enumerate(folded(events))}
    for block in (1, 7, 64, 4096):
        got = {(x.job, x.seq): (x.rate, x.begun) for x in scans.rates(df, "job", "stage", "done", "now", ["seq"], block).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want), block
    assert scans.rates(df.limit(0), "job", "stage", "done", "now", ["seq"]).count() == 0


def test_estimates_of_a_long_job(spark):
    df = spark.range(200_000).selectExpr("'j' as job", "id as seq", "if(id < 150000, 'split', 'ocr') as stage", "id % 150000 as done", "150000L as total", "id * 2.0D as now")
    last = progress.estimates(df).where("seq in (1, 149999, 150000, 199999)").orderBy("seq").collect()
    assert [round(x.rate, 9) for x in last] == [0.5, 0.5, 0.0, 0.5] and last[2].eta_sec is None and abs(last[3].eta_sec - 200_002.0) < 1e-3
