import random
from collections import Counter

from pagewright.llm import ngram_join as j
from pagewright.llm.components import connected_components


def shingles(t):
    w = (t or "").split(" ") if t else []
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, least=0.8):
    texts = {}
    for i, t in rows:
        texts.setdefault(" ".join((t or "").split()), []).append(i)
    keys = list(texts)
    sets = [shingles(k) for k in keys]
    top = list(range(len(keys)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links, weight = Counter(), Counter()
    for a in range(len(keys)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                for x, y in ((a, b), (b, a)):
                    links[x] += 1
                    weight[x] += len(texts[keys[y]])
                top[find(a)] = find(b)
    low = {}
    for k in range(len(keys)):
        r = find(k)
        low[r] = min(low.get(r, 10**9), min(texts[keys[k]]))
    return sorted((i, low[find(k)], min(texts[key]), len(texts[key]), weight[k] + len(texts[key]) - 1, links[k]) for k, key in enumerate(keys) for i in texts[key])


def fixture():
    r = random.Random(9)
    word = lambda: f"w{r.randint(0, 5000)}"
    rows = []
    for g in range(25):
        base = [word() for _ in range(r.choice([3, 5, 6, 30, 100, 400]))]
        for _ in range(r.choice([1, 2, 12])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t))
    rows += [rows[0]] * 3 + ["", None, "  \n", "a", "a", "a  b", "a b"]
    hot = [word() for _ in range(120)]
    for _ in range(60):
        t = list(hot)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(120)] = word()
        rows.append(" ".join(t))
    rows.append(" ".join(f"u{i}" for i in range(30000)))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_bands():
    b, rows = j.bands_for(0.8, 0.9998)
    assert 1 - (1 - 0.8**rows) ** b >= 0.9998 and b * rows <= 192


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + r.randint(0, 80), 1000 + r.randint(0, 80)) for _ in range(60)] + [(5000, 5000), (7, 3), (300, 299)]
    want = {}
    for a, b in edges:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    want = brute(rows)
    assert sum(x[5] > 0 for x in want) > 50
    for block in (768, 20, 7):
        got = sorted(tuple(x) for x in j.ngram_jaccard_join(df, block=block).collect())
        assert [x for x in zip(got, want) if x[0] != x[1]][:3] == [] and len(got) == len(want)


def test_nulls_and_stage(spark):
    long = " ".join(f"x{i}" for i in range(50))
    rows = [(None, "p q r s t u"), (None, "p q r s t u"), (None, "other words here"), (4, long), (4, long), (9, long + " y"), (4, "quite another"), (-3, "p q r s t u v")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = j.ngram_jaccard_join(df).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    kept = j.near_duplicates_stage(spark, df, "").collect()
    assert sorted(x.text for x in kept) == sorted(["p q r s t u", "other words here", long, "quite another", "p q r s t u v"])
    assert j.ngram_jaccard_join(df.limit(0)).count() == 0


def test_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " tail"), (9, b + " tail"), (9, b + " other"), (5, a), (2, "alone"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for parts in (1, 3, 5):
        got = sorted(tuple(x) for x in j.ngram_jaccard_join(df.repartition(parts)).collect())
        assert got == want, parts
    kept = j.near_duplicates_stage(spark, df.withColumns({c: df.doc_id for c in ("c1", "k1", "t", "rep", "__1", "in0")}), "").collect()
    assert sorted((x.doc_id, x.rep, x.k1, (x.text or "")[:2]) for x in kept) == [(2, 2, 2, ""), (2, 2, 2, "al"), (5, 5, 5, "a0"), (5, 5, 5, "b0")]
