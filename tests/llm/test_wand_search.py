import math
import random
import re
from collections import Counter

import numpy as np

from pagewright.llm import wand_search as w


def terms(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain(docs, items, k=10):
    """Every document scored for every item."""
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, words = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for i, bag, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // words
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, r in Counter(terms(text)).items() if t in bag)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def case(seed=13):
    r = random.Random(seed)
    word = lambda: r.choice(["The", "of", "straße", "ÉA", "x9"]) if r.random() < 0.4 else f"w{int(r.paretovariate(0.6))}"
    text = lambda n: "".join(word() + r.choice([" ", ", ", "\n", "\x00", "_", "-"]) for _ in range(n))
    docs = [(i, text(r.choice([1, 5, 30, 200]))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(40)] + [(5, docs[5][1]), (5, "w1 other"), (None, docs[7][1]), (None, "the of"), (-3, docs[7][1])]
    docs += [(500, None), (501, ""), (502, " \x7f"), (503, "the w2 " * 170_000)]
    items = [(i, text(r.choice([1, 4, 30]))) for i in range(30)] + [(40, None), (41, ""), (42, "notthere"), (43, docs[7][1]), (44, "w1 w1 W1"), (44, "w1 w1 W1"), (44, "w2"), (None, "the")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", *[f"1 as {c}" for c in ("n", "terms", "tfs", "score", "rank", "item")])
    return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("'x' as doc_id", "*", "1 as item", "2 as score")


def test_against_all_scores(spark, monkeypatch):
    docs, items = case()
    want = plain(docs, items)
    for chars in (8 << 20, 500):  # one block of items and many
        got = w.search(*frames(spark, docs, items), block_chars=chars).collect()
        assert sorted(map(tuple, got), key=repr) == want, chars
    assert len(want) > 200


def test_stretches_and_skipping():
    """Heaps that go on over stretches of any length give the same; few documents are scored."""
    docs, items = case(14)
    docs = [x for x in docs if terms(x[1])]
    bags, places = [Counter(terms(t)) for _, t in docs], {}
    for _, t in items:
        for x in terms(t):
            places.setdefault(x, len(places))
    df = Counter(t for b in bags for t in b)
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) for t in places])
    words, want = sum(sum(b.values()) for b in bags), plain(docs, items)
    asked = sorted(set(items), key=repr)
    for step in (1, 7, len(docs)):
        heaps, scored, touched = [[] for _ in asked], 0, 0
        for a in range(0, len(docs), step):
            part = bags[a : a + step]
            rows = [(j, places[t], n) for j, b in enumerate(part) for t, n in b.items() if t in places]
            doc, term, tf = (np.array([x[c] for x in rows], np.int64) for c in range(3))
            lists = w.Lists([i for i, _ in docs[a : a + step]], np.array([sum(b.values()) for b in part]), doc, term, tf, weights, len(docs), words)
            for (_, text), heap in zip(asked, heaps):
                item = [(places[t], r) for t, r in Counter(terms(text)).items()]
                touched += len({j for t, _ in item if t in lists.of for j in lists.of[t][0]})
                scored += w.walk(lists, item, heap, 10)
        got = []
        for (item, _), heap in zip(asked, heaps):
            got += [(item, rank, None if none else i, s) for rank, (s, _, i, none) in enumerate(sorted(heap, reverse=True), 1)]
        assert sorted(got, key=repr) == want
        assert scored < 0.7 * touched, (scored, touched)


def test_empty_tables(spark):
    docs, items = case()
    d, i = frames(spark, docs, items)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.where("text is null"), i)):
        out = w.search(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
