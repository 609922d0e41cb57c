import math
import os
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import suffix_tree as s


def words(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


def corpus(n=500, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        out = []
        while len(out) < 60:
            out += r.choice([["the", "old", "house"], ["the", "new"], ["A", "cat", "sat"], ["a", "dog", "ran", "far"], [f"w{r.randint(0, 400)}"], ["É" + str(r.randint(0, 9))]])
        rows.append((i, " ".join(out) + r.choice(["", "\n", " \t "])))
    return rows + [(None, "the old house"), (7, None), (8, ""), (9, "the " * 20000), (3, rows[3][1]), (3, rows[3][1])]


def test_query_against_plain_counts(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = s.op6_suffix_tree(spark, str(tmp_path)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words(t), None])
    total, kinds = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        tokens = [*words(t), None]
        want.append((i, held(i), len(tokens), sum(c[w] > 0 for w in tokens), total, round(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in tokens), 5)))
    have = [(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 5)) for x in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    out = [x for x in got if x.held_out]
    assert sum(x.score for x in out) > 0.9 * sum(x.base_score for x in out) and all(x.score < 0 for x in got)


def test_states_sum_to_one_and_scores_match_a_plain_walk(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, False, t) for i, t in rows], "doc_id long, held_out boolean, text string")
    tree, counts, coded = s.fit(docs, context_share=1e-3, next_share=1e-4, common_share=1e-4)
    assert tree.depth >= 2 and len(tree.parent) > 10 and max(np.bincount(tree.parent)) > 1
    n_all = counts.count()
    known = np.arange(len(tree.words))
    rare = sum(math.log10(1) * 0 + 10 ** (math.log10(r.n + 1) + tree.unknown) for r in counts.collect() if r.word not in set(tree.words.tolist())) + 10**tree.unknown
    for state in range(len(tree.parent)):
        mass = (10 ** tree.log_chances(np.full(len(known), state), known)).sum()
        mass += rare * 10 ** tree.log_chances(np.array([state]), np.array([tree.width - 1]))[0]
        assert abs(mass - 1) < 1e-6, (state, mass, n_all)
    h = {int(x): k for k, x in enumerate(tree.words)}
    child = dict(zip(tree.children[0].tolist(), tree.children[1].tolist()))
    entry = dict(zip(tree.entries[0].tolist(), tree.entries[1].tolist()))
    count = {r.word: r.n for r in counts.collect()}

    def plain(t):
        hs = [*[int(x) for x in s.hashes(words(t))], 0]
        ids = [h.get(x, tree.width - 1) for x in hs]
        sum_ = 0.0
        for i, w in enumerate(ids):
            state, d = 0, 1
            while d <= tree.depth and i - d >= 0 and state * tree.width + ids[i - d] in child:
                state, d = child[state * tree.width + ids[i - d]], d + 1
            while state and state * tree.width + w not in entry:
                sum_ += tree.rest[state]
                state = int(tree.parent[state])
            sum_ += entry[state * tree.width + w] if state else math.log10(count.get(hs[i], 0) + 1) + tree.unknown
        return sum_

    got = sorted((x.doc_id is not None, x.doc_id or 0, round(x.score, 6)) for x in s.score(coded, tree, counts).collect())
    assert got == sorted((i is not None, i or 0, round(plain(t), 6)) for i, t in rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, held_out boolean, text string")
    tree, counts, coded = s.fit(docs)
    assert s.score(coded, tree, counts).count() == 0


def test_mixed_is_sparks_hash(spark):
    a, b = np.array([1, -5, 0, 1 << 62]), np.array([7, 0, -(1 << 63), 3])
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    assert [x[0] for x in df.selectExpr("xxhash64(a, b)").collect()] == s.mixed(a, b).tolist()


def test_tables_give_the_scores_of_the_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, i is not None and i % 5 == 0, t) for i, t in corpus()], "doc_id long, held_out boolean, text string").repartition(3)
    tree, counts, coded = s.fit(docs, context_share=0, next_share=0, common_share=0)
    assert tree.depth == 3 and len(tree.parent) > 10
    key = lambda x: (x.doc_id is not None, x.doc_id or 0, x.n_tokens, x.n_known, round(x.base_score, 5), round(x.score, 5))
    want = sorted(map(key, s.score(coded, tree, counts).collect()))
    table, coded, tokens, kinds = s.fit_tables(docs)
    for share in (0, 1e-3, 1):
        assert sorted(map(key, s.score_tables(coded, table, tokens, kinds, common_share=share).collect())) == want
    monkeypatch.setattr(s, "BUCKET_TOKENS", 1000)
    monkeypatch.setattr(s, "LOOKED_UP_TOKENS", 700)
    monkeypatch.setattr(s, "CHUNK", 7)
    table, coded, tokens, kinds = s.fit_tables(docs)
    assert s.bucket_count(tokens) > 20 and sorted(map(key, s.score_tables(coded, table, tokens, kinds, common_share=1e-3).collect())) == want
    table, coded, tokens, kinds = s.fit_tables(docs.limit(0))
    assert s.score_tables(coded, table, tokens, kinds).count() == 0


def test_states_grow_with_the_corpus(spark, tmp_path):
    # 1.2 million tokens in which 24 pairs of words come 30 times each: well below the 1/20,000 that a context once had to be.
    rows = [(i, "filler " * 10_000) for i in range(120)]
    rows += [(1000 + i, " ".join(f"left{k} right{k} x{i}k{k}" for k in range(24))) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [x for x in s.op6_suffix_tree(spark, str(tmp_path)).collect() if x.doc_id >= 1000 and x.held_out]
    assert got and all(x.score > x.base_score + 40 for x in got)


def test_buckets_of_arrays_and_columns(spark):
    keys = [5, -5, 1 << 62, -(1 << 62), (1 << 20) - 1, -1, 0]
    got = spark.createDataFrame([(k,) for k in keys], "key long").select(s.bucket_of(F.col("key"), 7)).collect()
    assert [x[0] for x in got] == s.bucket_of(np.array(keys), 7).tolist()


def test_states_against_plain_counts(spark):
    """Which contexts become states, and their entries, from counts and likelihood ratios in plain Python."""
    rows = corpus(200)
    docs = spark.createDataFrame([(i, False, t) for i, t in rows], "doc_id long, held_out boolean, text string").repartition(3)
    seqs = [[*words(t), None] for _, t in rows]
    c1 = Counter(w for q in seqs for w in q)
    total, kinds, mu = sum(c1.values()), len(c1), 5.0
    grams = {d: Counter(tuple(q[i : i + d + 1]) for q in seqs for i in range(len(q) - d)) for d in (1, 2, 3)}
    root = lambda w: (c1[w] + 1) / (total + kinds + 1)
    chance = {(w,): root(w) for w, n in c1.items() if n >= 3}
    states, held = {(): 1.0}, {}
    contexts = {(w,): n for w, n in c1.items() if n >= 20 and w is not None}
    for d in (1, 2, 3):
        new, kept = {}, {}
        nexts = {}
        for g, n in grams[d].items():
            if n >= 3 and g[:-1] in contexts and g[1:] in chance:
                nexts.setdefault(g[:-1], {})[g[-1]] = n
        for ctx, found in nexts.items():
            all_ = contexts[ctx]
            below = {w: chance[(*ctx[1:], w)] for w in found}
            g = sum(2 * n * math.log(n / (all_ * below[w])) for w, n in found.items())
            left, left_below = all_ - sum(found.values()), max(all_ * (1 - sum(below.values())), 1e-9)
            g += 2 * left * math.log(left / left_below) if left > 0 else 0.0
            if g > len(found) + 4 * math.sqrt(2 * len(found)):
                new[ctx] = (1 - sum(n / (all_ + mu) for n in found.values())) / max(1 - sum(below.values()), 1e-12)
                kept |= {(*ctx, w): n / (all_ + mu) for w, n in found.items()}
        states |= new
        held |= kept
        counted = {g: grams[d][g] for g in kept}
        contexts = {g: n for g, n in counted.items() if n >= 20 and g[-1] is not None and g[1:] in new}
        contexts = {g: n for g, n in contexts.items() if g[1:] in states}
        chance = kept
    def score(q):
        out = 0.0
        for i, w in enumerate(q):
            d = 0
            while d < 3 and i - d - 1 >= 0 and tuple(q[i - d - 1 : i]) in states:
                d += 1
            p = 1.0
            while d and (*q[i - d : i], w) not in held:
                p *= states[tuple(q[i - d : i])]
                d -= 1
            out += math.log10(p * (held[(*q[i - d : i], w)] if d else root(w)))
        return out

    assert sum(len(k) == 2 for k in states) > 3
    table, coded, tokens, n_kinds = s.fit_tables(docs)
    got = sorted((x.doc_id is not None, x.doc_id or 0, round(x.score, 6)) for x in s.score_tables(coded, table, tokens, n_kinds).collect())
    assert got == sorted((i is not None, i or 0, round(score(q), 6)) for (i, _), q in zip(rows, seqs))


def test_words_that_share_a_hash(spark, tmp_path, monkeypatch):
    # All have one xxHash64; two come in a row that is held out alone.
    alike = ["abcdefgh12345678", "ffpr0?4pdw9@h|au", "2huq_l(t/1!5`7^h"]
    assert len(set(s.hashes(alike).tolist())) == 1
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(1000 + i, alike[0] + " a") for i in range(20) if zlib.crc32(str(1000 + i).encode()) % 7 != 2] + [(held, f"{alike[1]} {alike[2]} a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def check():
        n = len(rows) - 1
        got = {x.doc_id: x for x in s.op6_suffix_tree(spark, str(tmp_path)).collect()}
        assert (got[held].n_tokens, got[held].n_known, got[held].train_tokens) == (4, 2, 3 * n)
        assert abs(got[held].base_score - (2 * math.log10(n + 1) - 4 * math.log10(3 * n + 4))) < 1e-9

    check()
    plain = s.digests
    salts = []

    def same(words, salt):
        key, check = plain(words, salt)
        return (key & 1 | 2, check) if salt == 0 else (key, check)

    # Where words share a key, another salt is taken.
    once = s._to_words
    monkeypatch.setattr(s, "_to_words", lambda salt: salts.append(salt) or once(salt, digest=same))
    check()
    assert salts == [0, 1]


def test_rounds_hold_a_part_of_the_shuffles(spark, monkeypatch):
    # What is shuffled at once is a round of the contexts, or of the rows, and what only the counts need is deleted.
    docs = spark.createDataFrame([(i, i is not None and i % 5 == 0, t) for i, t in corpus()], "doc_id long, held_out boolean, text string").repartition(3)
    key = lambda x: (x.doc_id is not None, x.doc_id or 0, x.n_tokens, x.n_known, round(x.base_score, 5), round(x.score, 5))
    table, coded, tokens, kinds = s.fit_tables(docs)
    want = sorted(map(key, s.score_tables(coded, table, tokens, kinds, common_share=1e-3).collect()))
    names, plain = [], s.materialise
    monkeypatch.setattr(s, "materialise", lambda df, name, *a, **k: names.append(name) or plain(df, name, *a, **k))
    monkeypatch.setattr(s, "BUCKET_TOKENS", 1000)
    monkeypatch.setattr(s, "LOOKED_UP_TOKENS", 700)
    monkeypatch.setattr(s, "ROUNDS", 3)
    monkeypatch.setattr(s, "SLOT_BITS", 3)
    table, coded, tokens, kinds = s.fit_tables(docs)
    assert names.count("found") > 3 and not os.path.exists(coded._work_path.removeprefix("file:") + "/met=true")
    assert sorted(map(key, s.score_tables(coded, table, tokens, kinds, common_share=1e-3).collect())) == want
    assert names.count("scored") == 3 and "placed" not in names
    turns = s.turn_of(np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 30_000), 3)
    assert (abs(np.bincount(turns, minlength=3) - 10_000) < 500).all() and len(np.bincount(turns)) == 3


def test_a_round_of_scoring_shuffles_a_quarter_of_the_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, i is not None and i % 5 == 0, t) for i, t in corpus()], "doc_id long, held_out boolean, text string").repartition(3)
    key = lambda x: (x.doc_id is not None, x.doc_id or 0, x.n_tokens, x.n_known, round(x.base_score, 5), round(x.score, 5))
    table, coded, tokens, kinds = s.fit_tables(docs)
    want = sorted(map(key, s.score_tables(coded, table, tokens, kinds, common_share=1e-3).collect()))
    rows, plain = {}, s.materialise

    def noted(df, name, *a, **k):
        out = plain(df, name, *a, **k)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(s, "materialise", noted)
    monkeypatch.setattr(s, "BUCKET_TOKENS", 1000)
    monkeypatch.setattr(s, "LOOKED_UP_TOKENS", 700)
    table, coded, tokens, kinds = s.fit_tables(docs)
    assert sorted(map(key, s.score_tables(coded, table, tokens, kinds, common_share=1e-3).collect())) == want
    # Each round holds its part of all rows on disk; counting, which takes all words in every round, has no more rounds for it.
    assert sum(rows["scored"]) == len(want) and max(rows["scored"]) < 0.27 * len(want) and len(rows["found"]) <= 6


def test_texts_come_in_batches_of_a_few_megabytes(spark, monkeypatch):
    # 5,000 rows in one task: a batch of all of them would be held beside what is made of it.
    docs = spark.range(5000).selectExpr("id as doc_id", "false as held_out", "concat('the house ', id) as text").coalesce(1)
    plain = s._to_words

    def guarded(salt):
        to_words = plain(salt)

        def watch(batches):
            for batch in batches:
                assert batch.num_rows <= 2000, batch.num_rows
                yield batch

        return lambda batches: to_words(watch(batches))

    monkeypatch.setattr(s, "_to_words", guarded)
    coded, counts, tokens, kinds = s._coded(docs)
    assert (coded.count(), tokens, kinds) == (5000, 20_000, 5003)
    assert coded.select("row").distinct().count() == 5000
