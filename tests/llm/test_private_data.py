import hashlib
import random
import re
import time
from collections import Counter, defaultdict

from pagewright.llm import private_data as p

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    t, digits = text or "", lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(CARD, t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def plain(docs, support=3, least=500, sure=700, rounds=8):
    """The found spans of each text by the definitions of the module, without Spark."""
    letters = f"[{p.LETTER}]"
    mentions, totals = [], Counter()
    for row, text in enumerate(docs):
        t = text or ""
        words = re.findall(letters + "+", t.lower())
        totals.update((w,) for w in words)
        totals.update(zip(words, words[1:]))
        spans, all_ = base(t), list(re.finditer(p.SLOT, t))
        for k, m in enumerate(all_):
            if not (re.search(p.AT, m[0]) or len(re.findall("[0-9]", m[0])) >= p.DIGITS):
                continue
            before = (" " + t[all_[k - 1].end() if k else 0 : m.start()])[-p.REACH :].lower()
            after = (t[m.end() : all_[k + 1].start() if k + 1 < len(all_) else len(t)] + " ")[: p.REACH].lower()
            a, b = re.search(p.BEFORE.replace(r"\z", r"\Z"), before), re.match(p.AFTER, after)
            grams = []
            if a:
                grams += [(0, (a[2],))] + ([(0, (a[1], a[2]))] if a[1] else [])
            if b:
                grams += [(1, (b[1],))] + ([(1, (b[1], b[2]))] if b[2] else [])
            seed = any(x < m.end() and m.start() < y for x, _, y in spans)
            mentions.append((row, m.start(), m.end(), re.sub(r"[ ()-]", "", m[0]).lower(), grams, seed))
    score = {v: 1000 for _, _, _, v, _, seed in mentions if seed}
    seeds, edges = set(score), defaultdict(Counter)
    for *_, v, grams, _ in mentions:
        for g in grams:
            edges[g][v] += 1
    for _ in range(rounds):
        conf = {}
        for g, vs in edges.items():
            c = sum(n * score.get(v, 0) for v, n in vs.items()) // (totals[g[1]] + 2)
            if c >= least and sum(score.get(v, 0) >= sure for v in vs) >= support:
                conf[g] = c
        new = {}
        for g, c in conf.items():
            for v in edges[g]:
                new.setdefault(v, [0, 0])[g[0]] = max(new.get(v, [0, 0])[g[0]], c)
        score = {v: 1000 - (1000 - a) * (1000 - b) // 1000 for v, (a, b) in new.items()} | {v: 1000 for v in seeds}
    return [[(s, 4, e) for r, s, e, v, _, seed in mentions if r == row and not seed and score.get(v, 0) >= sure] for row in range(len(docs))]


def corpus(seed=11):
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    kinds = [
        lambda: f"{name()}@{name()}.example.com", lambda: ".".join(str(r.randint(0, 300)) for _ in range(4)), lambda: f"+{digits(2)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: " ".join(digits(4) for _ in range(4)), lambda: digits(r.randint(3, 12)), lambda: f"{name()}[at]{name()}.org", lambda: f"X{digits(7)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
    ]
    cues = ["reach me at {}", "phone: {}", "write to {} now", "Kontakt über {} bitte", "in {} they", "the {}", "{}", "passport no. {} issued", "é {}, ñ", "call\n{}", "id={};"]
    texts = []
    for _ in range(120):
        parts = [r.choice([r.choice(cues).format(r.choice(kinds)()), "the plain words in a line", "reach me at noon", name(), "\n", "2024-01-02", "issued"]) for _ in range(r.randint(0, 12))]
        texts.append(r.choice([" ", "\n", ". "]).join(parts))
    return texts


EDGES = [
    None, "", "a@b.c%x@y.z", "a@b@c.d", "a@b..c", "a@b.c.", "@b.c a@", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1.1 0001.02.3.255", "01.2.3", "1" * 30, "4532 5073 7903 5540 12",
    "45325073-7903-5540", "4532  507379035540", "+1 2345678", "+12345678", "+1" + " " * 50 + "23456789", "+1234567890123456", "é😀 x@y.zé.w +49 (30) 1234-567.", "a.b.c@d-e.f-g.h", "1-1-1-1",
    "9" * 1000, "a@" + "b." * 1000 + "c", "call 4532507379035540 or x@y.de", "me [at] host [dot] org",
]


def spans_of(found):
    return [(s.start, p.KINDS.index(s.kind), s.end) for s in found]


def test_against_plain(spark):
    docs = corpus() + EDGES + [f"the secret line is ext {i}77{i}55" for i in range(3)]
    docs += [f"my mailbox {name}@mail.example.com or" for name in ("ann", "bo", "cy", "di", "ed", "flo")] + ["my mailbox 555-777-1234 or"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    df = df.selectExpr("*", *[f"concat('v', doc_id) as `{n}`" for n in ("__t", "__base", "__slots", "__row", "value", "in0", "private_spans")])
    want = plain(docs)
    for most in (500_000, 0):  # patterns sent to the tasks, or joined
        got = {x.doc_id: x for x in p.extract(df, most_listed=most).collect()}
        assert len(got) == len(docs) and set(got[3].asDict()) == set(df.columns) and got[3]["__row"] == "v3"
        bad = {i: (t, spans_of(got[i].private_spans), base(t) + want[i]) for i, t in enumerate(docs) if spans_of(got[i].private_spans) != sorted(base(t) + want[i])}
        assert bad == {}, most
    assert (11, 4, 23) in want[-1] and sum(map(len, want)) > 5


def test_second_round(spark):
    """What a pattern of seeds finds makes patterns in turn; a common word before numbers finds nothing."""
    ids = [f"{i}44{i}55{i}6" for i in range(10)]
    docs = ["member card 9988776 expires", "the 1234567"] + [f"mail to person{i}@x.example.com" for i in range(60)]
    docs += [f"mail to {v}" for v in ids] + [f"member card {v} expires" for v in ids] + ["the man"] * 3
    docs += [f"the {i}@y.example.com" for i in range(3)] + ["the way"] * 9
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {x.doc_id: [s for s in spans_of(x.private_spans) if s[1] == 4] for x in p.extract(df).collect()}
    want = plain(docs)
    assert found == dict(enumerate(want))
    assert found[0] == [(12, 4, 19)] and found[1] == [] and found[62] == [(8, 4, 16)]


def test_query_rows(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(corpus(5) + EDGES)] + [(3, "x@y.zz"), (3, "x@y.zz"), (None, "phone +49 1234567890"), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = p.op11_private_data(spark, str(tmp_path)).collect()
    found = plain([t for _, t in docs])
    want = []
    for (i, t), more in zip(docs, found):
        text = lambda spans: ",".join(f"{p.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        b = base(t)
        want.append((i, *[sum(k == n for _, k, _ in sorted(b + more)) for n in range(5)], hashlib.sha256(text(b).encode()).hexdigest(), text(sorted(b + more))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_work_grows_as_the_text(spark):
    took = {}
    for n in (1000, 20_000, 20_000):
        text = " ".join(f"mail a{i}@b.example.com or 555-{i:07d} x" for i in range(n)) + " " + "1 " * n + "a-" * n + "(" * n + "9" * n + "+1" + " " * n
        began = time.time()
        (out,) = p.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        took[n] = time.time() - began
        assert len([s for s in out.private_spans if s.kind == "email"]) == n
    assert took[20_000] < 40, took


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert p.extract(df).collect() == [] and p.extract(df).columns == ["doc_id", "text", "private_spans"]
