import random
import re
from collections import Counter, defaultdict

from pagewright.llm import quality_rules as q

W = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = W.findall(text or "")
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(win)
    cov = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(8)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if W.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cov)


def norm(x):
    return re.sub("[1-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower())


def brute(rows, line_docs, share, floor, left_words=20, left_share=0.3):
    held, first, size = defaultdict(set), {}, Counter(s for s, _ in {(s, t or "") for _, t, s in rows})
    for i, t, s in rows:
        for x in {norm(x) for x in (t or "").split("\n") if W.search(x)}:
            held[s, x].add(t or "")
            if i is not None:
                first[s, x] = min(i, first.get((s, x), i))
    bad = {k for k, v in held.items() if len(v) > min(line_docs, max(floor, share * size[k[0]]))}
    out = []
    for i, t, s in rows:
        c = counts(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        keep = [x for x in (t or "").split("\n") if not (W.search(x) and (s, norm(x)) in bad and not (i == first.get((s, norm(x)))))]
        gone = len((t or "").split("\n")) - len(keep)
        left = len(W.findall("\n".join(keep)))
        depleted = gone > 0 and (left < left_words or left < c[0] * left_share)
        out.append((i, *c, failed, not failed and not depleted, gone, left, "\n".join(keep)))
    return out


def fixture():
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["é#", "|", "漢字", "a<b>"]
    common = ["Share  this 12 page now", " ".join(f"notice{i}" for i in range(30))]
    rows = []
    for i in range(300):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), common[0].replace("12", str(i)))
        if i % 4 == 0:
            lines.append(common[1])
        if i % 11 == 0:
            lines += lines[:2]
        if i % 13 == 0:
            lines = [f"tail {i} end", common[1]]
        if i % 17 == 0:
            lines = ["x y z " * 30]
        rows.append((i, "\n".join(lines), r.choice(["a", "a", "a", "b", None])))
    rows += [(1, None, "a"), (2, "", None), (None, common[1], "a"), (None, None, None), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (900, "one two " * 15000, "b"), (901, " \t\n\r\n\x0b", "b"), (902, "a b c " * 30, "b")]
    return rows


def test_against_brute_force_both_ways(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as line", "1 as host", "2L as n_chars").repartition(5)
    limits = {"line_docs": 30, "line_share": 0.1, "line_floor": 4}
    want = sorted(map(repr, brute(rows, 30, 0.1, 4)))
    assert sum(not x[7] and not x[6] for x in brute(rows, 30, 0.1, 4)) > 5
    for listed in (20_000, 0):
        got = q.judge(df, **limits, most_listed=listed).collect()
        have = [(x.doc_id, *(x[c] for c in q.COUNTS), x.base_failed, x.kept, x.n_removed_lines, x.left_words, x.clean_text) for x in got]
        wrong = [(a[:300], b[:300]) for a, b in zip(sorted(map(repr, have)), want) if a != b]
        assert not wrong[:3] and len(have) == len(want)
    assert q.judge(df.limit(0)).count() == 0


def test_query_and_stage(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "en", s, 5) for i, t, s in fixture()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = q.op3_line_frequency(spark, str(tmp_path))
    assert got.count() == df.count() and "Python" not in got._jdf.queryExecution().toString()
    out = q.quality_stage(spark, df, "")
    assert out.columns == df.columns and out.count() == got.where("kept").count() and out.where("n_chars <> length(text)").count() == 0


def test_pipeline_removes_planted_boilerplate(spark):
    import corpus_pipeline

    boiler = "Subscribe to our newsletter for more"
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are all alike in a line
    body = lambda k: " ".join(f"w{k}x{j}".translate(letters) for j in range(30))
    rows = [(i, boiler + "\n" + body(i), "small") for i in range(40)]
    rows += [(1000 + i, body(i) + ("\n" + boiler if i % 10 == 0 else ""), "middle") for i in range(500)]
    rows += [(10_000 + i, body(i) + ("\n" + boiler if i % 130 == 0 else ""), "large") for i in range(20_000)]
    rows += [(40_000 + i, body(7), "copies") for i in range(3000)] + [(50_000 + i, body(i) + "\n" + boiler, "copies") for i in range(30)]
    rows += [(60_000 + i, body(i) + ("\nSeen in three" if i < 3 else ""), "rare") for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.STAGES[0][1](spark, df, "").where("text like '%newsletter%' or text like '%three%'").groupBy("source").agg({"doc_id": "min", "*": "count"}).collect()
    assert {x["source"]: (x["min(doc_id)"], x["count(1)"]) for x in out} == {"small": (0, 1), "middle": (1000, 1), "large": (10_000, 1), "copies": (50_000, 1), "rare": (60_000, 3)}
