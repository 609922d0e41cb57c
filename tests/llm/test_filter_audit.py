import itertools
import random
import re

from pagewright.llm.filter_audit import op12_filter_audit


def plain(docs, labels):
    """The report by applying the filters in each order to each document."""
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    rows = []
    for i, text, source, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs) else set()
        rows.append((source or "", fails, i in good, i in toxic))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = [r for r in rows if r[0] == part and f in r[1]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def run(spark, path, docs, labels):
    names = ["n", "good", "toxic", "mask", "k1", "part", "first", "__w"]  # columns that clash with the operator's own
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    df.selectExpr("*", *[f"'{x}' as `{x}`" for x in names]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as id", "2 as mask").write.parquet(f"{path}/labels.parquet")
    found = op12_filter_audit(spark, str(path)).collect()
    assert len({(x.part, x.filter_order, x.step) for x in found}) == len(found)
    return {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in found}


def test_against_every_order(spark, tmp_path):
    r = random.Random(12)
    word = lambda: r.choice(["alpha", "Beta", "x", "é漢", " y", "GAMMA", "#", "z%"] if r.random() < 0.3 else [f"w{r.randint(0, 500)}"])
    texts = [" ".join(word() for _ in range(r.choice([0, 3, 150, 199, 200, 201, 260]))) for _ in range(12)]
    texts += [None, "", " \n\t\x0b", "a b " * 150, "word " * 210_000, "w\u0085v " * 199 + " ", "é" * 97 + "AB", "é" * 98 + "AB", "AB"]
    docs = [(i, t, r.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    docs += [(r.randint(0, 40), r.choice(texts), r.choice(["a", "b", "hot"])) for _ in range(40)]
    docs += [(None, texts[0], "a"), (None, None, None), (3, texts[3], docs[3][2]), (3, texts[3], docs[3][2]), (-5, texts[15], "b")]
    labels = [(r.choice([None, *range(45)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)]
    assert run(spark, tmp_path, docs, labels) == plain(docs, labels)


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path / "a", [], []) == {}
    docs = [(1, None, None), (2, "", None)]
    assert run(spark, tmp_path / "b", docs, []) == plain(docs, [])
