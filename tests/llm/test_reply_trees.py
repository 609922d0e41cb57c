import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import reply_trees as t

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_end|>", "<|im_start|>", "<|endoftext|>", "\\", "\n", "<", "|", ">", "a", "é漢😀", "im_end"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=5).map("".join), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=5))
def test_round_trip(turns):
    text, starts, ends = t.render(turns)
    assert t.parse(text) == turns
    for role, said in turns:
        assert not any(c in t.escape(said) for c in PIECES[:9])
    text, starts, ends = t.render([("assistant", s) for _, s in turns])
    assert [t.unescape(text[a:b]) for a, b in zip(starts, ends)] == [s for _, s in turns]


def test_trees(spark):
    r = random.Random(4)
    rows, parent = [], {}
    for tree in range(6):
        for n in range(1, 60 if tree else 300):
            p = r.randint(max(1, n - 3), n - 1) if n > 1 else None
            parent[tree, n] = p
            rows.append((tree, n, p, "user" if n % 2 else "assistant", f"m{tree}.{n}", float(r.randint(-3, 5))))
    rows += [(6, 1, 2, "user", "cycle", 1.0), (6, 2, 1, "user", "cycle", 1.0), (6, 3, 2, "user", "on it", 1.0), (7, 5, 99, None, None, None), rows[3], (None, None, None, "user", "lone", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").repartition(5)
    score = {(a, b): s for a, b, _, _, _, s in rows}
    said = {(a, b): (role, x) for a, b, _, role, x, _ in rows}
    for branches in (1, 3):
        got = {(x.tree, x.leaf): x for x in t.format_trees(df, branches).collect()}
        want = {}
        for tree in range(6):
            leaves = [n for (a, n) in parent if a == tree and n not in {p for (b, _), p in parent.items() if b == tree}]

            def path(n, tree=tree):
                out = []
                while n:
                    out.append(n)
                    n = parent[tree, n]
                return out[::-1]

            best = sorted(leaves, key=lambda n, tree=tree: (-sum(score[tree, x] for x in path(n)), n))[:branches]
            want |= {(tree, n): t.render([said[tree, x] for x in path(n)]) for n in best}
        want[7, 5] = t.render([("", "")])
        want[t.NO_ID, t.NO_ID] = t.render([("user", "lone")])
        assert {k: (x.formatted, x.loss_starts, x.loss_ends) for k, x in got.items()} == want
    assert t.format_trees(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b" * 200000), (2, None, None, "x"), (None, 3, "user", "n"), (3, 7, "assistant", "<|im_end|>\n\\"), (3, 7, "assistant", "<|im_end|>\n\\")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "y").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: x for x in t.op10_reply_trees(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -7}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\nhi\nassistant\n\nassistant\n" + "b" * 200000 + "\n") and got[1].loss_chars == 200000
    assert got[3].loss_sha256 == sha("<|im_end|>\n\\" * 2) and got[2].turns_sha256 == sha("\nx\n")
    assert got[-7].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[-7].n_turns == 2
