"""Stores as logs, with several writers and writers that die, and texts that come back as they were."""

import os
import threading

import pytest

from pagewright.operators import chapters
from pagewright.sources import sinks


def page(spark, n, status, seq, total=3):
    return spark.createDataFrame([("b", n, total, status, f"r{seq}", None, seq)], sinks.PAGES.schema)


def state(spark, path):
    return {(x.page, x.status, x.result) for x in sinks.read_store(spark, path, sinks.PAGES).collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_newest_rows_and_dead_writers(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert sinks.read_store(spark, path, sinks.PAGES).count() == 0
    for n, status, seq in ((1, "done", 1), (2, "error", 2), (2, "done", 3), (1, "error", 0)):
        sinks.save_pages(spark, path, page(spark, n, status, seq))
    page(spark, 3, "done", 9).write.parquet(f"{path}/rows-dead")  # its writer never claimed a number
    open(f"{path}/log/{4:012d}", "w").close()  # this one died while it did
    assert state(spark, path) == {(1, "done", "r1"), (2, "done", "r3")}
    sinks.save_pages(spark, path, page(spark, 3, "done", 4))
    assert (3, "done", "r4") in state(spark, path)
    wanted = spark.createDataFrame([("b", 1, 3), ("b", 4, 3), ("b", 2, 9), ("c", 1, 3)], "pdf string, page int, total int")
    done, todo = sinks.resume_pages(spark, path, wanted)
    assert [x.page for x in done.collect()] == [1] and sorted((x.pdf, x.page) for x in todo.collect()) == [("b", 2), ("b", 4), ("c", 1)]


def test_two_writers_both_succeed(spark, tmp_path):
    path = f"{tmp_path}/store"
    failed = []

    def write(k):
        try:
            for i in range(4):
                sinks.save_pages(spark, path, page(spark, 10 * k + i, "done", i))
        except Exception as e:  # shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert failed == [] and {p for p, *_ in state(spark, path)} == {10 * k + i for k in range(3) for i in range(4)}
    assert not sinks._claim(spark, path, 0, "x -1\n")


def test_changes_cost_their_own_size(spark, tmp_path):
    path = f"{tmp_path}/store"
    many = spark.range(20_000).selectExpr("'b' as pdf", "cast(id as int) as page", "3 as total", "'done' as status", "uuid() as result", "cast(null as string) as error", "0L as seq")
    sinks.save_pages(spark, path, many)
    whole = size(path)
    sinks.save_pages(spark, path, page(spark, 1, "error", 5))
    assert size(path) - whole < whole / 20
    for i in range(2 * sinks.MOST_CHANGES):
        sinks.save_pages(spark, path, page(spark, i, "error", 6 + i))
    live = sinks._live(sinks._entries(spark, path))
    assert len(live) <= sinks.MOST_CHANGES + 1
    found = sinks.read_store(spark, path, sinks.PAGES)
    assert found.count() == 20_000 and found.where("status = 'error'").count() == 2 * sinks.MOST_CHANGES
    assert len([x for x in os.listdir(path) if x.startswith("rows-")]) < 2 * sinks.MOST_CHANGES


def test_dictionary(spark, tmp_path):
    path = f"{tmp_path}/words"
    rows = spark.createDataFrame([("fix", "a", "b", 1), ("fix", "a", "c", 2), ("ignore", "z", None, 0)], sinks.DICTIONARY.schema)
    for _ in range(2):
        sinks.save_dictionary(spark, path, rows)
    fixes, ignored = sinks.read_dictionary(spark, path)
    assert [tuple(x) for x in fixes.collect()] == [("a", "c")] and [x.word for x in ignored.collect()] == ["z"]


def test_texts_come_back(spark, tmp_path):
    rows = [("007", "a\n"), ("7", "a\n\n"), ("x/y=z", "\r\n\x0b \"\\é😀"), (None, ""), ("1e3", None), ("2020-01-01", " a ")]
    sinks.write_texts(spark.createDataFrame(rows, "book string, body string"), f"{tmp_path}/texts")
    assert sorted(map(tuple, sinks.read_texts(spark, f"{tmp_path}/texts").collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("context,most", [(3, None), (40, None), (0, 2)])
def test_find_in_context(spark, context, most):
    import re

    texts = ["", None, "aXbXXc", "no", "X", "XX" * 20, "é😀X漢 X", "x" * 100 + "X" + "y" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted(map(tuple, chapters.find(df, "i", "t", "X", context, most).collect()))
    want = []
    for i, t in enumerate(texts):
        for n, m in list(enumerate(re.finditer("X", t or ""), 1))[:most]:
            want.append((i, n, m.start(), t[max(0, m.start() - context) : m.start()], "X", t[m.end() : m.end() + context]))
    assert got == sorted(want)
    plan = chapters.find(df, "i", "t", "X", context, most)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
