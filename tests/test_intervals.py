import random

from pagewright.operators import intervals


def test_overlaps(spark):
    r = random.Random(6)
    row = lambda i, far: (i, r.choice(["a", "b", None, "hot", "hot", "hot"]), (s := r.randint(-50, 400)), s + r.choice([0, 1, 7, 30, far]))
    left, right = [row(i, 300) for i in range(200)] + [(900, "a", None, 5)], [row(i, 90) for i in range(150)]
    schema = "i int, g string, start int, end int"
    want = sorted((a[0], b[0]) for a in left for b in right if None not in a and a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3])
    for width in (1, 16, 1000):
        met = intervals.overlapping(spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(3), "g", width)
        assert sorted((x.i, x.right_i) for x in met.collect()) == want
        assert met.columns == ["i", "g", "start", "end", "right_i", "right_start", "right_end"]
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
