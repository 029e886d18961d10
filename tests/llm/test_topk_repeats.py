"""Top-k with repeated rows and ids against brute force."""

import math
import random

from tracelake.llm import topk


def test_repeated_rows_count_once(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [(50, [9.0, 9.0, 9.0]), (7, rows[3][1])]  # ids with two vectors
    df = spark.createDataFrame(rows * 2 + [rows[1]] * 20, "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.filter("vec_id % 20 = 0"), 5).collect()
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for q, a in good:
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:5]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted(map(tuple, found)) == sorted(want)
