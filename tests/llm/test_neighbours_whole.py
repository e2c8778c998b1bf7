"""Neighbours in a table with vectors of several lengths, against brute force."""

import numpy as np

from sparkutter.llm import neighbours


def test_every_dimension_is_searched(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3 if i % 3 == 0 else 8 if i % 3 == 1 else 5 if i < 40 else 8)) for i in range(120)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(table, every=4, k=3).select("query_id", "rank", "vec_id").collect()]
    want = []
    for i, v in rows:
        if i % 4 == 0:
            near = sorted((-(v @ x) / np.linalg.norm(v) / np.linalg.norm(x), j) for j, x in rows if j != i and len(x) == len(v))
            want += [(i, n + 1, j) for n, (_, j) in enumerate(near[:3])]
    assert sorted(got) == sorted(want)
