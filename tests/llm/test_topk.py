import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edilake.llm import topk


def brute(rows, k, is_query):
    vs = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            vs[i] = [math.floor(1024 * x) for x in v]
    out = []
    for q in vs:
        if is_query(q):
            got = sorted((-sum(a * b for a, b in zip(vs[q], v)), i) for i, v in vs.items() if i != q and len(v) == len(vs[q]))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(got, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,dims", [(1, 3), (5, 2), (300, 8), (2000, 24)])
def test_index_keeps_every_possible_member(n, dims):
    rng = np.random.default_rng(n)
    x = np.floor(rng.normal(size=(n, dims)) * 300).astype(np.int64)
    x[n // 3 : n // 2] = x[0]
    index = topk.Index(x)
    for q in x[:: max(1, n // 20)]:
        live, score = index.search(q, 10)
        every = x @ q
        assert (every[live] == score).all()
        least = np.sort(every)[-min(10, n)]
        assert set(np.flatnonzero(every >= least)) <= set(live)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rnd = random.Random(2)
    rows = [(k, [rnd.gauss(0, 0.3) for _ in range(6)]) for k in range(150)]
    rows += [(k, [0.25, -0.5, 0.0, 1.0, 0.1, 0.1]) for k in range(200, 240)]
    rows += [(300, None), (310, []), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (330, [float("nan")] * 6), (340, [float("inf")] * 6), (350, [1.0, 2.0]), (360, [3.0, -1.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as id")
    got = sorted(tuple(r) for r in topk.search(df, F.col("id") % 10 == 0).collect())
    assert got == brute(rows, 10, lambda i: i % 10 == 0)
    assert topk.search(df.limit(0), F.col("id") % 10 == 0).count() == 0
