import math
import random

import numpy as np

from pyspark.sql import functions as F

from memlake.llm.search import Postings, quantised, scores, top_k


def brute(rows, queries, k):
    use = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in use:
        if queries(q):
            got = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in use if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(got)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(9)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(430, None), (431, [None] * 9), (432, [float("nan")] + [0.0] * 8), (433, [float("inf")] + [0.0] * 8), (-3, [0.5] * 9), (434, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    v = quantised(df)
    for block in (3, 1024):
        got = top_k(v.where(F.col("vec_id") % 10 == 0), v, block=block)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(exact, lambda q: q % 10 == 0, 10)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    v = quantised(df)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in top_k(v.where("vec_id = 0"), v).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert top_k(v.where("false"), v).count() == 0 and top_k(v.where("false"), v.where("false")).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(0, [3.0, 1.0]), (0, [3.0, 0.0]), (None, [3.0, 1.0]), (5, [3.0, 1.0]), (None, [-1.0]), (200, [0.0, 0.0]), (7, [float("-inf"), 1.0])]
    v = quantised(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, row int"))
    got = [tuple(r) for r in top_k(v.where("vec_id % 100 = 0"), v, k=3).collect()]
    n = 1024 * 1024
    want = [(0, 1, 5, 10 * n), (0, 2, None, 10 * n), (0, 3, 0, 9 * n), (0, 1, 0, 9 * n), (0, 2, 5, 9 * n), (0, 3, None, 9 * n), (200, 1, 0, 0), (200, 2, 0, 0), (200, 3, 5, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_dense_and_sparse_rows_scatter_alike(spark):
    rng = np.random.default_rng(3)
    for share in (0.02, 0.5, 1.0):
        q, c = (rng.integers(-1000, 1000, (n, 40)) * (rng.random((n, 40)) < share) for n in (20, 70))
        assert (scores(q, Postings(list(c))) == (q @ c.T).T).all()
