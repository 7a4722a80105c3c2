import numpy as np
import pytest

from linkwright.llm.topk import exact_topk, quantize


def brute(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted(((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in vectors if i != q))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("n,dims,lists", [(300, 8, 2), (300, 8, 4), (5, 3, 2), (40, 1, 2), (1, 4, 2)])
def test_against_all_pairs(spark, n, dims, lists):
    r = np.random.default_rng(n + dims)
    x = r.integers(-20, 20, (n, dims))
    x[n // 2 :] = x[: n - n // 2]  # ties
    rows = [(i, [int(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    queries = [row for row in rows if row[0] % 10 == 0]
    got = exact_topk(df, spark.createDataFrame(queries, "vec_id long, v array<long>"), 10, lists, query_block=7, vector_block=64).collect()
    assert sorted(map(tuple, got)) == brute(rows, queries, 10)


def test_quantize_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.0001]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = quantize(df)
    assert sorted((r["vec_id"], r["v"]) for r in q.collect()) == [(0, [512, -1]), (5, [1024, 1024]), (6, [1024, 1024])]
    got = exact_topk(q, q.where("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 5, 512 * 1024 - 1024), (2, 6, 512 * 1024 - 1024)]
    assert exact_topk(q.limit(0), q.limit(0)).count() == 0
    assert exact_topk(q, q.limit(0)).count() == 0


def test_large_numbers_stay_exact(spark):
    big = (1 << 30) + 1
    rows = [(i, [big, big + i]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = exact_topk(df, df.where("vec_id = 0"), 2).collect()
    assert sorted(map(tuple, got)) == brute(rows, rows[:1], 2)


def test_lengths_that_differ_never_pair(spark):
    r = np.random.default_rng(4)
    rows = [(i, [int(c) for c in r.integers(-9, 9, i % 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = exact_topk(df, df.where("vec_id % 7 = 0"), 10, query_block=4, vector_block=16).collect()
    want = []
    for n in range(4):
        same = [x for x in rows if len(x[1]) == n]
        want += brute(same, [x for x in same if x[0] % 7 == 0], 10)
    assert sorted(map(tuple, got)) == sorted(want)
