import math
import random

import pytest
from pyspark.sql import functions as F

from pulse.llm import vector_search as V


def brute(rows, k):
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ints:
        if q % 20 == 0:
            found = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(a, b)))), c) for c, b in ints if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def vectors(n, dim, scale=1.0):
    rnd = random.Random(dim)
    rows = [(i, [rnd.gauss(0, scale) for _ in range(dim)]) for i in range(n)]
    return rows + [(20, rows[1][1]), (n, None), (n + 1, [None] * dim), (n + 2, [math.nan] * dim), (n + 3, [math.inf] * dim),
                   (None, rows[0][1]), (n + 4, []), (n + 5, [1.0] * (dim // 2)), *[(n + 10 + j, rows[5][1]) for j in range(30)]]


@pytest.mark.parametrize("n,dim,scale", [(400, 37, 1.0), (300, 64, 3000.0), (40, 8, 1e12), (30, 1, 0.01)])
def test_top_k_equals_brute_force(spark, n, dim, scale):
    rows = vectors(n, dim, scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("score", F.lit("x"))
    got = V.exact_top_k(df, F.col("vec_id") % 20 == 0, k=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_several_passes_and_empty_tables(spark):
    rows = vectors(200, 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rounded = [(r[0], r[1]) for r in df.collect()]
    got = V.exact_top_k(df, F.col("vec_id") % 20 == 0, k=5, pass_bytes=400)
    assert sorted(map(tuple, got.collect())) == brute(rounded, 5)
    assert V.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert V.exact_top_k(df, F.col("vec_id") < 0).collect() == []
