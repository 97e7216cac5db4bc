import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import topk


def coded(df):
    return df.select(F.col("vec_id").alias("id"), topk.codes(F.col("embedding")).alias("codes")).filter("id is not null and codes is not null")


def brute(rows, k):
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            scores = [(-int(np.dot(q, v)), j) for j, v in rows if j != i and len(v) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def check(spark, rows, k, **options):
    df = coded(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string"))
    got = {}
    for r in topk.search(df, df.filter("id % 20 = 0"), k=k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    plain = [(i, [math.floor(64 * x) for x in np.float32(v).astype(float)]) for i, v, *_ in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert got == {i: x for i, x in brute(plain, k).items() if x}


def test_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.choice([-0.5, 0.0, 0.25, 0.5], 8).tolist(), 1, "x") for i in range(400)]
    rows += [(1000 + i, rows[0][1], 1, "x") for i in range(50)]
    check(spark, rows, 5)
    check(spark, rows, 5, block=7, cells=11, segments=(2,))


def test_pruning_keeps_clustered_results(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + 0.05 * rng.normal(size=64)).tolist(), None, None) for i in range(900)]
    check(spark, rows, 20, cells=3)


def test_rows_that_take_no_part(spark):
    good = [(i, [0.1 * i, 0.5], 1, None) for i in range(45)]
    odd = [(20, [None, 1.0], 1, ""), (40 * 20, None, 1, ""), (60 * 20, [float("nan"), 1.0], 1, ""), (61, [float("inf"), 1.0], 1, ""),
           (None, [1.0, 1.0], 1, ""), (80 * 20, [1.0, 2.0, 3.0], 1, "")]
    check(spark, [r for r in good if r[0] != 20] + odd, 3)
    empty = coded(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(empty, empty).count() == 0


def test_bound_holds():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-60, 60, (40, 30)), rng.integers(-60, 60, (50, 30))
    for n in (1, 4, 7):
        assert (topk._stats(a, n) @ topk._stats(b, n).T >= a @ b.T - 1e-6).all()


def test_components_of_any_size_and_empty_vectors(spark):
    big = [(20, [5e6, 1.0]), (2, [-3e7, 2.0]), (3, [1e8, -1e8]), (4, [1.0, 1.0]), (5, [2.0**28, 3.0]), (6, [])]
    rows = [(i, v) for i, v in big] + [(100 + i, [float(i), 1e7]) for i in range(30)]
    df = coded(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["vec_id"], r["score"]) for r in topk.search(df, df.filter("id = 20"), k=40, cells=2).orderBy("rank").collect()]
    codes = {i: [math.floor(64 * x) for x in v] for i, v in rows if v}
    want = sorted((-(codes[20][0] * c[0] + codes[20][1] * c[1]), i) for i, c in codes.items() if i != 20)
    assert got == [(i, -s) for s, i in want]


@pytest.mark.parametrize("value", [2.0**58, 2.0**40])
def test_what_a_long_cannot_hold_fails_clearly(spark, value):
    df = coded(spark.createDataFrame([(20, [value, 1.0]), (40, [value, 1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="fit in a long"):
        topk.search(df, df, k=2).collect()
