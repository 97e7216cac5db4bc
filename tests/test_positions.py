import random

from pyspark.sql import functions as F

from lexmill.operators.positions import positions


def test_positions_of_groups_and_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "", "a", "hot", "hot", "hot"]), rng.choice([None, *range(40)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    got = positions(df, [F.asc_nulls_first("k")], by=("g",), ranges=9).collect()
    for g in {r[0] for r in rows}:
        want = sorted((k for h, k in rows if h == g), key=lambda k: (k is not None, k or 0))
        own = sorted((r["position"], r["k"]) for r in got if r["g"] == g)
        assert [p for p, _ in own] == list(range(len(want))) and [k for _, k in own] == want


def test_positions_of_everything(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit("x").alias("odd.name"))
    got = positions(df, [F.desc("v")], name="at", ranges=5)
    assert got.columns == ["v", "odd.name", "at"]
    assert all(r["at"] == 999 - r["v"] for r in got.collect())
    assert positions(df.limit(0), [F.asc("v")]).count() == 0


def test_one_key_spreads_over_ranges(spark):
    df = spark.createDataFrame([(1,)] * 5000, "v int")
    got = positions(df, [F.asc("v")], ranges=4)
    assert sorted(r["position"] for r in got.collect()) == list(range(5000))
