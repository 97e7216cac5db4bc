import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import index, retrieval, search, vector_blocks

RNG = np.random.default_rng(42)
DIM = 8


def rows(n, keys, base=0, ties=False):
    """Vectors whose first key holds most of the rows."""
    out = []
    for i in range(n):
        key = keys[0] if i % 3 else keys[i % len(keys)]
        dense = np.ones(DIM) if ties and i % 2 else RNG.normal(size=DIM)
        tokens = sorted(RNG.choice(30, size=5, replace=False).tolist())
        out.append((base + i, key, [float(x) for x in dense], [int(t) for t in tokens], [float(x) for x in RNG.random(5)]))
    return out


SCHEMA = "key string, dense array<double>, idx array<bigint>, val array<double>"


def brute(targets, vectors, k, alpha):
    best = {}
    for qid, key, qd, qi, qv in targets:
        scored = []
        for vid, vkey, vd, vi, vv in vectors:
            if vkey == key:
                weights = dict(zip(vi, vv))
                sparse = sum(w * weights.get(t, 0.0) for t, w in zip(qi, qv))
                scored.append((-round(alpha * float(np.dot(qd, vd)) + (1 - alpha) * sparse, 12), vid))
        best[qid, key] = [vid for _, vid in sorted(scored)[:k]]
    return {q: v for q, v in best.items() if v}


SIZES = [dict(), dict(target_block=16, vector_block=40, first=2), dict(target_block=1, vector_block=1, first=1)]


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("ties", [False, True])
def test_all_block_sizes_match_brute_force(spark, sizes, ties):
    targets, vectors = rows(60, ["hot", "a", "b", "none"], ties=ties), rows(300, ["hot", "a", "b", "c"], 1000, ties)
    q = spark.createDataFrame(targets, "query_id bigint, " + SCHEMA)
    v = spark.createDataFrame(vectors, "vec_id bigint, " + SCHEMA).repartition(5)
    got = {}
    for r in search.top_k(q, v, 4, 0.7, **sizes).orderBy("rank").collect():
        got.setdefault((r["query_id"], r["key"]), []).append(r["vec_id"])
    assert got == brute(targets, vectors, 4, 0.7)


def test_plan_has_no_cross_join(spark):
    q = spark.createDataFrame(rows(5, ["a"]), "query_id bigint, " + SCHEMA)
    v = spark.createDataFrame(rows(50, ["a"]), "vec_id bigint, " + SCHEMA)
    for sizes in SIZES:
        plan = search.top_k(q, v, 3, **sizes)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def questions(spark, n=6):
    return spark.createDataFrame(
        [(i, 1, d, ix, v) for i, _, d, ix, v in rows(n, ["x"])],
        "query_id bigint, user_id bigint, dense array<double>, idx array<bigint>, val array<double>")


@pytest.mark.parametrize("own, public, want", [(0, 9, 5), (1, 9, 5), (9, 1, 5), (2, 1, 3), (0, 0, 0)])
def test_hybrid_fills_its_places(spark, own, public, want):
    data = rows(own, ["user_1"], 100) + rows(public, ["public"], 200)
    v = spark.createDataFrame(data, "vec_id bigint, namespace string, dense array<double>, idx array<bigint>, val array<double>")
    hits = retrieval.search(questions(spark), v, "hybrid", 5)
    sizes = {r["query_id"]: r["n"] for r in hits.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert all(sizes.get(q, 0) == want for q in range(6))
    if own >= 3 and public >= 2:
        docs = hits.filter("source_type = 'document'").groupBy("query_id").count().collect()
        assert all(r["count"] == 3 for r in docs)


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        retrieval.search(questions(spark), questions(spark), "other")


def test_gate_without_hits(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    hits = spark.createDataFrame([(1, 0.6), (1, 0.1), (2, 0.59)], "query_id long, score double")
    got = {r["query_id"]: r["is_legal"] for r in retrieval.legal_gate(q, hits).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_sync_first_claim_and_dates(spark):
    unit = [1.0, 0.0]
    chunk = "chunk_ord long, article_key string, law_date string, text string, dense array<double>, idx array<bigint>, val array<double>"
    user = spark.createDataFrame([
        (1, "형법 제1조", "2024-01-01", "a", unit, [7], [1.0]), (2, "형법 제1조", "2025-01-01", "b", unit, [7], [1.0]),
        (3, "형법 제2조", "2020-01-01", "c", unit, [7], [1.0]), (4, "형법 제3조", "", "d", unit, [7], [1.0]),
        (5, "형법 제4조", "2024-01-01", "e", [0.0, 1.0], [7], [1.0]),
    ], chunk)
    public = spark.createDataFrame([
        (10, "형법 제1조", "", unit, [7], [1.0]), (20, "형법 제2조", "2021-01-01", unit, [7], [1.0]),
        (30, "형법 제3조", "1999-01-01", unit, [7], [1.0]), (40, "형법 제4조", "1999-01-01", unit, [7], [1.0]),
    ], "vec_id long, article string, law_date string, dense array<double>, idx array<bigint>, val array<double>")
    got = index.sync_newer(user, public).collect()
    assert [(r["vec_id"], r["chunk_ord"], r["new_text"]) for r in got] == [(10, 1, "a")]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = index.upsert(base, new, "id")
    twice = index.upsert(once, new, "id")
    want = [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want
    empty = spark.createDataFrame([], "id long")
    assert sorted(map(tuple, index.delete_by_ids(base, empty, "id").collect())) == [(1, "a"), (2, "b")]


def test_last_update_of_a_key_counts(spark):
    base = spark.createDataFrame([(1, "old"), (3, "kept")], "id long, v string")
    updates = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "d", 9), (2, "c", 3)], "id long, v string, at int").coalesce(1)
    got = index.upsert(base, updates.drop("at"), "id")
    assert sorted(map(tuple, got.collect())) == [(1, "b"), (2, "c"), (3, "kept")]
    by_order = index.upsert(base.withColumn("at", F.lit(0)), updates, "id", order="at").select("id", "v")
    assert sorted(map(tuple, by_order.collect())) == [(1, "b"), (2, "d"), (3, "kept")]


def test_repeated_text_updates_keep_one_row(spark):
    base = spark.createDataFrame([("x", "old", "2020-01-01"), ("y", "other", None)], "vector_id string, chunk_text string, law_date string")
    updates = spark.createDataFrame([("x", "one", ""), ("x", "two", ""), ("z", "new", "")], "vector_id string, new_text string, new_law_date string").coalesce(1)
    got = index.update_chunk_text(base, updates)
    assert sorted(map(tuple, got.select("vector_id", "chunk_text", "law_date").collect())) == [("x", "two", "2020-01-01"), ("y", "other", None)]
    assert sorted(map(tuple, index.update_hits(base, updates).collect())) == [("x", True), ("z", False)]


@pytest.mark.parametrize("sizes", SIZES)
def test_close_scores_are_told_apart_and_gated_raw(spark, sizes):
    q = spark.createDataFrame([(1, "a", [1.0, 0.0], [], [])], "query_id bigint, " + SCHEMA)
    v = spark.createDataFrame([(5, "a", [0.5999996, 0.0], [], []), (9, "a", [0.5999997, 0.0], [], [])], "vec_id bigint, " + SCHEMA)
    hits = search.top_k(q, v, 2, 1.0, **sizes)
    assert [r["vec_id"] for r in hits.orderBy("rank").collect()] == [9, 5]
    assert not retrieval.legal_gate(q, hits).first()["is_legal"]


@pytest.mark.parametrize("sizes", SIZES)
def test_malformed_vectors_take_no_part(spark, sizes):
    q = spark.createDataFrame([(1, "a", [1.0, 0.0], [], []), (2, "a", None, [], [])], "query_id bigint, " + SCHEMA)
    v = spark.createDataFrame([
        (5, "a", [0.5, 0.0], [], []), (6, "a", None, [], []), (7, "a", [1.0], [], []), (8, "a", [None, 1.0], [], []),
        (9, None, [1.0, 1.0], [], []), (10, "a", [float("nan"), 1.0], [], []), (11, "a", [], [], [])], "vec_id bigint, " + SCHEMA)
    assert [(r["query_id"], r["vec_id"]) for r in search.top_k(q, v, 3, 1.0, **sizes).collect()] == [(1, 5)]
    assert sorted(r["vec_id"] for r in vector_blocks.malformed(v).collect()) == [6, 8, 9, 10, 11]
    assert search.top_k(q.limit(0), v, 3).count() == search.top_k(q, v.limit(0), 3).count() == 0


def test_every_vector_length_is_searched(spark):
    q = spark.createDataFrame([(1, "a", [1.0, 0.0], [], []), (2, "a", [1.0, 0.0], [], []), (3, "a", [1.0, 0.0, 0.0], [3], [1.0])], "query_id bigint, " + SCHEMA)
    v = spark.createDataFrame([(5, "a", [1.0, 0.0], [], []), (6, "a", [1.0, 0.0, 0.0], None, None), (7, "a", [0.5, 0.0, 0.0], [3], [2.0])], "vec_id bigint, " + SCHEMA)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in search.top_k(q, v, 2, 0.5).collect()}
    assert got == {(1, 1): (5, 0.5), (2, 1): (5, 0.5), (3, 1): (7, 1.25), (3, 2): (6, 0.5)}


def test_bounds_prune_and_stay_exact(spark):
    """Clustered vectors under one hot key: few pairs of blocks reach a target's k-th score."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(24, DIM)) * 4

    def near(i, base):
        c = i % 24
        tokens = sorted({100 * c + int(t) for t in rng.integers(0, 40, 4)})
        return (base + i, "hot" if i % 5 else "cold", (centres[c] + 0.1 * rng.normal(size=DIM)).tolist(), tokens, rng.random(len(tokens)).tolist())

    targets, vectors = [near(i, 0) for i in range(0, 120, 3)], [near(i, 1000) for i in range(2400)]
    q = spark.createDataFrame(targets, "query_id bigint, " + SCHEMA)
    v = spark.createDataFrame(vectors, "vec_id bigint, " + SCHEMA)
    got = {}
    for r in search.top_k(q, v, 3, 0.6, target_block=4, vector_block=50).orderBy("rank").collect():
        got.setdefault((r["query_id"], r["key"]), []).append(r["vec_id"])
    assert got == brute(targets, vectors, 3, 0.6)
    a, b = vector_blocks.blocks(q, "query_id", 1), vector_blocks.blocks(v, "vec_id", 50, compact=True)
    pairs = vector_blocks.bounds(vector_blocks.summaries(a, "a_").join(vector_blocks.summaries(b, "b_"), ["key", "dim"]), 0.6).collect()
    best = {}
    for qid, key, qd, qi, qv in targets:
        best[qid] = sorted((0.6 * float(np.dot(qd, vd)) + 0.4 * sum(w * dict(zip(vi, vv)).get(t, 0.0) for t, w in zip(qi, qv))
                            for _, vkey, vd, vi, vv in vectors if vkey == key), reverse=True)[2]
    of = {r["block"]: r["ids"][0] for r in a.select("block", "ids").collect()}
    open_ = [p for p in pairs if p["bound"] >= best[of[p["a_block"]]]]
    assert len(open_) < 0.35 * len(pairs)


@pytest.mark.parametrize("alpha", [-0.5, 0.0, 0.7, 1.0, 1.4])
def test_no_score_is_above_its_bound(spark, alpha):
    rng = np.random.default_rng(int(10 * alpha) + 50)
    data = [(i, "k", (rng.normal(size=3) * rng.choice([0.01, 1, 50])).tolist(), [int(t) for t in rng.choice(600, 6, replace=False)], rng.normal(size=6).tolist())
            for i in range(60)]
    v = spark.createDataFrame(data, "vec_id bigint, " + SCHEMA)
    packed = vector_blocks.blocks(v, "vec_id", 7, compact=True)
    members = {r["block"]: r["ids"] for r in packed.select("block", "ids").collect()}
    assert sorted(i for ids in members.values() for i in ids) == list(range(60))
    for p in vector_blocks.bounds(vector_blocks.summaries(packed, "a_").join(vector_blocks.summaries(packed, "b_"), ["key", "dim"]), alpha).collect():
        for i in members[p["a_block"]]:
            for j in members[p["b_block"]]:
                sparse = sum(w * dict(zip(data[j][3], data[j][4])).get(t, 0.0) for t, w in zip(data[i][3], data[i][4]))
                assert alpha * float(np.dot(data[i][2], data[j][2])) + (1 - alpha) * sparse <= p["bound"]


def test_many_keys(spark):
    n = 4000
    q = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("k"), "id").alias("key"), F.expr("array(1.0D, id % 7)").alias("dense"),
                              F.expr("array(id % 5)").alias("idx"), F.expr("array(0.5D)").alias("val"))
    v = spark.range(2 * n).select(F.col("id").alias("vec_id"), F.concat(F.lit("k"), F.col("id") % n).alias("key"), F.expr("array(2.0D, id % 3)").alias("dense"),
                                  F.expr("array(id % 5)").alias("idx"), F.expr("array(0.5D)").alias("val"))
    got = {r["query_id"]: (r["vec_id"], r["score"]) for r in search.top_k(q, v, 1, 0.5).collect()}
    score = lambda i, j: 0.5 * (2.0 + (i % 7) * (j % 3)) + 0.5 * (0.25 if i % 5 == j % 5 else 0.0)
    assert got == {i: max(((j, score(i, j)) for j in (i, i + n)), key=lambda x: (x[1], -x[0])) for i in range(n)}


def test_grid_of_bands_matches_brute_force(spark, monkeypatch):
    """Many bands and slices, tokens that most vectors hold beside rare ones: a block goes once to every cell it is needed in."""
    monkeypatch.setattr(search, "BAND", 48)
    monkeypatch.setattr(search, "SLICE", 20)
    rng = np.random.default_rng(3)

    def some(n, base):
        tokens = [sorted({*rng.integers(0, 6, 4).tolist(), *rng.integers(100, 4000, 6).tolist()}) for _ in range(n)]
        return [(base + i, "hot" if i % 4 else "b", rng.normal(size=DIM).tolist(), t, rng.random(len(t)).tolist()) for i, t in enumerate(tokens)]

    targets, vectors = some(130, 0), some(300, 1000)
    q = spark.createDataFrame(targets, "query_id bigint, " + SCHEMA)
    v = spark.createDataFrame(vectors, "vec_id bigint, " + SCHEMA)
    got = {}
    for r in search.top_k(q, v, 4, 0.5, target_block=10, vector_block=8).orderBy("rank").collect():
        got.setdefault((r["query_id"], r["key"]), []).append(r["vec_id"])
    assert got == brute(targets, vectors, 4, 0.5)


def test_weights_that_are_no_numbers_stay_with_their_tokens(spark):
    inf = float("inf")
    q = spark.createDataFrame([(1, "a", [1.0], [1, 2], [1.0, inf]), (2, "a", [1.0], [1], [1.0])], "query_id bigint, " + SCHEMA)
    v = spark.createDataFrame([(5, "a", [0.5], [1, 9], [0.5, inf]), (6, "a", [0.25], [1], [0.5])], "vec_id bigint, " + SCHEMA)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in search.top_k(q, v, 2, 0.5).collect()}
    assert got == {(1, 5): 0.5, (1, 6): 0.375, (2, 5): 0.5, (2, 6): 0.375}


def test_blocks_are_sorted_together_not_collected(spark):
    """A task packs one block at a time, and blocks are rows of some MB."""
    v = spark.createDataFrame(rows(700, ["hot"]), "vec_id bigint, " + SCHEMA)
    assert search.TARGET_BLOCK <= 256 and search.VECTOR_BLOCK <= 256
    seen, staged_ = [], vector_blocks.staged

    def watch(df, name, *more):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return staged_(df, name, *more)

    vector_blocks.staged = watch
    try:
        packed = vector_blocks.blocks(v, "vec_id", 50, compact=True)
    finally:
        vector_blocks.staged = staged_
    assert sorted(i for r in packed.select("ids").collect() for i in r["ids"]) == list(range(700))
    assert not any("collect_list" in text for text in seen)


def test_every_twentieth_row_is_asked_against_all(spark):
    from lexmill.plans.catalog import QUERIES

    from .conftest import SF

    got = QUERIES["search_general"](spark, SF).collect()
    assert {r["query_id"] for r in got} == set(range(0, 500, 20)) and any(r["vec_id"] % 20 for r in got)
