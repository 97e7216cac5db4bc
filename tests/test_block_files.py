"""Searches whose tasks fetch blocks from their files."""

import pytest

from lexmill.operators import search, vector_blocks

from .test_search import SCHEMA, brute, rows


def hits(df):
    got = {}
    for r in df.orderBy("rank").collect():
        got.setdefault((r["query_id"], r["key"]), []).append(r["vec_id"])
    return got


@pytest.fixture(scope="module")
def sides(spark):
    targets, vectors = rows(200, ["hot", "a", "b"]), rows(400, ["hot", "a", "b", "c"], 1000, ties=True)
    return targets, vectors, spark.createDataFrame(targets, "query_id bigint, " + SCHEMA), spark.createDataFrame(vectors, "vec_id bigint, " + SCHEMA)


def test_no_block_moves_through_a_shuffle(sides):
    _, _, q, v = sides
    plan = search.top_k(q, v, 3, 0.7, target_block=5, vector_block=5)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line or "Scan parquet" in line]
    assert moved and not any(c in line for line in moved for c in ("tokens", "weights", "dense"))


@pytest.mark.parametrize("share", [1, 3, 1000])
def test_vectors_shared_out_to_tasks(spark, sides, monkeypatch, share):
    monkeypatch.setattr(search, "SHARE", share)
    monkeypatch.setattr(search, "SLICE", 16)
    targets, vectors, q, v = sides
    assert hits(search.top_k(q, v, 4, 0.7, target_block=40, vector_block=8)) == brute(targets, vectors, 4, 0.7)


def test_an_index_laid_out_anew_is_searched(spark, sides, tmp_path):
    """Neither file names nor the order of rows tell where a block lies then."""
    targets, vectors, q, v = sides
    packed = search.pack(v, 8)
    packed.orderBy("radius").coalesce(1).write.parquet(str(tmp_path / "an index"))
    assert hits(search.top_k(q, spark.read.parquet(str(tmp_path / "an index")), 4, 0.7)) == brute(targets, vectors, 4, 0.7)
    cached = packed.withColumn("n", packed["n"]).localCheckpoint()
    assert hits(search.top_k(q, cached, 4, 0.7)) == brute(targets, vectors, 4, 0.7)


def test_large_keys_are_packed_where_they_lie(spark, sides):
    targets = sides[0] + [(900 + i, None, [1.0], [], []) for i in range(3)]
    q = spark.createDataFrame(targets, "query_id bigint, " + SCHEMA).repartition(3)
    packed = vector_blocks.blocks(q, "query_id", 6)
    got = packed.select("key", "n", "ids", "rows", "tokens").collect()
    assert sorted(i for r in got for i in r["ids"]) == [t[0] for t in targets if t[1]]
    tokens = {t[0]: t[3] for t in targets}
    for r in got:
        assert r["n"] == len(r["ids"]) and {t[1] for t in targets if t[0] in r["ids"]} == {r["key"]}
        assert [[x for x, at in zip(r["tokens"], r["rows"]) if at == i] for i in range(r["n"])] == [tokens[i] for i in r["ids"]]
    assert max(r["n"] for r in got if r["key"] == "hot") == 6  # at most the size, where a hash may go beyond it
