import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexmill.sources.vector_store import VectorStore
from lexmill.streaming import jobs

SCHEMA = "namespace string, vec_id long, dense array<double>, v string"


def rows(spark, *items):
    return spark.createDataFrame([(n, i, [1.0], v) for n, i, v in items], SCHEMA)


def content(store, namespace=None):
    return {(r["namespace"], r["vec_id"]): r["v"] for r in store.read(namespace).collect()}


def test_a_model_of_upserts_deletes_and_compactions(spark, tmp_path):
    rng = random.Random(3)
    store, model = VectorStore(spark, str(tmp_path / "t"), most_deltas=2, most_share=3.0), {}
    for step in range(10):
        some = {(rng.choice([None, "hot", "hot", "u1"]), rng.randint(0, 30)): f"{step}" for _ in range(6)}
        if step % 4 == 3:
            store.delete(rows(spark, *[(n, i, "") for n, i in some]))
            model = {k: v for k, v in model.items() if k not in some}
        else:
            store.upsert(rows(spark, *[(n, i, v) for (n, i), v in some.items()]))
            model |= some
        if step == 6:
            store.compact()
        assert content(store) == model
    assert content(store, "hot") == {k: v for k, v in model.items() if k[0] == "hot"}
    gone = store.vacuum()
    assert gone and content(store) == model


def test_first_batch_on_an_empty_target_and_missing_table(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.delete(rows(spark, ("a", 1, "x"))).version == 0
    store.upsert(rows(spark, ("a", 1, "x")).limit(0))
    assert content(store) == {}
    store.upsert(rows(spark, ("a", 1, "x")))
    assert content(store) == {("a", 1): "x"}


def test_repeated_ids_ask_for_an_order(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "t"))
    twice = rows(spark, ("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z")).withColumn("at", F.when(F.col("v") == "x", 9).otherwise(1))
    with pytest.raises(PySparkException, match="name an order"):
        store.upsert(twice.drop("at"))
    store.upsert(twice, order="at")
    assert content(store) == {("a", 1): "x", ("a", 2): "z"}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "t"))
    one = store.upsert(rows(spark, ("a", 1, "x")), batch=("w", 0))
    store.upsert(rows(spark, ("a", 1, "later")), batch=("w", 1))
    store.upsert(rows(spark, ("a", 1, "x")), batch=("w", 0))
    assert content(store) == {("a", 1): "later"} and store.manifest().version > one.version


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = VectorStore(spark, str(tmp_path / "t"))
    store.upsert(rows(spark, ("a", 1, "x")))
    monkeypatch.setattr(VectorStore, "_commit", lambda self, new: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.upsert(rows(spark, ("a", 1, "lost"), ("a", 2, "lost")))
    monkeypatch.undo()
    assert content(store) == {("a", 1): "x"}
    assert any(d.startswith("delta-") for d in store.vacuum()) and content(store) == {("a", 1): "x"}


def test_two_writers_both_count(spark, tmp_path, monkeypatch):
    store = VectorStore(spark, str(tmp_path / "t"), most_share=100.0)
    store.upsert(rows(spark, ("a", 1, "x")))
    store.compact()
    commit, raced = VectorStore._commit, []

    def race(self, new):
        if not raced:
            raced.append(1)
            VectorStore(spark, self.path, most_share=100.0).upsert(rows(spark, ("b", 1, "other"), ("a", 3, "other")))
        return commit(self, new)

    monkeypatch.setattr(VectorStore, "_commit", race)
    store.upsert(rows(spark, ("a", 2, "mine"), ("a", 3, "mine")))
    assert content(store) == {("a", 1): "x", ("a", 2): "mine", ("a", 3): "mine", ("b", 1): "other"}


def test_an_update_writes_its_own_rows(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "t"), file_bytes=200_000)
    big = spark.range(20_000).select(F.lit("hot").alias("namespace"), F.col("id").alias("vec_id"),
                                     F.array(*[F.rand(i) for i in range(8)]).alias("dense"), F.lit("x").alias("v"))
    base = store.upsert(big).base
    files = list((tmp_path / "t" / "data" / base["folder"]).glob("part-*"))
    assert base["bytes"] > 1_000_000 and len(files) >= 5  # one namespace, files by bytes
    now = store.upsert(rows(spark, *[("hot", i, "new") for i in range(100)]))
    assert now.base == base and sum(d["bytes"] for d in now.deltas) < 0.05 * base["bytes"]
    got = store.read().groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {"x": 19_900, "new": 100}


def test_a_stream_fills_an_empty_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows(spark, ("a", 1, "x"), ("a", 2, "y")).write.mode("overwrite").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.upsert_batches(source, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert content(VectorStore(spark, str(tmp_path / "t"))) == {("a", 1): "x", ("a", 2): "y"}
