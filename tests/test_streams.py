"""Streams fed in several micro-batches equal their batch twins."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions.chunking import ChunkConfig
from lexmill.functions.text import has_min_text
from lexmill.operators import index, sessions
from lexmill.plans import fixtures
from lexmill.plans.base import table
from lexmill.streaming import jobs

from .conftest import SF


def feed(spark, df, path, parts, split):
    """Write ``df`` as one file per part and stream one file per micro-batch."""
    for i in range(parts):
        df.filter(split == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def turns(spark):
    return fixtures.turns(spark, SF).select("session_id", "turn", "question").cache()


def test_context_follows_sessions_across_batches(spark, turns, tmp_path):
    stream = feed(spark, turns, str(tmp_path / "in"), 3, F.when(F.col("turn") < 2, 0).when(F.col("turn") < 4, 1).otherwise(2))
    jobs.write_batches(jobs.stream_context(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = sessions.expand_questions(turns, F.floor(F.col("turn") / 1000), at="turn", tie="turn")
    want = rows(batch, "session_id", "turn", "search_text")
    assert rows(spark.read.parquet(str(tmp_path / "out")), "session_id", "turn", "search_text") == want


def test_context_of_missing_questions(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c"), (2, 0, None), (2, 1, ""), (2, 2, "z")], "session_id long, turn long, question string")
    stream = feed(spark, turns, str(tmp_path / "in"), 2, F.when(F.col("turn") < 2, 0).otherwise(1))
    jobs.write_batches(jobs.stream_context(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = sessions.expand_questions(turns, F.floor(F.col("turn") / 1000), at="turn", tie="turn")
    want = rows(batch, "session_id", "turn", "search_text")
    assert rows(spark.read.parquet(str(tmp_path / "out")), "session_id", "turn", "search_text") == want


def test_sessions_latest_version(spark, turns, tmp_path):
    stream = feed(spark, turns, str(tmp_path / "in"), 2, F.col("turn") % 2)
    jobs.write_batches(jobs.stream_sessions(stream, at="turn"), str(tmp_path / "out"), str(tmp_path / "cp"), "update").awaitTermination()
    got = jobs.latest(spark, str(tmp_path / "out"), ["session_id"])
    columns = ("session_id", "title", "last_message_at", "turns")
    assert rows(got, *columns) == rows(sessions.session_rollup(turns, at="turn"), *columns)


def test_index_stream_equals_batch(spark, tmp_path):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    stream = feed(spark, docs, str(tmp_path / "in"), 3, F.col("doc_id") % 3)
    cfg = ChunkConfig(500, 50, 20)
    jobs.append_files(jobs.stream_index(stream, cfg, detect=False), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    kept = index.dedup_exact(docs.filter(has_min_text("text")))
    batch = index.chunk_documents(kept, cfg, detect=False)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "text") == rows(batch, "text")


def test_watermarked_dedup(spark, tmp_path):
    docs = table(spark, SF, "documents").select("doc_id", "text").withColumn(
        "at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")))
    stream = feed(spark, docs, str(tmp_path / "in"), 1, F.lit(0))
    jobs.append_files(
        jobs.stream_index(stream, detect=False, event_time="at"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    kept = index.dedup_exact(docs.filter(has_min_text("text")))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "text") == rows(index.chunk_documents(kept, detect=False), "text")


@pytest.mark.parametrize("make", [
    lambda logs: jobs.stream_log_errors(logs), lambda logs: jobs.stream_log_errors(logs, "2 hours", "1 hour"),
    lambda logs: jobs.stream_error_sessions(logs),
])
def test_log_windows(spark, tmp_path, make):
    logs = fixtures.logs(spark, SF).withColumn("created_at", F.col("created_at").cast("timestamp"))
    stream = feed(spark, logs, str(tmp_path / "in"), 1, F.lit(0))
    out = str(tmp_path / "out")
    jobs.write_batches(make(stream), out, str(tmp_path / "cp"), "append").awaitTermination()
    want = rows(make(logs), "start", "level", "n")
    got = rows(spark.read.parquet(out), "start", "level", "n")
    # append mode holds back what later rows could still change
    assert set(got) <= set(want) and len(want) - len(got) <= 6


def test_repeated_batch_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    stream = feed(spark, df, str(tmp_path / "in"), 1, F.lit(0))
    out = str(tmp_path / "out")
    jobs.write_batches(stream, out, str(tmp_path / "cp1")).awaitTermination()
    jobs.write_batches(stream, out, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_sessions_leave_the_state_when_idle(spark, tmp_path):
    from lexmill.plans.stream_queries import settings

    at = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m, 0)"
    data = [(0, 1, 5, "b"), (0, 1, 0, "a"), (0, 2, 3, None), (1, 1, 20, "c"), (1, 3, 60, "d"), (2, 4, 300, "e"), (3, 2, 15, "late"), (3, 5, 700, "f"), (3, 1, 690, "again"), (4, 6, 900, "g")]
    df = spark.createDataFrame(data, "part int, session_id long, m int, question string").withColumn("question_at", F.expr(at))
    for i in range(5):
        df.filter(F.col("part") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with settings(spark, jobs.KEYED_STATE):
        query = jobs.write_batches(jobs.stream_sessions(stream, idle="30 minutes", delay="10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
        query.awaitTermination()
    got = {r["session_id"]: (r["title"], r["turns"], r["last_message_at"].hour * 60 + r["last_message_at"].minute)
           for r in jobs.latest(spark, str(tmp_path / "out"), ["session_id"]).collect()}
    # session 1 came back after its state had gone; the turn of session 2 behind the watermark was dropped
    assert got == {1: ("again", 1, 690), 2: (None, 1, 3), 3: ("d", 1, 60), 4: ("e", 1, 300), 5: ("f", 1, 700), 6: ("g", 1, 900)}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1] < max(states) and states[-1] <= 2 * 2


def test_micro_batches_leave_nothing_staged(spark, tmp_path):
    from lexmill.session import shared_dir, staged, swept

    kept = staged(spark.range(3), "kept")
    with swept(spark):
        one = staged(spark.range(5), "gone")
        assert one.count() == 5
        with swept(spark):
            two = staged(spark.range(7), "inner")
        with pytest.raises(Exception):
            two.count()
        assert one.count() == 5
    with pytest.raises(Exception):
        one.count()
    assert kept.count() == 3 and shared_dir(spark)


def test_batches_of_questions_read_a_packed_index(spark, tmp_path):
    from lexmill.operators import retrieval
    from lexmill.plans import search_queries as Q

    index = Q.vectors(spark, SF)
    asked = Q.asked(index).filter("query_id < 30")
    packed = retrieval.pack_index(index)
    for mode in ("general", "document", "hybrid"):
        want = rows(retrieval.search(asked, index, mode), "query_id", "source_type", "vec_id", "rank")
        assert rows(retrieval.search(asked, packed, mode), "query_id", "source_type", "vec_id", "rank") == want


def test_late_turns_within_the_delay_equal_the_batch_form(spark, tmp_path):
    from lexmill.plans.stream_queries import settings

    at = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m, 0)"
    data = [(0, 1, 0, 0, "a"), (0, 1, 2, 8, "c"), (0, 2, 0, 1, None), (1, 1, 1, 4, "b"), (1, 2, 1, 9, ""), (1, 3, 0, 9, "x"), (2, 1, 3, 30, "d"), (2, 3, 1, 31, "y"),
            (3, 1, 4, 29, None), (3, 3, 2, 45, "z"), (4, 1, 5, 46, "e")]
    df = spark.createDataFrame(data, "part int, session_id long, turn long, m int, question string").withColumn("question_at", F.expr(at))
    flush = df.limit(1).select(F.lit(5).alias("part"), F.lit(9).cast("long").alias("session_id"), F.lit(0).cast("long").alias("turn"), F.lit(900).alias("m"),
                               F.lit("end").alias("question"), F.expr("timestamp'2024-01-01 15:00:00'").alias("question_at"))
    for i in range(5):
        df.filter(F.col("part") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flush.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with settings(spark, jobs.KEYED_STATE):
        jobs.write_batches(jobs.stream_context_in_order(stream, delay="20 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")).filter("session_id < 9"), "session_id", "turn", "search_text")
    in_time = df.select("session_id", F.struct("question_at", "turn").alias("at"), "turn", "question")
    want = sessions.expand_questions(in_time, F.lit(0), at="at", tie="turn")
    assert got == rows(want, "session_id", "turn", "search_text")


def split_tables(spark, tmp_path, *names):
    """The smallest tables, those named as folders of several files."""
    import os

    sf = tmp_path / "sf"
    sf.mkdir()
    for file in os.listdir(SF):
        name = file.removesuffix(".parquet")
        if name in names:
            spark.read.parquet(f"{SF}/{file}").repartition(3).write.parquet(str(sf / file))
        else:
            os.symlink(f"{SF}/{file}", sf / file)
    return str(sf)


@pytest.mark.parametrize("name", ["stream_index", "stream_context", "stream_sessions", "stream_retrieve", "stream_upsert", "stream_log_window"])
def test_tables_in_folders_are_streamed(spark, tmp_path, name):
    from lexmill.plans.catalog import QUERIES

    sf = split_tables(spark, tmp_path, "documents", "conversations", "embeddings", "events")
    got, want = QUERIES[name](spark, sf), QUERIES[name](spark, SF)
    assert want.count() > 0 and rows(got, *got.columns) == rows(want, *want.columns)


@pytest.mark.parametrize("name", ["stream_index", "stream_context", "stream_sessions"])
def test_streams_of_empty_tables(spark, tmp_path, name):
    from lexmill.plans.catalog import QUERIES

    for table_name in ("documents", "conversations"):
        spark.read.parquet(f"{SF}/{table_name}.parquet").limit(0).write.parquet(str(tmp_path / f"{table_name}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_first_document_is_indexed_by_the_stream(spark, tmp_path):
    from lexmill.plans.catalog import QUERIES

    spark.createDataFrame([(0, "The first text of the table, long enough."), (1, "The second text of it, long enough.")], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    assert QUERIES["stream_index"](spark, str(tmp_path)).count() == 2
