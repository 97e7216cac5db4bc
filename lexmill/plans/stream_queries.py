"""Streams over the driver tables, run to the end of what is there and read back."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..session import shared_dir
from ..functions.chunking import ChunkConfig
from ..sources import files
from ..streaming import jobs as J
from .base import register, sql_strip, table
from .chunk_queries import sql_chunks
from .fixtures import ENDPOINT, LEVEL, LOGS, TURNS
from .index_queries import EMB
from . import search_queries as Q

CFG = ChunkConfig(500, 50, 20)
START = 1_704_067_200


def stream_table(spark, sf, name):
    """A driver table as a stream, whether it is one file or a folder of them: only a pattern may name a single file."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@contextmanager
def settings(spark, values):
    """Session settings for the streams started inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def places(spark):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def user_turns(spark, sf):
    rows = stream_table(spark, sf, "conversations").filter("role = 'user'")
    return rows.select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("question"))


def stream_logs(spark, sf):
    rows = stream_table(spark, sf, "events")
    return rows.select(F.expr(LEVEL).alias("level"), F.expr(ENDPOINT).alias("endpoint"),
                       F.col("ts").cast("timestamp").alias("created_at"))


DISTINCT = f"""select doc_id, text from (select *, row_number() over (partition by {sql_strip('text')} order by doc_id) as rn from documents
    where length({sql_strip('text')}) >= 20) as d where rn = 1"""


@register("stream_index", "text_hash str, chunk_index long, text str", f"""
    select md5({sql_strip('d.text')}) as text_hash, chunk_index, ctext as text
    from ({sql_chunks(DISTINCT, 'doc_id', 'text', CFG, False)}) as c join documents as d on d.doc_id = c.doc_id""")
def stream_index(spark, sf):
    """Event time is the document's number in seconds from 2024 on (a time of 1970 or before is late from the start);
    a text's hash leaves the state a day after it was met."""
    out, checkpoint = places(spark)
    docs = stream_table(spark, sf, "documents").withColumn("at", F.timestamp_seconds(F.lit(START) + F.col("doc_id")))
    chunks = J.stream_index(docs, CFG, detect=False, event_time="at", delay="1 day")
    J.append_files(chunks, out, checkpoint).awaitTermination()
    return files.read_written(spark, out, chunks.schema)


@register("stream_context", "session_id long, turn long, search_text str", f"""
    select session_id, turn, case when coalesce(p, '') = '' then question else concat(p, ' ', question) end as search_text
    from (select *, lag(question) over (partition by session_id order by turn) as p from ({TURNS}) as t) as l""")
def stream_context(spark, sf):
    out, checkpoint = places(spark)
    followed = J.stream_context(user_turns(spark, sf))
    J.write_batches(followed, out, checkpoint).awaitTermination()
    return files.read_written(spark, out, followed.schema)


@register("stream_sessions", "session_id long, title str, last_turn long, turns long", f"""
    select session_id, substr({sql_strip('arg_min(question, turn)')}, 1, 20) as title, max(turn) as last_turn, count(*) as turns
    from ({TURNS}) as t group by session_id""")
def stream_sessions(spark, sf):
    """Event time is the turn in minutes; a session without a turn for a day leaves the state."""
    out, checkpoint = places(spark)
    zero = F.expr("timestamp '2024-01-01 00:00:00'")
    rows = user_turns(spark, sf).withColumn("question_at", F.timestamp_add("MINUTE", F.col("turn").cast("int"), zero))
    with settings(spark, J.KEYED_STATE):
        running = J.stream_sessions(rows, idle="1 day")
        J.write_batches(running, out, checkpoint, "update").awaitTermination()
    newest = J.latest(spark, out, ["session_id"], running.schema)
    minutes = F.timestamp_diff("MINUTE", zero, F.col("last_message_at"))
    return newest.select("session_id", "title", minutes.alias("last_turn"), "turns")


@register("stream_log_window", "start ts, level str, n long", f"""
    select date_trunc('hour', created_at) as start, level, count(*) as n from ({LOGS}) as l
    where level in ('WARN', 'ERROR') and endpoint ilike '%document%' group by 1, 2""")
def stream_log_window(spark, sf):
    out, checkpoint = places(spark)
    counts = J.stream_log_errors(stream_logs(spark, sf))
    J.write_batches(counts, out, checkpoint, "update").awaitTermination()
    return J.latest(spark, out, ["start", "level"], counts.schema)


@register("stream_upsert", "vec_id long, label long", f"""
    select vec_id, case when label = 3 then label + 100 else label end as label from ({EMB}) as e""")
def stream_upsert(spark, sf):
    out, checkpoint = places(spark)
    rows = lambda df: df.select("vec_id", F.col("label").cast("long").alias("label"), F.lit("public").alias("namespace"))
    files.write_vectors(rows(table(spark, sf, "embeddings")), out)
    changed = rows(stream_table(spark, sf, "embeddings").filter("label = 3"))
    twice = changed.withColumn("version", F.explode(F.array(F.lit(100), F.lit(50)))).withColumn("label", F.col("label") + F.col("version"))
    J.upsert_batches(twice, out, checkpoint, order="version").awaitTermination()
    return files.read_vectors(spark, out)


@register("stream_retrieve", Q.HIT_COLUMNS + ", is_legal bool", f"""
    select h.*, max(score) over (partition by query_id) >= 0.6 as is_legal from ({Q.HYBRID}) as h""")
def stream_retrieve(spark, sf):
    out, checkpoint = places(spark)
    index = Q.vectors(spark, sf)
    side = index.select("vec_id", "idx", "val")
    asked = stream_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("dense"))

    def answer(batch):
        questions = batch.join(side, "vec_id", "left").select(
            F.col("vec_id").alias("query_id"), (F.col("vec_id") % 5 + 5).alias("user_id"), "dense", "idx", "val")
        return J.answer_batch(index)(questions)

    J.write_batches(asked, out, checkpoint, transform=answer).awaitTermination()
    return files.read_written(spark, out, "query_id bigint, source_type string, vec_id bigint, score double, rank int, is_legal boolean")
