"""Continuous forms of the batch operators.

Transformations take and give streaming DataFrames. Sinks write each micro-batch under its own
``batch_id`` folder in overwrite mode, so a repeated batch replaces itself; ``latest`` reads the
newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import constants as K
from ..functions.chunking import ChunkConfig, chunk_array
from ..functions.text import chat_title, has_min_text, text_hash
from ..operators import retrieval
from ..operators.rows import explode_positions
from ..session import cut, swept
from ..sources import files
from ..operators.sessions import document_errors, session_rollup


def stream_index(docs: DataFrame, cfg: ChunkConfig = ChunkConfig(), detect: bool = True, text: str = "text",
                 event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Filter, drop repeated texts, chunk. With an event time the hash state is bounded by the delay."""
    fresh = docs.filter(has_min_text(text)).withColumn("text_hash", text_hash(text))
    if event_time:
        fresh = fresh.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["text_hash"])
    else:
        fresh = fresh.dropDuplicates(["text_hash"])
    rows = explode_positions(fresh, ["text_hash"], chunk_array(F.col(text), cfg, detect), "chunk_index", "c")
    return rows.select("text_hash", "chunk_index", F.col("c.text").alias("text"), F.col("c.article").alias("article"))


def stream_context(turns: DataFrame, keep: str | None = None) -> DataFrame:
    """``session_id, turn, search_text``: each question after the session's previous one.

    The state holds one question per session; ``keep`` drops it after that long without a turn. A
    timed state asks for a batch again and again, so it suits a running trigger, not ``availableNow``.
    Turns of one session that arrive in the same micro-batch are put in order first; a turn that
    arrives after a later one follows the question that arrived last. A missing question counts as
    empty, as in the batch form.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("turn")
        last = state.get[0] if state.exists else None
        previous = [last, *rows["question"].iloc[:-1]]
        given = lambda t: t is not None and t == t
        rows["search_text"] = [
            " ".join(x for x in (p if given(p) and p else None, t) if given(x)) for p, t in zip(previous, rows["question"])
        ]
        final = rows["question"].iloc[-1]
        state.update((final if given(final) else None,))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        yield rows[["session_id", "turn", "search_text"]]

    return turns.select("session_id", "turn", "question").groupBy("session_id").applyInPandasWithState(
        follow, "session_id bigint, turn bigint, search_text string", "question string", "append",
        "ProcessingTimeTimeout" if keep_ms else "NoTimeout",
    )


def stream_context_in_order(turns: DataFrame, at: str = "question_at", delay: str = "10 minutes") -> DataFrame:
    """``session_id, turn, search_text`` as in ``stream_context``, for turns that arrive out of order (append mode).

    A turn waits in RocksDB state (see ``KEYED_STATE``) until the watermark, ``delay`` behind the newest turn, reaches its time; a
    timer then lets it and those before it go in order of time and turn. So turns late by up to the delay give what the
    batch form gives, and later ones are dropped. A session holds the turns of one delay and its last question.
    """
    rows = turns.select("session_id", F.col(at).cast("timestamp").alias("at"), "turn", "question")
    return rows.withWatermark("at", delay).groupBy("session_id").transformWithStateInPandas(
        TurnOrder(), "session_id bigint, turn bigint, search_text string", "Append", "EventTime")


class TurnOrder(StatefulProcessor):
    """Pending turns of a session, let go by timers at their own times."""

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ms bigint, turn bigint, question string")
        self.last = handle.getValueState("last", "question string")

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for part in rows:
            for at, turn, question in zip(part["at"], part["turn"], part["question"]):
                new.append((int(at.value // 1_000_000), int(turn), None if pd.isna(question) else question))
        self.pending.appendList(new)
        for ms in sorted({x[0] for x in new}):
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(self.pending.get(), key=lambda x: x[:2])
        due, rest = [x for x in waiting if x[0] <= upto], [x for x in waiting if x[0] > upto]
        if not due:  # gone with an earlier timer
            return
        self.pending.clear()
        if rest:
            self.pending.put(rest)
        last = self.last.get()[0] if self.last.exists() else None
        texts = []
        for _, _, question in due:
            texts.append(" ".join(x for x in (last or None, question) if x is not None))
            last = question
        self.last.update((last,))
        yield pd.DataFrame({"session_id": [key[0]] * len(due), "turn": [x[1] for x in due], "search_text": texts})

    def close(self) -> None:
        pass


def stream_sessions(turns: DataFrame, at: str = "question_at", idle: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Running title, last activity and turn count per session (update mode).

    With ``idle`` a session's state goes when the watermark (``delay`` behind the newest turn) passes its last turn
    by that long, and turns later than the delay are dropped; a turn after that starts the session anew. That form keeps its
    state in RocksDB (see ``KEYED_STATE``) and asks for a timestamp in ``at``. Without it the state stays.
    """
    if idle is None:
        return session_rollup(turns, at=at)
    rows = turns.select("session_id", F.col(at).cast("timestamp").alias("at"), chat_title("question").alias("title"))
    return rows.withWatermark("at", delay).groupBy("session_id").transformWithStateInPandas(
        SessionState(int(pd.Timedelta(idle).total_seconds() * 1000)),
        "session_id bigint, title string, last_message_at timestamp, turns bigint", "Update", "EventTime")


#: Session settings of forms with timers.
KEYED_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class SessionState(StatefulProcessor):
    """One row per session; a timer at its last turn plus the idle time takes it away."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "first_ms bigint, title string, last_ms bigint, turns bigint")

    def handleInputRows(self, key, rows, timerValues):
        first, title, last, turns = self.session.get() if self.session.exists() else (None, None, None, 0)
        for part in rows:
            for at, name in zip(part["at"], part["title"]):
                ms, turns = int(at.value // 1_000_000), turns + 1
                if first is None or ms < first:
                    first, title = ms, None if pd.isna(name) else name
                if last is None or ms > last:
                    if last is not None:
                        self.handle.deleteTimer(last + self.idle_ms)
                    last = ms
                    self.handle.registerTimer(last + self.idle_ms)
        self.session.update((first, title, last, turns))
        yield pd.DataFrame({"session_id": [key[0]], "title": [title], "last_message_at": [pd.Timestamp(last, unit="ms")], "turns": [turns]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.session.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_log_errors(logs: DataFrame, width: str = "1 hour", slide: str | None = None,
                      delay: str = "10 minutes") -> DataFrame:
    """Windowed counts of document errors; rows later than the delay are dropped."""
    span = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    counts = document_errors(logs).withWatermark("created_at", delay).groupBy(span.alias("w"), "level")
    return counts.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "level", "n")


def stream_error_sessions(logs: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Bursts of document errors per level, closed by a gap without one."""
    bursts = document_errors(logs).withWatermark("created_at", delay).groupBy(
        F.session_window("created_at", gap).alias("w"), "level"
    )
    return bursts.agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "level", "n"
    )


def answer_batch(vectors: DataFrame, mode: str = "hybrid", k: int = K.TOP_K) -> Callable[[DataFrame], DataFrame]:
    """Retrieval and gate of one micro-batch of questions against a static index, which is packed once for all of them.

    A micro-batch reads the index's summaries and the blocks whose bounds can reach one of its questions.
    """
    vectors = retrieval.pack_index(vectors)

    def run(questions: DataFrame) -> DataFrame:
        hits = cut(retrieval.search(questions, vectors, mode, k))
        gate = retrieval.legal_gate(questions, hits).select("query_id", "is_legal")
        return hits.join(gate, "query_id")

    return run


def write_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  transform: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Start the stream; every micro-batch lands in ``path/batch_id=N`` and replaces itself on a retry.

    What ``transform`` stages on the way is deleted when the micro-batch is written.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        with swept(batch.sparkSession):
            out = transform(batch) if transform else batch
            out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()
    )


def upsert_batches(df: DataFrame, path: str, checkpoint: str, key: str = "vec_id", order: str | None = None, **trigger) -> StreamingQuery:
    """Insert or replace every micro-batch's rows in a vector table, which the first batch makes; a repeated batch changes nothing."""

    def save(batch: DataFrame, batch_id: int) -> None:
        files.upsert_vectors(batch.sparkSession, path, batch, key, order, (checkpoint, batch_id))

    return (
        df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()
    )


def append_files(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to Parquet with the file sink's exactly-once log."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def latest(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Newest version of each key, reduced before the shuffle; with a ``schema``, none where no micro-batch was written."""
    batches = schema and T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])
    rows = files.read_written(spark, path, batches) if batches else spark.read.parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "batch_id"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return newest.select(*keys, "_v.*")
