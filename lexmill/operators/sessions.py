"""Sessions, messages, documents and logs: listings, existence checks, cascades, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.text import chat_title, strip
from .positions import positions
from .windows import lag_by_blocks, most_recent

READY_STATES = ("READY", "EMBEDDED")


def recent_turns(messages: DataFrame, n: int = K.HISTORY_TURNS, session="session_id", at="question_at",
                 tie="message_id") -> DataFrame:
    return most_recent(messages, [session], [F.desc(at), F.desc(tie)], n)


def expand_questions(messages: DataFrame, block: Column, session="session_id", at="question_at",
                     tie="message_id") -> DataFrame:
    """Put the previous question of the session before each question (``search_text``)."""
    rows = lag_by_blocks(messages, [session], [at, tie], block, "question", "last_question")
    return rows.withColumn("search_text", F.concat_ws(" ", F.nullif("last_question", F.lit("")), "question"))


def context_mode(sessions: DataFrame, documents: DataFrame, states=READY_STATES) -> DataFrame:
    """``hybrid`` for sessions with a usable document, else ``general``."""
    ready = documents.filter(F.col("status").isin(*states)).select("session_id").distinct()
    return (
        sessions.join(ready.withColumn("_ready", F.lit(True)), "session_id", "left")
        .withColumn("context_mode", F.when(F.col("_ready"), "hybrid").otherwise("general")).drop("_ready")
    )


def session_counts(documents: DataFrame, messages: DataFrame) -> DataFrame:
    docs = documents.groupBy("session_id").agg(F.count("*").alias("document_count"))
    msgs = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    zero = F.lit(0).cast("long")
    return docs.join(msgs, "session_id", "full_outer").select(
        "session_id", F.coalesce("document_count", zero).alias("document_count"),
        F.coalesce("message_count", zero).alias("message_count"),
    )


def orphan_sessions(sessions: DataFrame, documents: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with neither a document nor a message. Member ids are made distinct before the joins."""
    ids = lambda df: df.select("session_id").distinct()
    return sessions.join(ids(documents), "session_id", "left_anti").join(
        ids(messages), "session_id", "left_anti"
    )


def cascade_delete(deleted: DataFrame, children: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Remaining rows of each child table after its parents' rows are gone.

    ``children`` maps a name to (table, parent name, parent key column); the root is ``""`` with the
    deleted keys. Tables are given parents first; a parent passes its deleted ids on.
    """
    gone = {"": deleted}
    kept = {}
    for name, (table, parent, fk, pk) in children.items():
        dead = gone[parent]
        dead = dead.select(F.col(dead.columns[0]).alias(fk))
        kept[name] = table.join(dead, fk, "left_anti")
        if pk:
            gone[name] = table.join(dead, fk, "left_semi").select(pk)
    return kept


def session_rollup(messages: DataFrame, session="session_id", text="question", at="question_at") -> DataFrame:
    """Title from the first message, last activity and turn count per session."""
    return messages.groupBy(session).agg(
        F.min_by(chat_title(text), at).alias("title"), F.max(at).alias("last_message_at"),
        F.count("*").alias("turns"),
    )


def nonblank(messages: DataFrame, text="text") -> DataFrame:
    return messages.filter(strip(F.coalesce(F.col(text), F.lit(""))) != "")


def timeline(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """Messages and documents of a session as one tagged list; ``position`` (from 1) is a row's place by time in its session."""
    msg = messages.select(
        "session_id", F.lit("message").alias("type"), F.col("question_at").alias("created_at"),
        F.struct("message_id", "question", "answer").alias("message"),
    )
    doc = documents.select(
        "session_id", F.lit("document").alias("type"), "created_at",
        F.struct("document_id", "file_name", "status").alias("document"),
    )
    both = msg.unionByName(doc, allowMissingColumns=True)
    order = [F.asc("created_at"), F.desc("type"), F.asc("message.message_id"), F.asc("document.document_id")]
    return positions(both, order, by=("session_id",)).withColumn("position", F.col("position") + 1)


def info_logs(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("level") == "INFO")


def document_errors(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("level").isin("WARN", "ERROR") & F.col("endpoint").ilike("%document%"))


def category_gate(documents: DataFrame) -> DataFrame:
    """Admit legal categories; structured ones get article detection."""
    admitted = K.STRUCTURED_CATEGORIES + K.UNSTRUCTURED_CATEGORIES
    return documents.filter(F.col("category").isin(*admitted)).withColumn(
        "detect", F.col("category").isin(*K.STRUCTURED_CATEGORIES)
    )
