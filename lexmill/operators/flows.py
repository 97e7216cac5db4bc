"""Compositions of the operators: describe documents, index them, prepare prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.chunking import ChunkConfig, chunk_array, sample_array, sample_text
from ..functions.citations import law_mode
from ..functions.text import choose_summary, has_min_text, parse_analysis, revised_date, strip
from ..functions.vectors import namespace_of_user
from ..session import cut, discard, staged
from . import embed as E, index, prompts, retrieval, sessions
from .search import is_packed
from .windows import look_back


def analysis_input(docs: DataFrame, cfg: ChunkConfig = ChunkConfig(), detect: bool = True) -> DataFrame:
    """``doc_id, sample``: the chunks of a document that stand for it in an analysis prompt."""
    numbered = F.transform(
        chunk_array(F.col("text"), cfg, detect), lambda c, i: F.struct(i.alias("chunk_index"), c["text"].alias("text"))
    )
    picked = docs.select("doc_id", sample_array(numbered).alias("_s"))
    return picked.select("doc_id", sample_text(F.col("_s")).alias("sample"))


def document_meta(docs: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Category, law, date and summary of documents whose model replies are columns.

    ``docs``: doc_id, text, preview_reply (reply to the opening), analysis_reply (reply to the sample).
    The first reply decides the category; a document outside the legal categories, without text or
    without chunks carries an ``error`` and nothing else.
    """
    first_category, first_summary = parse_analysis("preview_reply")
    _, second_summary = parse_analysis("analysis_reply")
    read = docs.withColumn("category", first_category).withColumn("_first", first_summary).withColumn(
        "_second", second_summary)
    detect = F.col("category").isin(*K.STRUCTURED_CATEGORIES)
    legal = detect | F.col("category").isin(*K.UNSTRUCTURED_CATEGORIES)
    chunks = F.when(detect, F.size(chunk_array(F.col("text"), cfg, True))).otherwise(
        F.size(chunk_array(F.col("text"), cfg, False)))
    error = (
        F.when(strip(F.coalesce("text", F.lit(""))) == "", "no_text").when(~legal, "not_legal")
        .when(chunks == 0, "no_chunks")
    )
    checked = read.withColumn("error", error)
    fine = F.col("error").isNull()
    return checked.select(
        "doc_id", F.when(F.col("error") == "no_text", K.DEFAULT_CATEGORY).otherwise(F.col("category")).alias("category"),
        F.when(fine, revised_date("text")).alias("law_date"),
        F.when(fine & detect, law_mode(F.col("text"))).otherwise("").alias("law_name"),
        F.when(fine, choose_summary("_second", "_first")).otherwise("").alias("summary"), "error",
    )


def index_documents(docs: DataFrame, now: Column, load: Callable | None = None, cfg: ChunkConfig = ChunkConfig(),
                    detect: bool = True, public: bool = False, keep_text: bool = False) -> DataFrame:
    """Documents (doc_id, user_id, text, category, law_date) to index records, one plan from text to vector."""
    usable = docs.filter(has_min_text("text"))
    space = F.lit(K.PUBLIC_NAMESPACE) if public else namespace_of_user(F.col("user_id"))
    kept = ("doc_id", "category", "law_date", "namespace")
    chunks = index.chunk_documents(usable.withColumn("namespace", space), cfg, detect, keep=kept)
    records = index.build_vectors(E.embed(chunks, load=load), now)
    return records if keep_text else records.drop("text")


def prepare_prompts(questions: DataFrame, messages: DataFrame, documents: DataFrame, vectors: DataFrame,
                    evidence: Callable[[DataFrame], DataFrame], system: str, block: Column,
                    load: Callable | None = None, k: int = K.TOP_K) -> tuple[DataFrame, DataFrame]:
    """Questions to (messages for those that pass the gate, gate of all).

    ``questions``: query_id (the message id), session_id, user_id. ``messages``: session_id, message_id, turn,
    question, answer. Each question is searched with the session's previous one before it, in its own
    documents too where the session has a usable one; ``evidence`` adds article, law_name, category and
    text to hits. Only messages of the sessions asked in are looked at.
    """
    messages = messages.join(questions.select("session_id").distinct(), "session_id", "left_semi")
    asked = (
        sessions.expand_questions(messages, block, at="turn")
        .join(questions.select(F.col("query_id").alias("message_id"), "user_id"), "message_id")
    )
    ready = sessions.context_mode(asked, documents).withColumnRenamed("message_id", "query_id")
    embedded = cut(E.embed(
        ready.select("query_id", "session_id", "turn", "user_id", "question", "context_mode", "search_text"), "search_text", load))
    parts = [
        retrieval.search(embedded.filter(F.col("context_mode") == mode), vectors, mode, k) for mode in ("general", "hybrid")
    ]
    hits = cut(parts[0].unionByName(parts[1]))
    gate = retrieval.legal_gate(embedded, hits)
    legal = embedded.join(gate.filter("is_legal").select("query_id"), "query_id", "left_semi")
    best = evidence(retrieval.prompt_hits(hits))
    references = prompts.reference_block(legal, best)
    history = history_before(legal, messages, block)
    return prompts.prompt_messages(legal.select("query_id", "question"), references, history, system), gate


def legal_files(files: DataFrame, vectors: DataFrame, load: Callable | None = None) -> DataFrame:
    """``(query_id, best_score, is_legal)`` of every file: its whole text is embedded and searched in general mode.

    ``files``: query_id, text. Without a hit a file does not pass.
    """
    embedded = cut(E.embed(files.select("query_id", "text"), load=load).drop("text"))
    ids = cut(embedded.select("query_id"))
    stored = vectors if is_packed(vectors) else staged(vectors, "embedded")
    hits = retrieval.search(embedded, stored, "general", K.GATE_PROBE_K, stage=False)
    discard(embedded, *(() if is_packed(vectors) else (stored,)))  # the search reads its blocks from here on
    return retrieval.legal_gate(ids, hits)


def history_before(questions: DataFrame, messages: DataFrame, block: Column, n: int = K.HISTORY_TURNS) -> DataFrame:
    """``query_id, recency, question, answer``: the newest ``n`` turns before each question.

    Every message carries its look-back as a short array, so questions meet it on their unique id
    and no session is joined with itself.
    """
    turns = messages.select(
        F.col("message_id").alias("query_id"), "session_id", "turn", "question",
        F.coalesce("answer", F.lit("")).alias("answer"), block.alias("_at"),
    )
    past = look_back(turns, ["session_id"], "turn", F.col("_at"), ["question", "answer"], n, "_past")
    wanted = past.join(questions.select("query_id"), "query_id", "left_semi")
    newest_first = wanted.select("query_id", F.sort_array("_past", asc=False).alias("_past"))
    rows = newest_first.select("query_id", F.posexplode("_past").alias("_i", "t"))
    return rows.select("query_id", (F.col("_i") + 1).alias("recency"), "t.question", "t.answer")
