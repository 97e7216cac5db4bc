"""Questions to evidence: namespaced search, late text lookup, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as K
from ..functions.text import blank_to_null, excerpt, to_uuid
from ..functions.vectors import namespace_of_user, round4
from ..session import cut
from .search import is_packed, pack, top_k

PUBLIC_SOURCE, USER_SOURCE = "legal_vector", "document"


def _targets(questions: DataFrame, public: bool, private: bool) -> DataFrame:
    keys = []
    if public:
        keys.append(F.lit(K.PUBLIC_NAMESPACE))
    if private:
        keys.append(namespace_of_user(F.col("user_id")))
    return questions.withColumn("key", F.explode(F.array(*keys)))


def pack_index(vectors: DataFrame) -> DataFrame:
    """An index of vectors (with ``namespace``) packed once for many searches; give it to them in place of the vectors."""
    return pack(vectors.withColumnRenamed("namespace", "key"))


def _hits(questions, vectors, k, alpha, public, private, stage) -> DataFrame:
    stored = vectors if is_packed(vectors) else vectors.withColumnRenamed("namespace", "key")
    found = top_k(_targets(questions, public, private), stored, k, alpha, stage=stage)
    source = F.when(F.col("key") == K.PUBLIC_NAMESPACE, PUBLIC_SOURCE).otherwise(USER_SOURCE)
    return found.select("query_id", source.alias("source_type"), "vec_id", "score", "rank")


def search(questions: DataFrame, vectors: DataFrame, mode: str = "general", k: int = K.TOP_K,
           alpha: float = K.ALPHA, stage: bool = True) -> DataFrame:
    """Ranked hits ``(query_id, source_type, vec_id, score, rank)``.

    ``general`` looks in the public namespace, ``document`` in the asker's own, ``hybrid`` in both:
    60 % of the places for own documents, the rest public, gaps filled by the best leftovers. ``stage=False``: both tables are
    cheap to read again (stored or staged), so nothing is written before they are packed.
    """
    if mode == "general":
        return _hits(questions, vectors, k, alpha, True, False, stage)
    if mode == "document":
        return _hits(questions, vectors, k, alpha, False, True, stage)
    if mode != "hybrid":
        raise ValueError(f"unknown search mode: {mode}")
    own = max(1, round(k * K.DOCUMENT_SHARE))
    hits = _hits(questions, vectors, k, alpha, True, True, stage)
    quota = F.when(F.col("source_type") == USER_SOURCE, own).otherwise(k - own)
    pick = Window.partitionBy("query_id").orderBy(
        (F.col("rank") <= quota).desc(), F.desc("score"), "source_type", "vec_id"
    )
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_type", "vec_id")
    return (
        hits.withColumn("_pick", F.row_number().over(pick)).filter(F.col("_pick") <= k)
        .withColumn("rank", F.row_number().over(final)).drop("_pick")
    )


def attach_text(hits: DataFrame, public_chunks: DataFrame, user_chunks: DataFrame) -> DataFrame:
    """Add ``text`` to hits carrying ``vector_id`` and optional ``meta_text`` / ``source_text`` / ``qa_text``.

    The chunk tables ``(vector_id, chunk_text)`` are first reduced to the ids that were hit; at run
    time the small id side is broadcast, so the chunk tables are not shuffled.
    """
    keys = ["source_type", "_vid"]
    hits = cut(hits.withColumn("_vid", to_uuid("vector_id")))  # read twice below, searched once
    tagged = lambda df, tag: df.select(
        F.lit(tag).alias("source_type"), to_uuid("vector_id").alias("_vid"), "chunk_text"
    )
    wanted = hits.select(*keys).filter(F.col("_vid").isNotNull()).distinct()
    texts = (
        tagged(public_chunks, PUBLIC_SOURCE).unionByName(tagged(user_chunks, USER_SOURCE))
        .join(wanted, keys, "left_semi")
    )
    fallback = [blank_to_null(F.col(c)) for c in ("meta_text", "source_text", "qa_text") if c in hits.columns]
    return (
        hits.join(texts, keys, "left")
        .withColumn("text", F.coalesce(blank_to_null("chunk_text"), *fallback))
        .drop("_vid", "chunk_text")
    )


def legal_gate(questions: DataFrame, hits: DataFrame, threshold: float = K.GATE_THRESHOLD) -> DataFrame:
    """``(query_id, best_score, is_legal)``; a question without a hit does not pass."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best_score"))
    return (
        questions.select("query_id").join(best, "query_id", "left")
        .withColumn("is_legal", F.coalesce(F.col("best_score") >= threshold, F.lit(False)))
    )


def prompt_hits(hits: DataFrame, n: int = K.PROMPT_K) -> DataFrame:
    return hits.filter(F.col("rank") <= n)


def sources(hits: DataFrame) -> DataFrame:
    """What a reader is shown per hit: title, article, excerpt and rounded score."""
    text = F.coalesce(blank_to_null("text"), F.lit(""))
    title = F.when(
        F.col("source_type") == USER_SOURCE, F.coalesce("filename", F.lit(K.UPLOAD_TITLE))
    ).otherwise(F.coalesce(blank_to_null("doc_title"), F.col("category"), F.lit(K.PUBLIC_TITLE)))
    return hits.select(
        "query_id", "rank", title.alias("title"), "category", "article", "law_date",
        excerpt(text).alias("excerpt"), text.alias("text"), round4(F.col("score")).alias("score"),
    )
