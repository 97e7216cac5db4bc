"""Keep an index: filter, de-duplicate, chunk, build records, upsert, delete, synchronise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.chunking import ChunkConfig, chunk_array, split_sentences
from ..functions.citations import law_mode, with_law
from ..functions.text import article_key, blank_to_null, is_indexable, parse_law_date, text_hash, to_uuid
from .rows import explode_positions
from .search import top_k
from .windows import keep_first


def chunk_documents(df: DataFrame, cfg: ChunkConfig = ChunkConfig(), detect: bool = True,
                    text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                    splitter: Callable[[Column], Column] = split_sentences) -> DataFrame:
    """One row per chunk: ``keep`` columns, chunk_index, text, law_name, article, char_count.

    Everything happens in the row that holds the document; the plan has no exchange. ``splitter``
    maps a section to its array of sentences.
    """
    detect = detect and cfg.use_law_structure
    law = law_mode(F.col(text)) if detect else F.lit("")
    wide = df.select(*keep, law.alias("law_name"), chunk_array(F.col(text), cfg, detect, splitter).alias("_chunks"))
    rows = explode_positions(wide, [*keep, "law_name"], F.col("_chunks"), "chunk_index", "_c")
    return rows.select(
        *keep, "chunk_index", F.col("_c.text").alias("text"), "law_name",
        with_law(F.col("law_name"), F.col("_c.article")).alias("article"),
        F.length("_c.text").alias("char_count"),
    )


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Report progress of a run: row count and further aggregates reach observers and stream listeners."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])


def chunk_stats(df: DataFrame, cfg: ChunkConfig = ChunkConfig(), detect: bool = True,
                text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Count, sum, mean, least and greatest chunk length per document; zeros without chunks."""
    sizes = F.transform(chunk_array(F.col(text), cfg, detect), lambda c: F.length(c["text"]))
    n, total = F.size("_s"), F.aggregate("_s", F.lit(0).cast("long"), lambda a, x: a + x)
    per_doc = df.select(*keep, sizes.alias("_s")).select(*keep, "_s", total.alias("total_chars"))
    return per_doc.select(
        *keep, n.alias("total_chunks"), "total_chars",
        F.when(n > 0, F.col("total_chars") / n).otherwise(0.0).alias("avg_chars"),
        F.coalesce(F.array_min("_s"), F.lit(0)).alias("min_chars"),
        F.coalesce(F.array_max("_s"), F.lit(0)).alias("max_chars"),
    )


def dedup_exact(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    return keep_first(df, text_hash(text), order)


def skip_reasons(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """Tag each record ``kept``, ``no_article``, ``short_text`` or ``duplicate``."""
    usable = is_indexable("article", "text")
    first = (
        df.filter(usable).groupBy(text_hash("text").alias("_h")).agg(F.min(order).alias(order))
        .select(order, F.lit(True).alias("_first"))
    )
    reason = (
        F.when(F.coalesce(F.col("article"), F.lit("")) == "", "no_article")
        .when(~usable, "short_text").when(F.col("_first"), "kept").otherwise("duplicate")
    )
    return df.join(first, order, "left").withColumn("reason", reason).drop("_first")


def index_stats(records: DataFrame, cfg: ChunkConfig, malformed: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """``(reason, records, chunks)``: what a run loads and why it skips.

    Texts are hashed and chunked where they lie, once; only numbers and hashes are shuffled.
    """
    usable = is_indexable("article", "text")
    state = (
        F.when(F.coalesce(F.col("article"), F.lit("")) == "", "no_article").when(~usable, "short_text").otherwise("kept")
    )
    narrow = records.select(
        order, state.alias("reason"), F.when(usable, text_hash("text")).alias("_h"),
        F.when(usable, F.size(chunk_array(F.col("text"), cfg, True))).alias("_n"),
    )
    texts = narrow.groupBy("reason", "_h").agg(F.count("*").alias("rows"), F.min_by("_n", order).alias("_n"))
    sums = texts.groupBy("reason").agg(F.sum("rows").alias("rows"), F.count("*").alias("texts"), F.sum("_n").alias("n"))
    line = lambda reason, records, chunks: F.struct(
        reason.alias("reason"), records.cast("long").alias("records"), chunks.cast("long").alias("chunks"))
    lines = F.when(F.col("reason") == "kept", F.array(
        line(F.lit("kept"), F.col("texts"), F.col("n")), line(F.lit("duplicate"), F.col("rows") - F.col("texts"), F.lit(0)),
    )).otherwise(F.array(line(F.col("reason"), F.col("rows"), F.lit(0))))
    stats = sums.select(F.explode(lines).alias("s")).select("s.*").filter("records > 0")
    if malformed is not None:
        bad = malformed.agg(F.count("*").alias("records")).select(
            F.lit("malformed").alias("reason"), "records", F.lit(0).cast("long").alias("chunks")
        )
        stats = stats.unionByName(bad)
    return stats


def chunk_id(*parts) -> Column:
    """Deterministic id: a retried task writes the same row again, not a second one."""
    return to_uuid(F.md5(F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])))


def chunk_rows(chunks: DataFrame, key: tuple[str, str] = ("doc_id", "chunk_index")) -> DataFrame:
    """Rows of the chunk table for an append."""
    return chunks.select(
        chunk_id(*key).alias("vector_id"), *key, F.col("text").alias("chunk_text"),
        F.coalesce("article", F.lit("")).alias("article"),
        (parse_law_date("law_date") if "law_date" in chunks.columns else F.lit(None).cast("timestamp")).alias("law_date"),
    )


def build_vectors(chunks: DataFrame, now: Column, key: tuple[str, str] = ("doc_id", "chunk_index")) -> DataFrame:
    """Index records of embedded chunks (``dense, idx, val`` beside the chunk columns)."""
    given = F.col("given_law_name") if "given_law_name" in chunks.columns else F.lit("")
    return chunks.select(
        chunk_id(*key).alias("id"), "namespace", "dense", "idx", "val",
        F.struct(
            chunk_id(*key).alias("vector_id"), F.col(key[0]).alias("document_id"), key[1],
            record_article(given, F.col("law_name"), F.col("category"), F.col("article")).alias("article"),
            "category", "law_date", now.alias("created_at"), now.alias("updated_at"),
        ).alias("metadata"),
    )


def record_article(given: Column, law: Column, category: Column, article: Column) -> Column:
    """Article of an index record. A chunk's article already opens with the law of its document,
    so the name is put before it once."""
    doubled = F.concat_ws(" ", blank_to_null(law), F.lit(""))
    bare = F.when(
        (F.coalesce(law, F.lit("")) != "") & article.startswith(doubled),
        F.substr(article, F.length(doubled) + 1),
    ).otherwise(article)
    return article_key(given, law, category, bare)


def last_of(updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``, or the last one in the order of the input."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    row = F.struct(*[F.col(f"`{c}`") for c in updates.columns])
    placed = updates.select(*keys, row.alias("_row"), at.alias("_at"))
    return placed.groupBy(*keys).agg(F.max_by("_row", "_at").alias("_row")).select("_row.*")


def upsert(base: DataFrame, updates: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """Insert or replace by key; of several updates with one key the last counts."""
    keys = [key] if isinstance(key, str) else key
    return base.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(
        last_of(updates, keys, order), allowMissingColumns=True
    )


def delete_by_ids(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def delete_by_value(base: DataFrame, column: str, value) -> DataFrame:
    return base.filter(~F.col(column).eqNullSafe(F.lit(value)))


def drop_namespace(base: DataFrame, user) -> DataFrame:
    return delete_by_value(base, "namespace", f"{K.USER_NAMESPACE_PREFIX}{user}")


def update_chunk_text(base: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Replace text by id; the date only where a new one is given. The last of several updates of an id counts."""
    new = last_of(updates, ["vector_id"], order).select(
        "vector_id", F.col("new_text"), blank_to_null("new_law_date").alias("new_law_date"), F.lit(True).alias("_hit")
    )
    return (
        base.join(new, "vector_id", "left")
        .withColumn("chunk_text", F.when(F.col("_hit"), F.col("new_text")).otherwise(F.col("chunk_text")))
        .withColumn("law_date", F.coalesce("new_law_date", "law_date"))
        .drop("new_text", "new_law_date", "_hit")
    )


def update_hits(base: DataFrame, updates: DataFrame) -> DataFrame:
    """``vector_id, existed`` of every id that an update names."""
    known = base.select("vector_id").distinct().withColumn("existed", F.lit(True))
    return updates.select("vector_id").distinct().join(known, "vector_id", "left").select(
        "vector_id", F.coalesce("existed", F.lit(False)).alias("existed")
    )


def sync_newer(user_chunks: DataFrame, public: DataFrame, threshold: float = K.SYNC_THRESHOLD,
               alpha: float = K.ALPHA, stage: bool = True) -> DataFrame:
    """Updates to public records that a newer user chunk of the same article replaces.

    ``user_chunks``: chunk_ord (unique), article_key, law_date, text, dense, idx, val.
    ``public``: vec_id, article, law_date, dense, idx, val. Each chunk proposes its best public match;
    each public record takes its first proposal, reduced before the shuffle. ``stage=False``: both are cheap to read again.
    """
    dated = user_chunks.filter(F.coalesce(F.col("law_date"), F.lit("")) != "")
    best = top_k(
        dated.select(F.col("chunk_ord").alias("query_id"), F.col("article_key").alias("key"), "dense", "idx", "val"),
        public.withColumnRenamed("article", "key"), k=1, alpha=alpha, stage=stage,
    ).filter(F.col("score") >= threshold)
    proposed = (
        best.select(F.col("query_id").alias("chunk_ord"), "vec_id", "score")
        .join(public.select("vec_id", F.col("law_date").alias("public_date")), "vec_id")
        .join(dated.select("chunk_ord", F.col("law_date").alias("new_law_date")), "chunk_ord")
        .filter((F.coalesce(F.col("public_date"), F.lit("")) == "") | (F.col("public_date") < F.col("new_law_date")))
    )
    claims = proposed.groupBy("vec_id").agg(
        F.min_by(F.struct("chunk_ord", "score", "new_law_date", "public_date"), "chunk_ord").alias("c")
    )
    won = claims.select("vec_id", "c.*")
    return won.join(dated.select("chunk_ord", F.col("text").alias("new_text"), "dense", "idx", "val"), "chunk_ord")
