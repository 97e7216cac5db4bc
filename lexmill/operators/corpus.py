"""Corpus build: ordered source text, label join with fallback, citations, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import constants as K
from ..functions.citations import legal_metadata, post_clean
from ..functions.text import (
    clean_text, compose_law_and_article, format_date, is_valid_label, let, strip, transliterate, zfill,
)


def ordered_concat(sentences: DataFrame, keys: tuple[str, ...] = ("docu_type", "rid"),
                   chars: dict = {}, words: dict = {}, wanted: DataFrame | None = None) -> DataFrame:
    """One cleaned text per record from sentences ``seq, file, pos, content``.

    The result is one string cell, so a group is a document that fits in a row. Sentences without a
    usable id would all share one key and never match a label; they are dropped before the shuffle.
    ``wanted``: rows with the keys of the records that are asked for; no other text is cleaned.
    """
    item = F.struct("seq", "file", "pos", "content")
    usable = sentences.filter(F.col("rid").isNotNull() & (F.col("rid") != K.MISSING_ID))
    joined = usable.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_s"))
    raw = joined.select(*keys, F.array_join(F.col("_s.content"), "\n").alias("_raw"))
    if wanted is not None:  # the texts are already spread by these keys
        raw = raw.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    return raw.select(*keys, transliterate(clean_text("_raw"), chars, words).alias("joined_text"))


def join_source(labels: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("docu_type", "rid")) -> DataFrame:
    """Valid labels with their source text; the cleaned label output stands in where none is found.

    Labels without an id match nothing and stay out of the join. The texts are already spread by the join's keys.
    """
    missing = F.coalesce(F.col("rid") == K.MISSING_ID, F.lit(True))
    named = labels.filter(~missing).join(texts, list(keys), "left")
    matched = named.unionByName(labels.filter(missing).withColumn("joined_text", F.lit(None).cast("string")))
    blank = strip(F.coalesce("joined_text", F.lit(""))) == ""
    matched = matched.withColumn("_blank", blank).withColumn(
        "_output", clean_text(F.when(F.col("_blank"), F.col("output")))  # nothing to clean where a source text stands
    )
    return (
        matched.withColumn("source_text", F.when(F.col("_blank"), F.col("_output")).otherwise(F.col("joined_text")))
        .withColumn("is_fallback", F.col("_blank") & (F.col("_output") != ""))
        .drop("joined_text", "_blank", "_output")
    )


def add_citations(records: DataFrame, head: int | None = None, strict: bool = False) -> DataFrame:
    """Add cleaned ``law_name`` and ``article`` (from ``title, sm_class, docu_type, source_text``).

    Only the cited document types are parsed. ``head`` is the part of the text that is read for
    citations; None reads all of it.
    """
    parse = F.when(F.col("docu_type").isin(*K.CITED_TYPES), F.col("source_text")).otherwise("")

    def named(m):
        law, article = compose_law_and_article("title", "sm_class", m["laws"], m["citations"], "docu_type")
        return F.struct(post_clean(law, strict).alias("law_name"), post_clean(article, strict).alias("article"))

    # inlined as a generator of one row: as plain columns the parsing would be repeated wherever one of its values is used
    others = [F.col(f"`{c}`") for c in records.columns if c not in ("law_name", "article")]
    return records.select(*others, F.inline_outer(F.array(let(legal_metadata(parse, head), named))))


def label_columns(labels: DataFrame) -> DataFrame:
    """Flat columns of label records ``info map, label map, docu_type, task_type``."""
    key = F.create_map(*[F.lit(x) for kv in K.INFO_ID_KEY.items() for x in kv])
    text = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    rid = F.coalesce(F.try_element_at(F.col("info"), key[F.col("docu_type")]), F.lit(""))
    return (
        labels.withColumn("rid", zfill(strip(rid)))
        .withColumn("output", text("label", "output"))
        .withColumn("title", F.coalesce(text("info", "title"), F.lit("")))
        .withColumn("sm_class", F.coalesce(text("info", "smClass"), F.lit("")))
        .withColumn("is_valid", is_valid_label("output", F.size("info")))
    )


def build_corpus(labels: DataFrame, sentences: DataFrame, head: int | None = None,
                 strict: bool = False) -> DataFrame:
    """Corpus rows ``info, label, docu_type, task_type, law_name, article, source_text``."""
    flat = label_columns(labels).filter("is_valid")
    rows = add_citations(join_source(flat, ordered_concat(sentences, wanted=flat)), head, strict)
    dated = F.transform_values(
        "info", lambda k, v: F.when(k.isin(*K.DATE_FIELDS), format_date(v)).otherwise(v)
    )
    cleaned = F.transform(F.map_entries("label"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    # NFKC runs in Python where needed, which cannot sit inside a lambda: one pass over the joined values.
    sep = F.lit("\x1f")
    joined = clean_label_values(cleaned, sep)
    return rows.select(
        dated.alias("info"), joined.alias("label"), "docu_type", "task_type", "law_name", "article",
        "source_text", "is_fallback",
    )


def clean_label_values(entries, sep):
    from ..functions.text import nfkc, remove_patterns

    raw = F.transform(entries, lambda e: F.replace(e["v"], sep, F.lit(" ")))
    flat = nfkc(F.array_join(F.transform(raw, lambda v: F.coalesce(v, F.lit(""))), "\x1f"))
    values = F.transform(F.split(flat, "\x1f", -1), remove_patterns)
    return F.map_from_entries(
        F.zip_with(entries, values, lambda e, v: F.struct(e["k"].alias("key"), v.alias("value")))
    )


def pipeline_stats(checked: DataFrame) -> DataFrame:
    """Input, skipped, fallback and saved counts per type and task with subtotals and a grand total."""
    return checked.rollup("docu_type", "task_type").agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_valid")).alias("skip"),
        F.count_if(F.col("is_valid") & F.coalesce("is_fallback", F.lit(False))).alias("fallback"),
        F.count_if(F.col("is_valid")).alias("saved"),
    )


def corpus_parts() -> list[tuple[str, str]]:
    """Type and task pairs a corpus is read from; statutes have no summary task."""
    return [(d, t) for d in K.CORPUS_TYPES for t in K.CORPUS_TASKS if (d, t) != ("법령", "SUM")]


def keep_parts(records: DataFrame) -> DataFrame:
    """Records of those pairs, in one pass."""
    pairs = [F.struct(F.lit(d), F.lit(t)) for d, t in corpus_parts()]
    return records.filter(F.struct("docu_type", "task_type").isin(*pairs))
