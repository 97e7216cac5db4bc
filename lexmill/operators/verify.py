"""Check the citations of answers against the evidence they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.citations import law_refs
from ..functions.text import drop_space, let


def evidence_refs(article: Column, text: Column, strict: bool = False, pattern: str = K.LAW_REF) -> Column:
    """Space-free references a hit vouches for: its article field, else those in its text.

    An article field may list several citations; ``strict`` compares it as one string.
    """
    listed = F.array(article) if strict else F.split(article, ",", -1)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    has_article = F.coalesce(article, F.lit("")) != ""
    refs = F.transform(F.when(has_article, listed).otherwise(found), drop_space)
    return F.filter(F.array_distinct(refs), lambda r: r != "")


def valid_refs(hits: DataFrame, strict: bool = False) -> DataFrame:
    """``(query_id, valid)``: at most k hits meet per question, reduced to distinct references first."""
    refs = evidence_refs(F.col("article"), F.col("text"), strict)
    return hits.groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.collect_list(refs))).alias("valid")
    )


def verify_answers(answers: DataFrame, hits: DataFrame, strict: bool = False, pattern: str = K.LAW_REF) -> DataFrame:
    """Add ``verified, answer_refs, verified_refs, unverified_refs, warnings`` to each answer."""
    checked = (  # references first: a caller who needs no texts sends none through the join
        answers.withColumn("answer_refs", law_refs(F.col("answer"), pattern))
        .join(valid_refs(hits, strict), "query_id", "left")
        .withColumn("valid", F.coalesce("valid", F.array().cast("array<string>")))
    )
    return (
        checked.withColumn("_checked", _marked(F.col("answer_refs"), F.col("valid")))
        .withColumn("verified_refs", F.transform(F.filter("_checked", lambda r: r["backed"]), lambda r: r["ref"]))
        .withColumn("unverified_refs", F.transform(F.filter("_checked", lambda r: ~r["backed"]), lambda r: r["ref"]))
        .withColumn("verified", F.size("unverified_refs") == 0)
        .withColumn(
            "warnings",
            F.transform("unverified_refs", lambda r: F.concat(F.lit("'"), r, F.lit(K.WARNING_TAIL))),
        )
        .drop("valid", "_checked")
    )


def _marked(refs: Column, valid: Column) -> Column:
    """``struct(at, ref, backed)`` of each reference in order: sorted together, a valid form stands right before its reference."""
    known = F.transform(valid, lambda v: F.struct(v.alias("key"), F.lit(-1).alias("at"), F.lit("").alias("ref")))
    asked = F.transform(refs, lambda r, i: F.struct(drop_space(r).alias("key"), i.alias("at"), r.alias("ref")))

    def mark(s):
        all_marked = F.transform(s, lambda x, i: F.struct(
            x["at"].alias("at"), x["ref"].alias("ref"),
            F.coalesce((F.get(s, i - 1)["key"] == x["key"]) & (F.get(s, i - 1)["at"] == -1), F.lit(False)).alias("backed"),
        ))
        return F.array_sort(F.filter(all_marked, lambda x: x["at"] >= 0))

    return let(F.array_sort(F.concat(known, asked)), mark)
