"""Assemble generation inputs: numbered evidence and role-tagged messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.text import blank_to_null, first_filled, strip


def reference_line(rank: Column, article: Column, law: Column, text: Column) -> Column:
    body = F.coalesce(blank_to_null(strip(text)), F.lit(K.NO_CONTENT))
    label = (
        F.when(F.coalesce(article, F.lit("")) != "", F.concat(F.lit("[조문: "), article, F.lit("]")))
        .when(law != "", F.concat(F.lit("[법령명: "), law, F.lit("] [조문: 확인 불가]")))
        .otherwise("[조문: 확인 불가]")
    )
    return F.concat(rank.cast("string"), F.lit(". "), label, F.lit(" [본문]\n"), body)


def reference_block(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, reference)``: the hits of a question as one numbered text. At most k rows meet."""
    law = first_filled("law_name", "category")
    line = reference_line(F.col("rank"), F.col("article"), law, F.col("text"))
    joined = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("_lines")
    )
    body = F.coalesce(F.array_join(F.col("_lines.line"), "\n"), F.lit(K.NO_REFERENCE))
    return (
        questions.select("query_id").join(joined, "query_id", "left")
        .select("query_id", F.concat(F.lit(K.REFERENCE_TITLE + "\n"), body).alias("reference"))
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_messages(questions: DataFrame, references: DataFrame, history: DataFrame, system: str) -> DataFrame:
    """``(query_id, messages)``: system text, past turns oldest first, evidence with the question.

    ``history`` holds at most the newest N turns per question, ``recency`` 1 = newest.
    """
    past = history.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(F.struct("recency", "question", "answer")), asc=False
        ).alias("_past")
    )
    turns = F.flatten(F.transform(
        F.coalesce("_past", F.array().cast("array<struct<recency:int,question:string,answer:string>>")),
        lambda t: F.array(message("user", t["question"]), message("assistant", t["answer"])),
    ))
    asked = F.concat(F.col("reference"), F.lit(f"\n\n{K.QUESTION_TITLE}\n"), F.col("question"))
    return (
        questions.join(references, "query_id", "left").join(past, "query_id", "left")
        .select(
            "query_id",
            F.concat(F.array(message("system", F.lit(system))), turns, F.array(message("user", asked))).alias("messages"),
        )
    )
