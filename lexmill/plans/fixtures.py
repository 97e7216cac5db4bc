"""Tables that the queries derive from the driver tables, in SQL text both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import table

LAW = (
    "case doc_id % 5 when 0 then '형법' when 1 then '민법' when 2 then '관세법' "
    "when 3 then '근로기준법' else '개인정보 보호법' end"
)
OTHER_LAW = (
    "case doc_id % 4 when 0 then '시행령' when 1 then '전단' when 2 then '법률' "
    "else '도로교통법 시행규칙' end"
)


def num(expr: str) -> str:
    return f"cast({expr} as string)"


# The whole text of a document with Korean law citations woven in: a titled article before every
# paragraph, a subordinate, invalid or bare reference after every comma, a bracketed law now and then.
KTEXT = (
    f"concat({LAW}, ' 제', {num('doc_id % 300 + 1')}, '조(목적) ', "
    f"replace(replace(replace(text, "
    f"concat('.', chr(10)), concat('.', chr(10), '제', {num('doc_id % 300 + 2')}, '조의2(정의) ')), "
    f"', ', concat(', ', {OTHER_LAW}, ' 제', {num('doc_id % 40 + 1')}, '조 ')), "
    f"' la ', concat(' 「상법」 제', {num('doc_id % 9 + 1')}, '조와 법률 제8조 ')), "
    f"' ', {LAW}, ' 시행령 제', {num('doc_id % 40 + 1')}, '조에 따라')"
)
KDOCS = f"select doc_id, lang, source, {KTEXT} as ktext from documents"

CATEGORY = (
    "case doc_id % 7 when 0 then '법령·규정' when 1 then '계약서·협약서' when 2 then '판결문·결정문' "
    "when 3 then '행정문서·공문' when 4 then '보고서·연구자료' when 5 then '기술문서' else '기타' end"
)
STATUS = (
    "case doc_id % 6 when 0 then 'UPLOADED' when 1 then 'CHUNKED' when 2 then 'EMBEDDED' "
    "when 3 then 'READY' when 4 then 'FAILED' else 'DELETED' end"
)
LAW_DATE = (
    "concat(cast(2000 + doc_id % 25 as string), '-', lpad(cast(doc_id % 12 + 1 as string), 2, '0'), '-15')"
)
FILE_NAME = (
    "concat('dir/', source, '_', cast(doc_id as string), case doc_id % 9 when 0 then '.pdf' when 1 then '.HWP' "
    "when 2 then '.hwpx' when 3 then '.docx' when 4 then '.PPTX' when 5 then '.txt' when 6 then '.xlsx' "
    "when 7 then '.tar.gz' else '' end)"
)
NAMESPACE = "case when label < 5 then 'public' else concat('user_', cast(label as string)) end"
LEVEL = "case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end"
ENDPOINT = (
    "case event_id % 4 when 0 then '/chat/Documents' when 1 then '/ws/chat' when 2 then '/admin/users' "
    "else '/chat/sessions/upload/document' end"
)

# conversations as messages: a user turn is the question, the assistant turn after it the answer
TURNS = (
    "select u.conv_id as session_id, u.turn as turn, u.conv_id * 1000 + u.turn as message_id, "
    "u.text as question, a.text as answer from conversations as u left join conversations as a "
    "on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user'"
)


def kdocs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.expr(KTEXT).alias("ktext"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), (F.col("doc_id") % 97).alias("session_id"),
        (F.col("doc_id") % 31).alias("user_id"), F.expr(FILE_NAME).alias("file_name"),
        F.expr(STATUS).alias("status"), F.expr(CATEGORY).alias("category"), at.alias("created_at"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    asked = conv.filter("role = 'user'").select(
        F.col("conv_id").alias("session_id"), "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.col("text").alias("question"),
    )
    replies = conv.filter("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(replies, ["session_id", "turn"], "left")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("log_id"), "user_id", F.expr(LEVEL).alias("level"),
        F.expr(ENDPOINT).alias("endpoint"), F.col("ts").alias("created_at"),
    )


LOGS = (
    f"select event_id as log_id, user_id, {LEVEL} as level, {ENDPOINT} as endpoint, ts as created_at from events"
)
