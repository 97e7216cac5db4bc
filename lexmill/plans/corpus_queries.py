"""Corpus build over derived source sentences and label records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import zfill
from ..operators import corpus as C
from ..operators.rows import explode_positions
from .base import q, register, sql_in, table
from .citation_queries import sql_metadata, sql_post_clean
from .fixtures import KDOCS, KTEXT, kdocs
from .text_queries import sql_clean, sql_filled

DOCU = "case doc_id % 4 when 0 then '법령' when 1 then '판결문' when 2 then '결정례' else '해석례' end"
INFO_KEY = "case doc_id % 4 when 0 then 'lawId' when 1 then 'precedId' when 2 then 'determintId' else 'interpreId' end"
TASK = "case when toxic = 1 then 'SUM' else 'QA' end"
RID = "case when length(cast(doc_id as string)) < 6 then lpad(cast(doc_id as string), 6, '0') else cast(doc_id as string) end"


def sentences(spark, sf):
    """Lines of every document, numbered from the last to the first, so that order matters."""
    lines = explode_positions(kdocs(spark, sf), ["doc_id"], F.split("ktext", "\n"), "pos", "content")
    return lines.select(
        F.expr(DOCU).alias("docu_type"), zfill(F.col("doc_id").cast("string")).alias("rid"),
        (-F.col("pos")).cast("double").alias("seq"), F.lit("part.csv").alias("file"), F.col("pos").cast("long").alias("pos"), "content")


def labels(spark, sf):
    """One label record per labelled document; some without an id, some too short to keep."""
    rows = table(spark, sf, "labels")
    text = lambda c: c.cast("string")
    rid = F.when(F.col("doc_id") % 9 == 0, "0").otherwise(text(F.col("doc_id")))
    info = F.create_map(
        F.expr(INFO_KEY), rid, F.lit("title"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("관세법"),
        F.lit("smClass"), F.concat(F.lit("제"), text(F.col("doc_id")), F.lit("조")), F.lit("effectDate"), F.lit(" 20200102 "))
    output = F.when(F.col("doc_id") % 13 == 0, " ab ").otherwise(F.concat(F.lit("답변  형법 제"), text(F.col("doc_id")), F.lit("조\n참조")))
    return rows.select(
        info.alias("info"), F.create_map(F.lit("output"), output, F.lit("input"), F.lit("질문 ")).alias("label"),
        F.expr(DOCU).alias("docu_type"), F.expr(TASK).alias("task_type"), "doc_id")


REVERSED = f"""select doc_id, array_to_string(list_reverse(string_split(ktext, chr(10))), chr(10)) as raw from ({KDOCS}) as kd"""
JOINED = f"select doc_id, {sql_clean('raw')} as joined_text from ({REVERSED}) as rv where doc_id > 0"
L_OUT = "case when doc_id % 13 = 0 then ' ab ' else concat('답변  형법 제', cast(doc_id as string), '조', chr(10), '참조') end"
LABELS = f"""select doc_id, {DOCU} as docu_type, {TASK} as task_type, {L_OUT} as output, doc_id % 13 <> 0 as is_valid,
    case when doc_id % 3 = 0 then '' else '관세법' end as title, concat('제', doc_id, '조') as sm_class, doc_id % 9 = 0 as no_id from labels"""
SOURCED = f"""select l.*, coalesce(nullif(trim(case when no_id then null else joined_text end), ''), {sql_clean('output')}) as source_text,
    (no_id or coalesce(joined_text, '') = '') as is_fallback from ({LABELS}) as l left join ({JOINED}) as j on j.doc_id = l.doc_id where is_valid"""


@register("ordered_concat", "docu_type str, rid str, joined_text str",
          f"select {DOCU} as docu_type, {RID} as rid, joined_text from ({JOINED}) as j")
def ordered_concat(spark, sf):
    return C.ordered_concat(sentences(spark, sf))


@register("source_join", "doc_id long, source_text str, is_fallback bool", f"select doc_id, source_text, is_fallback from ({SOURCED}) as s")
def source_join(spark, sf):
    flat = C.label_columns(labels(spark, sf)).filter("is_valid")
    return C.join_source(flat, C.ordered_concat(sentences(spark, sf), wanted=flat))


PARSED = sql_metadata(
    f"select doc_id, case when {sql_in('docu_type', K.CITED_TYPES)} then source_text else '' end as t from ({SOURCED}) as sc")
COMPOSED = f"""select s.doc_id, case when laws <> '' then laws else title end as law,
    case when laws <> '' then {sql_filled('cits', 'sm_class')} else trim(concat(title, ' ', sm_class)) end as art
    from ({SOURCED}) as s join ({PARSED}) as p on p.doc_id = s.doc_id"""


@register("corpus_build", "docu_type str, task_type str, law_name str, article str, source_text str, effect_date str, output str", f"""
    select docu_type, task_type, a.cleaned as law_name, b.cleaned as article, source_text, '2020-01-02' as effect_date, {sql_clean('output')} as output
    from ({SOURCED}) as s
    join ({sql_post_clean(f"select doc_id, law as joined from ({COMPOSED}) as c1")}) as a on a.doc_id = s.doc_id
    join ({sql_post_clean(f"select doc_id, art as joined from ({COMPOSED}) as c2")}) as b on b.doc_id = s.doc_id""")
def corpus_build(spark, sf):
    made = C.build_corpus(labels(spark, sf), sentences(spark, sf))
    return made.select("docu_type", "task_type", "law_name", "article", "source_text",
                       F.col("info.effectDate").alias("effect_date"), F.col("label.output").alias("output"))


@register("pipeline_stats", "docu_type str, task_type str, total long, skip long, fallback long, saved long", f"""
    select docu_type, task_type, count(*) as total, count(*) filter (not is_valid) as skip, count(*) filter (is_valid and fb) as fallback,
      count(*) filter (is_valid) as saved from (
        select l.*, (no_id or coalesce(joined_text, '') = '') as fb from ({LABELS}) as l left join ({JOINED}) as j on j.doc_id = l.doc_id) as z
    group by rollup (docu_type, task_type)""")
def pipeline_stats(spark, sf):
    flat = C.label_columns(labels(spark, sf))
    checked = C.join_source(flat, C.ordered_concat(sentences(spark, sf), wanted=flat))
    return C.pipeline_stats(checked)


@register("corpus_union", "docu_type str, task_type str, records long", f"""
    select docu_type, task_type, count(*) as records from ({LABELS}) as l where not (docu_type = '법령' and task_type = 'SUM') group by 1, 2""")
def corpus_union(spark, sf):
    return C.keep_parts(labels(spark, sf)).groupBy("docu_type", "task_type").agg(F.count("*").alias("records"))
