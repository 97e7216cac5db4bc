"""Readers over files that Spark writes from the driver tables: what is read back is what the tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import index as I
from ..session import shared_dir
from ..sources import files
from .base import register, table

KIND, TASK = K.CORPUS_TYPES[0], "QA"
#: Documents or labels in a file.
A_FILE = 100


def folder(spark, name):
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def write_arrays(rows, number, path):
    """One JSON array a file, of the rows with equal ``number // A_FILE``."""
    part = F.floor(F.col(number) / A_FILE).alias("part")
    body = F.to_json(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in rows.columns]))), {"ignoreNullFields": "false"})
    rows.groupBy(part).agg(body.alias("value")).write.partitionBy("part").text(path)


@register("source_csv", "rid str, seq dbl, content str", """
    select lpad(cast(doc_id as varchar), cast(greatest(6, length(cast(doc_id as varchar))) as int), '0') as rid, cast(doc_id % 50 as double) as seq, coalesce(text, '') as content
    from documents""")
def source_csv(spark, sf):
    root = folder(spark, "csv")
    rows = table(spark, sf, "documents").select(
        (F.col("doc_id") % 50).alias(K.SEQ_COLUMN), F.col("doc_id").alias(K.SOURCE_ID_COLUMN[KIND]), F.col("text").alias(K.CONTENT_COLUMN))
    rows.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(
        f"{root}/{K.SOURCE_FOLDER_PREFIX}{KIND}")
    return files.read_source_csv(spark, root, KIND).select("rid", "seq", "content")


@register("label_json", "rid str, output str, docu_type str, task_type str", f"""
    select cast(doc_id as varchar) as rid, concat('quality ', quality) as output, '{KIND}' as docu_type, '{TASK}' as task_type from labels""")
def label_json(spark, sf):
    root = folder(spark, "json")
    labels = table(spark, sf, "labels").select(
        "doc_id", F.create_map(F.lit("id"), F.col("doc_id").cast("string")).alias("info"),
        F.create_map(F.lit("output"), F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias("label"))
    part = F.floor(F.col("doc_id") / A_FILE).alias("part")
    body = F.to_json(F.collect_list(F.struct("info", "label")))
    made = f"{root}/made"
    labels.groupBy(part).agg(body.alias("value")).write.partitionBy("part").text(made)
    return files.label_objects(spark, made, "*.txt", KIND, TASK).select(
        F.col("info")["id"].alias("rid"), F.col("label")["output"].alias("output"), "docu_type", "task_type")


@register("json_array", "text str, category str, law_date str", """
    select text, source as category, cast(n_chars as varchar) as law_date from documents""")
def json_array(spark, sf):
    path = folder(spark, "array")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("category"), F.col("n_chars").cast("string").alias("law_date"))
    write_arrays(docs, "doc_id", path)
    return files.read_json_array(spark, f"{path}/*.txt")


@register("corpus_jsonl", "article str, category str, source_text str", """
    select concat('제', doc_id, '조') as article, lang as category, text as source_text from documents""")
def corpus_jsonl(spark, sf):
    path = folder(spark, "jsonl")
    files.write_corpus_jsonl(table(spark, sf, "documents").select(
        F.concat(F.lit("제"), F.col("doc_id").cast("string"), F.lit("조")).alias("article"), F.col("lang").alias("category"),
        F.col("text").alias("source_text")), path)
    return files.good_lines(files.read_corpus_jsonl(spark, path)).select("article", "category", "source_text")


@register("upload_texts", "part long, file_type str, text str", f"""
    select doc_id // {A_FILE} as part, 'TXT' as file_type, concat(string_agg(doc_id || ' ' || text, chr(10) order by doc_id), chr(10)) as text
    from documents group by 1""")
def upload_texts(spark, sf):
    path = folder(spark, "uploads")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda d: F.concat(d["doc_id"].cast("string"), F.lit(" "), d["text"])), "\n")
    table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / A_FILE).alias("part")).agg(body.alias("value")).write.partitionBy("part").text(path)
    read = files.upload_texts(files.read_uploads(spark, path).filter("length > 0"))
    return read.select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long").alias("part"), "file_type", "text")


@register("update_hits", "vector_id long, existed bool", """
    select distinct l.doc_id + (l.doc_id % 3) * 1000000000 as vector_id, d.doc_id is not null as existed
    from labels as l left join documents as d on d.doc_id = l.doc_id + (l.doc_id % 3) * 1000000000""")
def update_hits(spark, sf):
    base = table(spark, sf, "documents").select(F.col("doc_id").alias("vector_id"))
    asked = table(spark, sf, "labels").select((F.col("doc_id") + (F.col("doc_id") % 3) * 1000000000).alias("vector_id"))
    return I.update_hits(base, asked.unionByName(asked))
