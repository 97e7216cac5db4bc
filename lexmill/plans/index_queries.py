"""Index upkeep: ids, upserts, deletes, updates, run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chunking import ChunkConfig
from ..functions import constants as K
from ..operators import index as I
from ..operators.positions import positions
from .base import register, sql_strip, table
from .chunk_queries import CHUNK_ROWS, sql_chunks
from .fixtures import KDOCS, LAW_DATE, NAMESPACE, kdocs
from .text_queries import META

UUID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21))"


def emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.expr(NAMESPACE).alias("namespace"))


EMB = f"select vec_id, label, {NAMESPACE} as namespace from embeddings"


@register("vec_upsert", "vec_id long, label long, namespace str", f"""
    select * from ({EMB}) as e where label <> 3 union all
    select vec_id, label + 100, 'public' from ({EMB}) as e where label = 3 union all
    select vec_id + 1000000, label, namespace from ({EMB}) as e where label = 4""")
def vec_upsert(spark, sf):
    base = emb(spark, sf)
    changed = base.filter("label = 3").select("vec_id", (F.col("label") + 100).alias("label"), F.lit("public").alias("namespace"))
    added = base.filter("label = 4").select((F.col("vec_id") + 1000000).alias("vec_id"), "label", "namespace")
    return I.upsert(base, changed.unionByName(added), "vec_id")


@register("vec_delete_ids", "vec_id long, namespace str", f"select vec_id, namespace from ({EMB}) as e where vec_id not in (select doc_id from labels)")
def vec_delete_ids(spark, sf):
    return I.delete_by_ids(emb(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id")


@register("delete_doc", "doc_id long, chunk_index long", f"select doc_id, chunk_index from ({CHUNK_ROWS}) as c where doc_id <> 7")
def delete_doc(spark, sf):
    return I.delete_by_value(I.chunk_documents(kdocs(spark, sf), text="ktext"), "doc_id", 7)


@register("drop_namespace", "vec_id long, namespace str", f"select vec_id, namespace from ({EMB}) as e where namespace <> 'user_7'")
def drop_namespace(spark, sf):
    return I.drop_namespace(emb(spark, sf), 7)


@register("chunk_ids", "vector_id str, doc_id long, chunk_index long, chunk_text str, article str", f"""
    select {UUID} as vector_id, doc_id, chunk_index, text as chunk_text, article
    from (select *, md5(concat(doc_id, ':', chunk_index)) as h from ({CHUNK_ROWS}) as c) as z""")
def chunk_ids(spark, sf):
    return I.chunk_rows(I.chunk_documents(kdocs(spark, sf), text="ktext"))


@register("doc_chunks", "position long, doc_id long, chunk_index long, vector_id str", f"""
    select doc_id, chunk_index, {UUID} as vector_id, row_number() over (order by doc_id, chunk_index) as position
    from (select *, md5(concat(doc_id, ':', chunk_index)) as h from ({CHUNK_ROWS}) as c) as z""")
def doc_chunks(spark, sf):
    rows = positions(chunk_ids(spark, sf), [F.asc("doc_id"), F.asc("chunk_index")])
    return rows.withColumn("position", F.col("position") + 1)


@register("chunk_lookup", "doc_id long, vector_id str, chunk_text str", f"""
    select l.doc_id, {UUID} as vector_id, text as chunk_text from labels as l join (
      select *, md5(concat(doc_id, ':', chunk_index)) as h from ({CHUNK_ROWS}) as c) as z on z.h = md5(concat(l.doc_id, ':0'))""")
def chunk_lookup(spark, sf):
    wanted = table(spark, sf, "labels").select(I.chunk_id("doc_id", F.lit(0)).alias("vector_id"))
    return chunk_ids(spark, sf).join(wanted, "vector_id", "left_semi")


@register("update_chunks", "vector_id long, chunk_text str, law_date str", f"""
    select d.doc_id as vector_id, case when l.doc_id is null then text else concat('quality ', quality) end as chunk_text,
      case when quality = 1 then '2030-01-01' else {LAW_DATE.replace('doc_id', 'd.doc_id')} end as law_date
    from documents as d left join labels as l on l.doc_id = d.doc_id""")
def update_chunks(spark, sf):
    base = table(spark, sf, "documents").select(
        F.col("doc_id").alias("vector_id"), F.col("text").alias("chunk_text"), F.expr(LAW_DATE).alias("law_date"))
    new = table(spark, sf, "labels").select(
        F.col("doc_id").alias("vector_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("new_text"),
        F.when(F.col("quality") == 1, "2030-01-01").otherwise("").alias("new_law_date"))
    return I.update_chunk_text(base, new)


CORPUS = ChunkConfig(min_chars=K.CORPUS_MIN_CHARS)
REASONS = f"""
    select doc_id, text, case when article = '' then 'no_article' when length({sql_strip('text')}) < 20 then 'short_text'
      when row_number() over (partition by ok, {sql_strip('text')} order by doc_id) = 1 then 'kept' else 'duplicate' end as reason
    from (select *, article <> '' and length({sql_strip('text')}) >= 20 as ok from (select doc_id, text, {META['article']} as article from documents) as a) as b"""


def records(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", F.expr(META["article"]).alias("article"))


@register("skip_reasons", "doc_id long, reason str", f"select doc_id, reason from ({REASONS}) as r")
def skip_reasons(spark, sf):
    return I.skip_reasons(records(spark, sf))


@register("index_stats", "reason str, records long, chunks long", f"""
    select reason, count(*) as records, sum(case when reason = 'kept' then coalesce(n, 0) else 0 end) as chunks from ({REASONS}) as r
    left join (select doc_id, count(*) as n from ({sql_chunks('select doc_id, text from documents', 'doc_id', 'text', CORPUS, True)}) as c
      group by doc_id) as k on k.doc_id = r.doc_id group by reason""")
def index_stats(spark, sf):
    return I.index_stats(records(spark, sf), CORPUS)
