"""Composed flows: document description, history, the SQL function."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.chunking import ChunkConfig
from ..functions.sql import register_sql, register_table_functions
from ..operators import flows, windows
from ..operators.rows import explode_positions
from .base import ORACLE, register, sql_in, table
from .chunk_queries import INSPECT, sql_chunks, sql_header, sql_law_mode
from .fixtures import CATEGORY, KDOCS, LAW_DATE, TURNS, kdocs, turns
from .text_queries import BODY, QUOTE, REPLY, sql_revised_date

DATED = "concat(ktext, ' 2024. 3. ', cast(doc_id % 28 + 1 as string), '. 개정')"
SECOND_TEXT = f"case when doc_id % 2 = 0 then '' else {BODY} end"
SECOND = f"concat('{{', {QUOTE}, 'summary', {QUOTE}, ': ', {QUOTE}, {SECOND_TEXT}, {QUOTE}, '}}')"
TEXTS = f"select doc_id, {DATED} as t from ({KDOCS}) as kd"


def count_chunks(detect: bool) -> str:
    return f"select doc_id, count(*) as n from ({sql_chunks(TEXTS, 'doc_id', 't', ChunkConfig(), detect)}) as c group by doc_id"


@register("document_meta", "doc_id long, category str, law_date str, law_name str, summary str, error str", f"""
    select doc_id, category, case when error is null then law_date end as law_date,
      case when error is null and structured then law else '' end as law_name,
      case when error is null then case when second = '' or length(second) < length(summary) then summary else second end else '' end as summary, error
    from (select p.doc_id, p.category, p.summary, {SECOND_TEXT} as second, coalesce(law, '') as law, r.law_date, {sql_in('p.category', K.STRUCTURED_CATEGORIES)} as structured,
        case when not {sql_in('p.category', K.STRUCTURED_CATEGORIES + K.UNSTRUCTURED_CATEGORIES)} then 'not_legal'
          when coalesce(case when {sql_in('p.category', K.STRUCTURED_CATEGORIES)} then a.n else b.n end, 0) = 0 then 'no_chunks' end as error
      from ({ORACLE['parse_analysis']}) as p join (select doc_id as id, text from documents) as d on d.id = p.doc_id
      left join ({sql_law_mode(TEXTS, 'doc_id', 't')}) as l on l.doc_id = p.doc_id
      left join ({sql_revised_date(TEXTS)}) as r on r.doc_id = p.doc_id
      left join ({count_chunks(True)}) as a on a.doc_id = p.doc_id left join ({count_chunks(False)}) as b on b.doc_id = p.doc_id) as z""".replace(
    f"{SECOND_TEXT} as second", f"{SECOND_TEXT.replace('doc_id', 'p.doc_id')} as second"))
def document_meta(spark, sf):
    replies = table(spark, sf, "documents").select(
        "doc_id", F.expr(REPLY).alias("preview_reply"), F.expr(SECOND).alias("analysis_reply"))
    texts = kdocs(spark, sf).select("doc_id", F.expr(DATED).alias("text"))
    return flows.document_meta(texts.join(replies, "doc_id"))


@register("history_turns", "session_id long, turn long, past str", f"""
    select session_id, turn, coalesce(string_agg(q, '|' order by pt) filter (q is not null), '') as past from (
      select t.session_id, t.turn, p.turn as pt, p.question as q, row_number() over (partition by t.session_id, t.turn order by p.turn desc) as rn
      from ({TURNS}) as t left join ({TURNS}) as p on p.session_id = t.session_id and p.turn < t.turn) as x where rn <= {K.HISTORY_TURNS}
    group by session_id, turn""")
def history_turns(spark, sf):
    rows = turns(spark, sf).select("session_id", "turn", "question")
    past = windows.look_back(rows, ["session_id"], "turn", F.floor(F.col("turn") / 1024), ["question"], K.HISTORY_TURNS, "past")
    return past.select("session_id", "turn", F.array_join("past.question", "|").alias("past"))


@register("sql_chunk_array", "doc_id long, chunk_index long, text str", f"""
    select doc_id, chunk_index, ctext as text
    from ({sql_chunks('select doc_id, text from documents', 'doc_id', 'text', INSPECT, False)}) as c""")
def sql_chunk_array(spark, sf):
    register_sql(spark)
    call = F.expr(f"chunk_array(text, {INSPECT.max_chars}, {INSPECT.overlap_chars}, {INSPECT.min_chars})")
    cut = table(spark, sf, "documents").select("doc_id", call.alias("c"))
    return explode_positions(cut, ["doc_id"], F.col("c"), "chunk_index", "text")


SECTIONED = ChunkConfig()


@register("sql_chunks", "doc_id long, chunk_index long, article str, text str", f"""
    select doc_id, chunk_index, {sql_header('sec')} as article, ctext as text from ({sql_chunks(f'select doc_id, ktext from ({KDOCS}) as kd', 'doc_id', 'ktext', SECTIONED, True)}) as c""")
def sql_chunk_table(spark, sf):
    register_table_functions(spark)
    return spark.sql(
        f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL chunks_of(d.ktext, {SECTIONED.max_chars}, {SECTIONED.overlap_chars}, {SECTIONED.min_chars}) c",
        docs=kdocs(spark, sf))


@register("sql_citations", "doc_id long, pos long, ref str, law str, article str", f"""
    select *, trim(regexp_extract(ref, '^(.*)제[^제]*$', 1)) as law, regexp_extract(ref, '제[^제]*$') as article from ({ORACLE['law_refs']}) as r""")
def sql_citation_table(spark, sf):
    register_table_functions(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL citations_of(d.ktext) c", docs=kdocs(spark, sf))


@register("upload_flow", "id str, namespace str, document_id long, chunk_index long, article str, category str, law_date str, n_tokens long", f"""
    select id, concat('{K.USER_NAMESPACE_PREFIX}', document_id % 5) as namespace, document_id, chunk_index, article, category, law_date, n_tokens
    from ({ORACLE['build_vectors']}) as b""")
def upload_flow(spark, sf):
    """Uploaded documents of five users, from text to index records in one plan."""
    docs = kdocs(spark, sf).select(
        "doc_id", (F.col("doc_id") % 5).alias("user_id"), F.col("ktext").alias("text"), F.expr(CATEGORY).alias("category"), F.expr(LAW_DATE).alias("law_date"))
    made = flows.index_documents(docs, F.lit("2024-01-01 00:00:00"))
    return made.select("id", "namespace", "metadata.*", F.size("idx").alias("n_tokens"))
