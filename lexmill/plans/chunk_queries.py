"""Documents to sections, sentences and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as C, constants as K
from ..functions.chunking import ChunkConfig
from ..functions.text import preview, strip, text_hash
from ..operators import index
from ..operators.rows import explode_positions
from .base import q, register, sql_drop_space, sql_hash, sql_strip, sql_sub, table
from .fixtures import KDOCS, kdocs

MARK = "\x02"
INSPECT = ChunkConfig(500, 50, 20)


def sql_sections(text: str) -> str:
    marked = sql_sub(text, f"({K.SECTION_HEAD}{K.SECTION_TITLE})", MARK + r"\1")
    return f"list_filter(list_transform(string_split({marked}, {q(MARK)}), lambda x: {sql_strip('x')}), lambda x: x <> '')"


def sql_sentences(text: str) -> str:
    marked = sql_sub(text, f"({K.SENTENCE_ENDS}){K.S}+", r"\1" + MARK)
    return f"list_filter(list_transform(string_split({marked}, {q(MARK)}), lambda x: {sql_strip('x')}), lambda x: x <> '')"


def sql_header(section: str) -> str:
    return sql_drop_space(f"regexp_extract({section}, {q(f'^({K.SECTION_HEAD}){K.SECTION_TITLE}')}, 1)")


def sql_assemble(sentences: str, cfg: ChunkConfig) -> str:
    over = f"length(a.b) + length(e.b) + 1 > {cfg.max_chars}"
    fold = (
        f"list_reduce(list_transform({sentences}, lambda s: {{'o': []::varchar[], 'b': s}}), lambda a, e: "
        f"case when {over} then {{'o': case when length(a.b) >= {cfg.min_chars} then list_append(a.o, {sql_strip('a.b')}) "
        f"else a.o end, 'b': concat(right(a.b, {cfg.overlap_chars}), ' ', e.b)}} "
        "else {'o': a.o, 'b': concat(a.b, ' ', e.b)} end)"
    )
    return fold


def sql_chunks(source: str, key: str, text: str, cfg: ChunkConfig, detect: bool) -> str:
    """``key, chunk_index, sec, ctext`` of all chunks of ``source``."""
    sections = sql_sections(text) if detect else f"list_filter([{sql_strip(text)}], lambda x: x <> '')"
    return f"""
      with src as ({source}),
      secs as (select {key}, {sections} as ss from src),
      sec as (select {key}, unnest(ss) as sec, unnest(range(1, len(ss) + 1)) as sp from secs),
      folded as (select {key}, sec, sp, {sql_assemble(f"case when length(sec) <= {cfg.max_chars} then [sec] else {sql_sentences('sec')} end", cfg)} as f from sec),
      parts as (select {key}, sec, sp, list_filter(list_append(f.o, {sql_strip('f.b')}), lambda x: length(x) >= {cfg.min_chars}) as cs,
                len(f.o) as n_full from folded),
      exploded as (select {key}, sec, sp, unnest(cs) as ctext, unnest(range(1, len(cs) + 1)) as cp from parts)
      select {key}, sec, ctext, row_number() over (partition by {key} order by sp, cp) - 1 as chunk_index from exploded
    """


def sql_law_mode(source: str, key: str, text: str) -> str:
    """``key, law`` - most frequent law name per text, the earliest on ties. White space is doubled so
    that each match can consume one on both sides, which stands for the look-around."""
    doubled = sql_sub(text, f"({K.S})", r"\1\1")
    regex = rf"(?m)(?:^|{K.S})(?:구{K.S}+)?({K.LAW_NAME_BODY}){K.LAW_NAME_PAREN}(?:{K.S}|$)"
    bad = " or ".join(f"ends_with(n, {q(s)})" for s in K.NOT_LAW_SUFFIXES)
    names = ", ".join(q(n) for n in K.NOT_LAW_NAMES)
    return f"""
      select {key}, arg_max(n, (c, -p)) as law from (
        select {key}, n, count(*) as c, min(p) as p from (
          select {key}, {sql_sub('trim(m)', f'({K.S}){K.S}', chr(92) + '1')} as n, p from (
            select {key}, unnest(ms) as m, unnest(range(1, len(ms) + 1)) as p
            from (select {key}, regexp_extract_all({doubled}, {q(regex)}, 1) as ms from ({source})) as z) as y) as x
        where n <> '' and n not in ({names}) and not ({bad}) group by {key}, n) as w
      group by {key}
    """


@register("sections", "doc_id long, pos long, section str", f"""
    select doc_id, unnest(ss) as section, unnest(range(0, len(ss))) as pos
    from (select doc_id, {sql_sections('ktext')} as ss from ({KDOCS})) as s""")
def sections(spark, sf):
    return explode_positions(kdocs(spark, sf), ["doc_id"], C.split_sections(F.col("ktext")), "pos", "section")


@register("sentences", "doc_id long, pos long, sentence str", f"""
    select doc_id, unnest(ss) as sentence, unnest(range(0, len(ss))) as pos
    from (select doc_id, {sql_sentences('text')} as ss from documents) as s""")
def sentences(spark, sf):
    docs = table(spark, sf, "documents")
    return explode_positions(docs, ["doc_id"], C.split_sentences(F.col("text")), "pos", "sentence")


@register("chunks", "doc_id long, chunk_index long, text str, char_count long", f"""
    select doc_id, chunk_index, ctext as text, length(ctext) as char_count
    from ({sql_chunks('select doc_id, text from documents', 'doc_id', 'text', INSPECT, False)}) as c""")
def chunks(spark, sf):
    return index.chunk_documents(table(spark, sf, "documents"), INSPECT, detect=False)


CHUNKED = sql_chunks(f"select doc_id, ktext from ({KDOCS}) as kd", "doc_id", "ktext", ChunkConfig(), True)
DOC_LAW = sql_law_mode(KDOCS, "doc_id", "ktext")
CHUNK_ROWS = f"""
    select c.doc_id, chunk_index, ctext as text, coalesce(law, '') as law_name,
      case when {sql_header('sec')} = '' then '' else trim(concat(coalesce(law, ''), ' ', {sql_header('sec')})) end as article,
      length(ctext) as char_count
    from ({CHUNKED}) as c left join ({DOC_LAW}) as l on l.doc_id = c.doc_id"""


@register("chunk_documents",
          "doc_id long, chunk_index long, text str, law_name str, article str, char_count long", CHUNK_ROWS)
def chunk_documents(spark, sf):
    return index.chunk_documents(kdocs(spark, sf), text="ktext")


@register("law_mode", "doc_id long, law str",
          f"select d.doc_id, coalesce(law, '') as law from documents as d left join ({DOC_LAW}) as l on l.doc_id = d.doc_id")
def law_mode(spark, sf):
    from ..functions.citations import law_mode as mode

    return kdocs(spark, sf).select("doc_id", mode(F.col("ktext")).alias("law"))


@register("article_header", "doc_id long, pos long, article str", f"""
    select doc_id, pos, {sql_header('section')} as article from (
      select doc_id, unnest(ss) as section, unnest(range(0, len(ss))) as pos
      from (select doc_id, {sql_sections('ktext')} as ss from ({KDOCS})) as s) as t""")
def article_header(spark, sf):
    from ..functions.citations import article_header as header

    return sections(spark, sf).select("doc_id", "pos", header(F.col("section")).alias("article"))


@register("chunk_stats",
          "doc_id long, total_chunks long, total_chars long, avg_chars dbl, min_chars long, max_chars long", f"""
    select d.doc_id, coalesce(n, 0) as total_chunks, coalesce(s, 0) as total_chars, coalesce(s / n, 0) as avg_chars,
      coalesce(lo, 0) as min_chars, coalesce(hi, 0) as max_chars
    from documents as d left join (select doc_id, count(*) as n, sum(char_count) as s, min(char_count) as lo,
      max(char_count) as hi from ({CHUNK_ROWS}) as c group by doc_id) as x on x.doc_id = d.doc_id""")
def chunk_stats(spark, sf):
    return index.chunk_stats(kdocs(spark, sf), text="ktext")


def sample_cte(n: int = K.SAMPLE_CHUNKS) -> str:
    front, middle = n * 4 // 10, n * 2 // 10
    back = n - front - middle
    start = f"greatest({front}, least(total // 2 - {middle // 2}, total - {back} - {middle}))"
    return f"""select * from (select doc_id, chunk_index, text, count(*) over (partition by doc_id) as total
      from ({{rows}}) as r) as s
      where total <= {n} or chunk_index < {front} or chunk_index >= total - {back}
        or (chunk_index >= {start} and chunk_index < {start} + {middle})"""


SAMPLED = sample_cte().format(rows=f"""select doc_id, chunk_index, ctext as text
    from ({sql_chunks('select doc_id, text from documents', 'doc_id', 'text', INSPECT, False)}) as c""")


def _sampled(spark, sf):
    cut = C.chunk_array(F.col("text"), INSPECT, False)
    numbered = F.transform(cut, lambda c, i: F.struct(i.alias("chunk_index"), c["text"].alias("text")))
    return table(spark, sf, "documents").select("doc_id", C.sample_array(numbered).alias("sample"))


@register("sample_chunks", "doc_id long, chunk_index long, text str",
          f"select doc_id, chunk_index, text from ({SAMPLED}) as z")
def sample_chunks(spark, sf):
    rows = explode_positions(_sampled(spark, sf), ["doc_id"], F.col("sample"), "pos", "c")
    return rows.select("doc_id", "c.*")


@register("sample_text", "doc_id long, sample str", f"""
    select d.doc_id, coalesce(sample, '') as sample from documents as d left join (
      select doc_id, string_agg(part, chr(10) || chr(10) order by chunk_index) as sample from (
        select doc_id, chunk_index, part, sum(length(part)) over (partition by doc_id order by chunk_index) as run
        from (select *, concat('[청크 ', chunk_index, ']', chr(10), text) as part from ({SAMPLED}) as z) as p) as r
      where run <= {K.SAMPLE_TEXT_CHARS} group by doc_id) as x on x.doc_id = d.doc_id""")
def sample_text(spark, sf):
    return _sampled(spark, sf).select("doc_id", C.sample_text(F.col("sample")).alias("sample"))


@register("chunk_preview", "doc_id long, chunk_index long, char_count long, law_name str, article str, head str", f"""
    select doc_id, chunk_index, char_count, case when law_name = '' then '미추출' else law_name end as law_name,
      case when article = '' then '미추출' else article end as article,
      case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as head from ({CHUNK_ROWS}) as c""")
def chunk_preview(spark, sf):
    rows = chunk_documents(spark, sf)
    shown = lambda c: F.when(F.col(c) == "", "미추출").otherwise(F.col(c))
    head = F.when(F.length("text") > 100, F.concat(preview("text", 100), F.lit("..."))).otherwise(F.col("text"))
    return rows.select(
        "doc_id", "chunk_index", "char_count", shown("law_name").alias("law_name"),
        shown("article").alias("article"), head.alias("head"),
    )


@register("dedup_exact", "doc_id long, text_hash str, n_chars long", f"""
    select min(doc_id) as doc_id, h as text_hash, arg_min(n_chars, doc_id) as n_chars
    from (select doc_id, n_chars, {sql_hash('text')} as h from documents) as d group by h""")
def dedup_exact(spark, sf):
    kept = index.dedup_exact(table(spark, sf, "documents"))
    return kept.select("doc_id", text_hash("text").alias("text_hash"), "n_chars")
