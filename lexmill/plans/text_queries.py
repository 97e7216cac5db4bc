"""Scalar functions and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, text as X
from ..operators import blocks, index, sessions
from .base import q, register, sql_in, sql_strip, sql_sub, table
from .fixtures import CATEGORY, FILE_NAME, LAW_DATE, LOGS, num


def docs(spark, sf):
    return table(spark, sf, "documents")


NOISY = (
    "concat(' [시행 2020. 1. 1.] [법률 제123호]', replace(replace(text, ', ', concat(' [별지 제', "
    f"{num('doc_id')}, '호 서식],', chr(9))), '.', '.  [별표 3]<표 1> <그림 22>'), chr(10))"
)


def sql_clean(expr: str) -> str:
    for pattern in K.CLEAN_PATTERNS:
        expr = sql_sub(expr, pattern, "")
    return sql_strip(sql_sub(expr, f"{K.S}+", " "))


@register("clean_text", "doc_id long, cleaned str", f"select doc_id, {sql_clean(NOISY)} as cleaned from documents")
def clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", X.clean_text(F.expr(NOISY)).alias("cleaned"))


CONTROLS = "replace(replace(replace(text, '. ', concat('.', chr(160), '• ')), ', ', concat(chr(7), '—', chr(9))), ' de ', ' 法令 ')"
HANJA = {"法": "법", "令": "령", "國": "국"}


def sql_controls(expr: str) -> str:
    expr = sql_sub(expr, K.CONTROL_CLASS, "")
    expr = sql_sub(expr, K.SPACE_LIKE_CLASS, " ")
    return sql_sub(expr, K.BULLET_CLASS, "")


# NFKC turns a no-break space into a space before the other steps see it
@register("clean_chunk_text", "doc_id long, cleaned str", f"""
    select doc_id, translate({sql_controls(f"replace({CONTROLS}, chr(160), ' ')")}, {q(''.join(HANJA))}, {q(''.join(HANJA.values()))}) as cleaned
    from documents""")
def clean_chunk_text(spark, sf):
    return docs(spark, sf).select("doc_id", X.clean_chunk_text(F.expr(CONTROLS), HANJA).alias("cleaned"))


@register("translit", "doc_id long, hangul str", f"""
    select doc_id, translate(replace(replace(text, ' de ', ' 法令 '), '法令', '법규명령'), 'aeo', '아에오') as hangul from documents""")
def translit(spark, sf):
    marked = F.replace("text", F.lit(" de "), F.lit(" 法令 "))
    return docs(spark, sf).select(
        "doc_id", X.transliterate(marked, {"a": "아", "e": "에", "o": "오"}, {"法令": "법규명령"}).alias("hangul"))


@register("zfill", "doc_id long, a str, b str", """
    select doc_id, case when length(cast(doc_id as string)) < 6 then lpad(cast(doc_id as string), 6, '0') else cast(doc_id as string) end as a,
      cast(doc_id * 1234567 + 1000000 as string) as b from documents""")
def zfill(spark, sf):
    return docs(spark, sf).select(
        "doc_id", X.zfill(F.col("doc_id").cast("string")).alias("a"),
        X.zfill((F.col("doc_id") * 1234567 + 1000000).cast("string")).alias("b"))


DATE_TEXT = (
    "case doc_id % 4 when 0 then concat('  20', lpad(cast(doc_id % 30 as string), 2, '0'), '0', cast(doc_id % 9 + 1 as string), '17 ') "
    "when 1 then '2024-3-5' when 2 then concat(' ', cast(doc_id as string)) else '' end"
)


@register("format_date", "doc_id long, d str", f"""
    select doc_id, case when regexp_matches({sql_strip(DATE_TEXT)}, '^[0-9]{{8}}$') then concat(substr({sql_strip(DATE_TEXT)}, 1, 4), '-',
      substr({sql_strip(DATE_TEXT)}, 5, 2), '-', substr({sql_strip(DATE_TEXT)}, 7, 2)) else {sql_strip(DATE_TEXT)} end as d from documents""")
def format_date(spark, sf):
    return docs(spark, sf).select("doc_id", X.format_date(F.expr(DATE_TEXT)).alias("d"))


ISO_TEXT = (
    "case doc_id % 5 when 0 then concat(' 2024-', cast(doc_id % 14 as string), '-5 ') when 1 then '2023-02-30' "
    "when 2 then '2024-02-29' when 3 then '' else concat('20', lpad(cast(doc_id % 25 as string), 2, '0'), '-11-30') end"
)


@register("parse_law_date", "doc_id long, law_date str", f"""
    select doc_id, strftime(try_strptime({sql_strip(ISO_TEXT)}, '%Y-%m-%d'), '%Y-%m-%d') as law_date from documents""")
def parse_law_date(spark, sf):
    return docs(spark, sf).select("doc_id", F.date_format(X.parse_law_date(F.expr(ISO_TEXT)), "yyyy-MM-dd").alias("law_date"))


DATED = (
    f"replace(replace(replace(text, ' the ', concat(' 개정 ', {num('1990 + doc_id % 30')}, '. ', {num('doc_id % 12 + 1')}, '. 7. ')), "
    f"' de ', ' Amended '), '. E', concat('. 2021-0', {num('doc_id % 9 + 1')}, '-11 E'))"
)


def sql_first_date(window: str) -> str:
    def iso(p):
        g = [f"regexp_extract({window}, {q(p)}, {i})" for i in (1, 2, 3)]
        return f"case when regexp_matches({window}, {q(p)}) then concat({g[0]}, '-', lpad({g[1]}, 2, '0'), '-', lpad({g[2]}, 2, '0')) end"
    return "coalesce(" + ", ".join(iso(p) for p in K.DATE_PATTERNS) + ")"


KW = q("(?i)" + K.REVISION_KEYWORDS)


def sql_revised_date(source: str) -> str:
    """``doc_id, law_date`` over ``source(doc_id, t)``."""
    return f"""
    select d.doc_id, coalesce(near, {sql_first_date("d.t")}) as law_date
    from ({source}) as d left join (
      select doc_id, arg_min(found, i) as near from (
        select doc_id, i, {sql_first_date('w')} as found from (
          select doc_id, i, substr(t, cast(greatest(1, s + 1 - {K.KEYWORD_BEFORE}) as bigint), cast(least(s, {K.KEYWORD_BEFORE}) + length(m) + {K.KEYWORD_AFTER} as bigint)) as w
          from (select doc_id, t, m, i, sum(length(pc)) over (partition by doc_id order by i) + sum(length(m)) over (partition by doc_id order by i) - length(m) as s
                from (select doc_id, t, unnest(ms) as m, unnest(list_slice(ps, 1, len(ms))) as pc, unnest(range(0, len(ms))) as i
                      from (select doc_id, t, regexp_extract_all(t, {KW}) as ms, string_split_regex(t, {KW}) as ps
                            from ({source}) as a) as b) as c) as e) as f) as g
      where found is not null group by doc_id) as h on h.doc_id = d.doc_id"""


@register("revised_date", "doc_id long, law_date str", sql_revised_date(f"select doc_id, {DATED} as t from documents"))
def revised_date(spark, sf):
    return docs(spark, sf).select("doc_id", X.revised_date(F.expr(DATED)).alias("law_date"))


LOOSE = "case doc_id % 6 when 0 then ' None ' when 1 then 'no' when 2 then cast(null as string) when 3 then 'one' when 4 then '  ' else source end"


@register("safe_str", "doc_id long, loose str, strict str", f"""
    select doc_id, case when lower(s) = 'none' then '' else s end as loose,
      case when contains('none', lower(s)) then '' else s end as strict
    from (select doc_id, {sql_strip(f"coalesce({LOOSE}, '')")} as s from documents) as d""")
def safe_str(spark, sf):
    c = F.expr(LOOSE)
    return docs(spark, sf).select("doc_id", X.safe_str(c).alias("loose"), X.safe_str(c, strict=True).alias("strict"))


META = {
    "article": "case when doc_id % 3 = 0 then '' else concat('형법 제', cast(doc_id as string), '조') end",
    "law_name": "case when doc_id % 4 = 0 then 'None' else source end",
    "source_text": "text",
    "effectDate": "case when doc_id % 3 = 0 then '2020-01-02' end",
    "finalDate": "case when doc_id % 4 = 0 then '2021-01-02' else ' ' end",
    "interpreDate": "case when doc_id % 5 = 0 then '2022-01-02' end",
    "law_date": "case when doc_id % 7 = 0 then '2023-01-02' end",
    "agenda": "case when doc_id % 2 = 0 then lang end",
    "category": "source",
}


def sql_safe(expr: str) -> str:
    s = sql_strip(f"coalesce({expr}, '')")
    return f"case when lower({s}) = 'none' then '' else {s} end"


def sql_filled(*exprs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({e}, '')" for e in exprs) + ", '')"


@register("extract_meta", "doc_id long, article str, law_name str, text str, law_date str, category str", f"""
    select doc_id, {sql_safe(META['article'])} as article, {sql_safe(META['law_name'])} as law_name, {sql_safe(META['source_text'])} as text,
      {sql_filled(*[sql_safe(META[k]) for k in ('effectDate', 'finalDate', 'interpreDate', 'law_date')])} as law_date,
      {sql_filled(sql_safe(META['agenda']), sql_safe(META['category']))} as category from documents""")
def extract_meta(spark, sf):
    meta = X.extract_meta({k: F.expr(v) for k, v in META.items()})
    return docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in meta.items()])


TITLE = "case when doc_id % 3 = 0 then '' else source end"
CLASS = "case when doc_id % 5 = 0 then '' else lang end"
PARSED_LAW = "case when doc_id % 2 = 0 then '형법' else '' end"
PARSED_ART = "case when doc_id % 4 = 0 then '형법 제1조' else '' end"
DOCU = "case doc_id % 4 when 0 then '법령' when 1 then '판결문' when 2 then '결정례' else '해석례' end"
HAS_LAW = f"({DOCU} <> '법령' and {PARSED_LAW} <> '')"


@register("compose_article", "doc_id long, law_name str, article str", f"""
    select doc_id, case when {HAS_LAW} then {PARSED_LAW} else {TITLE} end as law_name,
      case when {HAS_LAW} then {sql_filled(PARSED_ART, CLASS)} else trim(concat({TITLE}, ' ', {CLASS})) end as article from documents""")
def compose_article(spark, sf):
    law, art = X.compose_law_and_article(*[F.expr(e) for e in (TITLE, CLASS, PARSED_LAW, PARSED_ART, DOCU)])
    return docs(spark, sf).select("doc_id", law.alias("law_name"), art.alias("article"))


@register("article_key", "doc_id long, k str", f"""
    select doc_id, trim(concat(coalesce(nullif({TITLE}, ''), nullif({PARSED_LAW}, ''), concat({CATEGORY}, '법')), ' ', {PARSED_ART})) as k
    from documents""")
def article_key(spark, sf):
    return docs(spark, sf).select("doc_id", X.article_key(
        *[F.expr(e) for e in (TITLE, PARSED_LAW, CATEGORY, PARSED_ART)]).alias("k"))


EXT = f"lower(regexp_extract({FILE_NAME}, '[.]([^.]*)$', 1))"


@register("doc_type", "doc_id long, kind str", f"""
    select doc_id, case when {sql_in(EXT, K.DOC_TYPES)} then {EXT} else 'unknown' end as kind from documents""")
def doc_type(spark, sf):
    return docs(spark, sf).select("doc_id", X.detect_doc_type(F.expr(FILE_NAME)).alias("kind"))


@register("file_type", "doc_id long, base str, kind str", f"""
    select doc_id, regexp_extract({FILE_NAME}, '[^/]*$') as base, case {' '.join(f"when {EXT} = {q(k[1:])} then {q(v)}" for k, v in K.FILE_TYPES.items())} end as kind
    from documents""")
def file_type(spark, sf):
    name = F.expr(FILE_NAME)
    return docs(spark, sf).select("doc_id", X.base_name(name).alias("base"), X.file_type(name).alias("kind"))


@register("excerpt", "doc_id long, head str, short str, title str", f"""
    select doc_id, case when length(text) > 120 then concat({sql_strip("translate(substr(text, 1, 120), chr(10), ' ')")}, '...')
        else {sql_strip("translate(text, chr(10), ' ')")} end as head, substr(text, 1, 60) as short,
      substr({sql_strip('text')}, 1, 20) as title from documents""")
def excerpt(spark, sf):
    return docs(spark, sf).select(
        "doc_id", X.excerpt("text").alias("head"), X.preview("text").alias("short"), X.chat_title("text").alias("title"))


BODY = "replace(replace(text, chr(10), ' '), chr(34), ' ')"
QUOTE = "chr(34)"
REPLY = (
    "case doc_id % 5 "
    f"when 0 then concat('{{', {QUOTE}, 'category', {QUOTE}, ': ', {QUOTE}, {CATEGORY}, {QUOTE}, ', ', {QUOTE}, 'summary', {QUOTE}, ': ', {QUOTE}, {BODY}, {QUOTE}, '}}') "
    f"when 1 then concat('```json', chr(10), '{{', {QUOTE}, 'category', {QUOTE}, ': ', {QUOTE}, 'other', {QUOTE}, ', ', {QUOTE}, 'summary', {QUOTE}, ': ', {QUOTE}, {BODY}, {QUOTE}, '}}', chr(10), '```') "
    f"when 2 then concat('{{', {QUOTE}, 'category', {QUOTE}, ': ', {QUOTE}, {CATEGORY}, {QUOTE}, ', ', {QUOTE}, 'summary', {QUOTE}, ': ', {QUOTE}, {BODY}) "
    f"when 3 then concat('{{', {QUOTE}, 'category', {QUOTE}, ': ', {QUOTE}, {CATEGORY}, {QUOTE}, ', ', {QUOTE}, 'summary', {QUOTE}, ': [', {QUOTE}, 'a', {QUOTE}, ', ', {QUOTE}, {BODY}, {QUOTE}, ']}}') "
    f"else concat('Sure: ', {QUOTE}, 'category', {QUOTE}, ' : ', {QUOTE}, {CATEGORY}, {QUOTE}, ', ', {QUOTE}, 'summary', {QUOTE}, ':', {QUOTE}, {BODY}, {QUOTE}, ' }} trailing') end"
)
CLEAN_REPLY = sql_strip(f"rtrim({sql_strip(sql_sub(REPLY, '```(?:json)?', ''))}, '`')")
CAT_RE, CLOSED_RE, OPEN_RE = (
    r'"category"\s*:\s*"([^"]+)"', r'"summary"\s*:\s*"([\s\S]+?)"\s*\}', r'"summary"\s*:\s*"([\s\S]+)'
)


@register("parse_analysis", "doc_id long, category str, summary str", f"""
    select doc_id, case when {sql_in('c', K.CATEGORIES)} then c else '기타' end as category, summary from (
      select doc_id, case when json_valid(b) then json_extract_string(b, '$.category') else regexp_extract(b, {q(CAT_RE)}, 1) end as c,
        case when json_valid(b) then case when json_type(b, '$.summary') = 'ARRAY'
            then array_to_string(cast(json_extract(b, '$.summary') as varchar[]), chr(10))
            else coalesce(json_extract_string(b, '$.summary'), '') end
          else coalesce(nullif(regexp_extract(b, {q(CLOSED_RE)}, 1), ''), regexp_extract(b, {q(OPEN_RE)}, 1)) end as summary
      from (select doc_id, {CLEAN_REPLY} as b from documents) as r) as p""")
def parse_analysis(spark, sf):
    category, summary = X.parse_analysis(F.col("reply"))
    replies = docs(spark, sf).select("doc_id", F.expr(REPLY).alias("reply"))
    return replies.select("doc_id", category.alias("category"), summary.alias("summary"))


UID = (
    "case doc_id % 4 when 0 then upper(md5(text)) when 1 then concat('{', substr(md5(text), 1, 8), '-', substr(md5(text), 9, 4), '-', "
    "substr(md5(text), 13, 4), '-', substr(md5(text), 17, 4), '-', substr(md5(text), 21), '}') when 2 then 'legacy_1' else substr(md5(text), 1, 31) end"
)


@register("to_uuid", "doc_id long, id str", """
    select doc_id, case when doc_id % 4 in (0, 1) then concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21)) end as id
    from (select doc_id, md5(text) as h from documents) as d""")
def to_uuid(spark, sf):
    return docs(spark, sf).select("doc_id", X.to_uuid(F.expr(UID)).alias("id"))


OLD_TITLE = "case doc_id % 5 when 0 then cast(null as string) when 1 then '' when 2 then '새 대화' when 3 then 'New Chat' else source end"


@register("default_title", "doc_id long, title str", f"""
    select doc_id, case when doc_id % 5 < 4 then {FILE_NAME} else source end as title from documents""")
def default_title(spark, sf):
    return docs(spark, sf).select("doc_id", X.default_title(F.expr(OLD_TITLE), F.expr(FILE_NAME)).alias("title"))


SECOND = "case doc_id % 3 when 0 then '' when 1 then text else lang end"


@register("choose_summary", "doc_id long, summary str", f"""
    select doc_id, case when {SECOND} = '' or length({SECOND}) < length(source) then source else {SECOND} end as summary from documents""")
def choose_summary(spark, sf):
    return docs(spark, sf).select("doc_id", X.choose_summary(F.expr(SECOND), F.col("source")).alias("summary"))


OUTPUT = "case when doc_id % 7 = 0 then '  ab ' else text end"


@register("valid_label", "doc_id long, output_chars long", f"""
    select doc_id, length({OUTPUT}) as output_chars from documents
    where length({sql_strip(OUTPUT)}) >= 5 and doc_id % 11 > 0""")
def valid_label(spark, sf):
    info = F.when(F.col("doc_id") % 11 > 0, F.create_map(F.lit("lawId"), F.col("doc_id").cast("string"))).otherwise(
        F.create_map().cast("map<string,string>"))
    rows = docs(spark, sf).select("doc_id", F.expr(OUTPUT).alias("output"), info.alias("info"))
    return rows.filter(X.is_valid_label("output", F.size("info"))).select("doc_id", F.length("output").alias("output_chars"))


@register("indexable", "doc_id long, n_chars long", f"""
    select doc_id, n_chars from documents where {META['article']} <> '' and length({sql_strip('text')}) >= 20""")
def indexable(spark, sf):
    return docs(spark, sf).filter(X.is_indexable(F.expr(META["article"]), "text")).select("doc_id", "n_chars")


@register("min_text", "doc_id long, n_chars long", f"select doc_id, n_chars from documents where length({sql_strip('text')}) >= 20")
def min_text(spark, sf):
    return docs(spark, sf).filter(X.has_min_text("text")).select("doc_id", "n_chars")


@register("category_gate", "doc_id long, category str, detect bool", f"""
    select doc_id, category, {sql_in('category', K.STRUCTURED_CATEGORIES)} as detect from (select doc_id, {CATEGORY} as category from documents) as d
    where {sql_in('category', K.STRUCTURED_CATEGORIES + K.UNSTRUCTURED_CATEGORIES)}""")
def category_gate(spark, sf):
    return sessions.category_gate(docs(spark, sf).select("doc_id", F.expr(CATEGORY).alias("category")))


@register("nonblank_turns", "conv_id long, turn long, chars long", f"""
    select conv_id, turn, length(t) as chars from (select conv_id, turn, case when turn % 3 = 2 then ' ' else text end as t from conversations) as c
    where {sql_strip('t')} <> ''""")
def nonblank_turns(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 2, " ").otherwise(F.col("text")).alias("t"))
    return sessions.nonblank(rows, "t").select("conv_id", "turn", F.length("t").alias("chars"))


@register("law_date_store", "doc_id long, law_date str", f"select doc_id, {LAW_DATE} as law_date from documents")
def law_date_store(spark, sf):
    return docs(spark, sf).select("doc_id", F.date_format(X.parse_law_date(F.expr(LAW_DATE)), "yyyy-MM-dd").alias("law_date"))
