"""Texts to citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C, constants as K
from ..operators.rows import explode_positions
from .base import q, register, sql_drop_space, sql_in, sql_strip, sql_sub
from .fixtures import KDOCS, kdocs


def any_of(words):
    return "(?:" + "|".join(words) + ")"


def sql_articles(source: str, head: int | None = None) -> str:
    """``doc_id, pos, between, art`` over ``source(doc_id, t)``."""
    sample = sql_strip(f"substr(t, 1, {head})" if head else "t")
    return f"""
      select doc_id, pos, {sql_strip('b')} as between_text, {sql_drop_space('a')} as art from (
        select doc_id, unnest(arts) as a, unnest(list_slice(pieces, 1, len(arts))) as b, unnest(range(0, len(arts))) as pos
        from (select doc_id, regexp_extract_all(s, {q(K.ARTICLE)}) as arts, string_split_regex(s, {q(K.ARTICLE)}) as pieces
              from (select doc_id, {sample} as s from ({source}) as src) as smp) as p) as z"""


def sql_law_before(source: str) -> str:
    """Adds ``cand`` to rows holding ``between_text``."""
    step1 = sql_sub("between_text", K.PARENTHESES, "")
    step2 = sql_strip(sql_sub("c1", f"{K.EDGE_JUNK}$", ""))
    step3 = sql_strip(sql_sub("c2", f"^{K.EDGE_JUNK}", ""))
    stop = ", ".join(q(w) for w in K.LAW_STOP_WORDS)
    ext = lambda p: sql_strip(f"regexp_extract(c3, {q(p)}, 1)")
    usable = lambda p: f"case when {ext(p)} <> '' and {ext(p)} not in ({stop}) then {ext(p)} end"
    return f"""
      select *, case when regexp_matches(c3, {q(K.BRACKETED_LAW)}) then {ext(K.BRACKETED_LAW)}
        else coalesce({usable(K.COMPOUND_LAW)}, {usable(K.WORD_LAW)}, '') end as cand
      from (select *, {step3} as c3 from (select *, {step2} as c2 from (select *, {step1} as c1 from ({source}) as s1) as s2) as s3) as s4"""


def sql_valid(law: str) -> str:
    return (
        f"({law} <> '' and not regexp_matches({law}, {q(K.SUBUNIT_ONLY)}) "
        f"and not regexp_matches({law}, {q(any_of(K.INVALID_LAW_KEYWORDS))}))"
    )


def sql_pairs(source: str, head: int | None = None) -> str:
    cand = sql_law_before(sql_articles(source, head))
    return f"select doc_id, pos, art, case when {sql_valid('cand')} then cand else '' end as law from ({cand}) as c"


def sql_unnamed(law: str, words) -> str:
    return f"({law} = '' or {sql_in(law, words)} or starts_with({law}, '제') or regexp_matches({law}, {q(K.INCOMPLETE_LAW)}))"


def sql_inherited(source: str, head: int | None = None) -> str:
    suffix = sql_in("law", K.SUFFIX_LAWS)
    bare = f"({sql_in('law', K.STANDALONE_LAWS)} or {sql_unnamed('law', K.INCOMPLETE_WORDS)})"
    main = f"not {suffix} and not {bare} and not regexp_matches(law, {q(any_of(K.SUBORDINATE_MARKS))})"
    return f"""
      select doc_id, pos, art, case when m <> '' and {suffix} then concat(m, ' ', trim(replace(law, '동법', '')))
        when m <> '' and {bare} then m else law end as law
      from (select *, coalesce(last_value(case when {main} then law end ignore nulls) over (
              partition by doc_id order by pos rows between unbounded preceding and 1 preceding), '') as m
            from ({sql_pairs(source, head)}) as p) as w"""


def sql_filtered(source: str, head: int | None = None) -> str:
    bare = sql_unnamed("law", K.BARE_CITATION_WORDS)
    return f"""
      select doc_id, pos, art, law, bare, case when bare then art else concat(law, ' ', art) end as cit
      from (select *, {bare} as bare, bool_or(not {bare}) over (partition by doc_id) as has_full
            from ({sql_inherited(source, head)}) as i) as f
      where not (has_full and bare)"""


def sql_metadata(source: str, head: int | None = None) -> str:
    base = sql_filtered(source, head)
    return f"""
      select ids.doc_id, coalesce(laws, '') as laws, coalesce(cits, '') as cits from (select doc_id from ({source}) as s) as ids
      left join (select doc_id, string_agg(law, ', ' order by p) as laws from (
        select doc_id, law, min(pos) as p from ({base}) as b where not bare group by doc_id, law) as x group by doc_id) as l
        on l.doc_id = ids.doc_id
      left join (select doc_id, string_agg(cit, ', ' order by p) as cits from (
        select doc_id, cit, min(pos) as p from ({base}) as b group by doc_id, cit) as x group by doc_id) as c
        on c.doc_id = ids.doc_id"""


def sql_post_clean(source: str, strict: bool = False) -> str:
    """``doc_id, cleaned`` over ``source(doc_id, joined)``."""
    lead = sql_strip(f"regexp_extract(item, {q(K.LEADING_CITATION)}, 1)")
    pointer = any_of(K.POINTER_WORDS)
    name = (
        f"regexp_extract(item, {q(f'^[^{K.WS_CLASS}]+')})" if strict
        else sql_strip(sql_sub("item", f"{K.S}제{K.D}+조(?:의{K.D}+)?$", ""))
    )
    return f"""
      select s.doc_id, coalesce(cleaned, '') as cleaned from ({source}) as s left join (
        select doc_id, string_agg(item, ', ' order by p) as cleaned from (
          select doc_id, item, min(pos) as p from (
            select doc_id, pos, case when regexp_matches(item, {q(pointer)}) then nullif({lead}, '') else item end as item
            from (select doc_id, {sql_strip('raw')} as item, pos from (
              select doc_id, unnest(xs) as raw, unnest(range(0, len(xs))) as pos
              from (select doc_id, string_split(coalesce(joined, ''), ',') as xs from ({source}) as a) as b) as c) as d) as e
          where item is not null and item <> ''
            and (regexp_matches({name}, {q(K.VALID_LAW_SUFFIX)}) or regexp_matches(item, {q(K.ARTICLE_START)}))
          group by doc_id, item) as f group by doc_id) as g on g.doc_id = s.doc_id"""


KT = f"select doc_id, ktext as t from ({KDOCS}) as kd"


@register("cit_articles", "doc_id long, pos long, between_text str, art str", sql_articles(KT))
def cit_articles(spark, sf):
    rows = explode_positions(kdocs(spark, sf), ["doc_id"], C.find_articles(F.col("ktext")), "pos", "x")
    return rows.select("doc_id", "pos", F.col("x.between").alias("between_text"), "x.art")


@register("cit_law", "doc_id long, pos long, cand str, art str", sql_law_before(sql_articles(KT)))
def cit_law(spark, sf):
    return cit_articles(spark, sf).withColumn("cand", C.law_before(F.col("between_text")))


@register("cit_valid", "doc_id long, pos long, law str, art str", sql_pairs(KT))
def cit_valid(spark, sf):
    pairs = C.law_article_pairs(F.col("ktext"))
    return explode_positions(kdocs(spark, sf), ["doc_id"], pairs, "pos", "x").select("doc_id", "pos", "x.law", "x.art")


@register("cit_inherit", "doc_id long, pos long, law str, art str", sql_inherited(KT))
def cit_inherit(spark, sf):
    pairs = C.inherit_law(C.law_article_pairs(F.col("ktext")))
    return explode_positions(kdocs(spark, sf), ["doc_id"], pairs, "pos", "x").select("doc_id", "pos", "x.law", "x.art")


@register("cit_filter", "doc_id long, cit str, pos long", f"""
    select doc_id, cit, row_number() over (partition by doc_id order by p) - 1 as pos from (
      select doc_id, cit, min(pos) as p from ({sql_filtered(KT)}) as b group by doc_id, cit) as x""")
def cit_filter(spark, sf):
    kept = C.filter_citations(C.inherit_law(C.law_article_pairs(F.col("ktext"))))
    return explode_positions(kdocs(spark, sf), ["doc_id"], kept["citations"], "pos", "cit")


@register("cit_metadata", "doc_id long, laws str, cits str", sql_metadata(KT))
def cit_metadata(spark, sf):
    found = kdocs(spark, sf).select("doc_id", C.legal_metadata(F.col("ktext")).alias("m"))
    return found.select("doc_id", "m.laws", F.col("m.citations").alias("cits"))


# items from the citation list of each document, some with a pointer word before or after them
JOINED = (
    "concat(cits, ', 위 각 조항 전단 제', cast(doc_id % 50 as string), '조, 형법 제', cast(doc_id % 90 as string), "
    "'조에 따라, ', laws, ', 개인정보 보호법 제3조,, 제9조의2, 기타')"
)
JOINED_SQL = f"select doc_id, {JOINED} as joined from ({sql_metadata(KT)}) as md"


@register("cit_post", "doc_id long, cleaned str, cleaned_strict str", f"""
    select a.doc_id, a.cleaned, b.cleaned as cleaned_strict from ({sql_post_clean(JOINED_SQL)}) as a
    join ({sql_post_clean(JOINED_SQL, True)}) as b on a.doc_id = b.doc_id""")
def cit_post(spark, sf):
    rows = cit_metadata(spark, sf).withColumn("joined", F.expr(JOINED))
    return rows.select("doc_id", C.post_clean(F.col("joined")).alias("cleaned"),
                       C.post_clean(F.col("joined"), strict=True).alias("cleaned_strict"))


REFS = f"""select doc_id, ref, min(pos) as p, k from (
      select doc_id, ref, pos, {sql_drop_space('ref')} as k from (
        select doc_id, unnest(rs) as ref, unnest(range(0, len(rs))) as pos
        from (select doc_id, regexp_extract_all(t, {q(K.LAW_REF)}) as rs from ({KT}) as a) as b) as c) as d
    group by doc_id, ref, k"""


@register("law_refs", "doc_id long, pos long, ref str", f"""
    select doc_id, arg_min(ref, p) as ref, row_number() over (partition by doc_id order by min(p)) - 1 as pos
    from ({REFS}) as r group by doc_id, k""")
def law_refs(spark, sf):
    return explode_positions(kdocs(spark, sf), ["doc_id"], C.law_refs(F.col("ktext")), "pos", "ref")


@register("ordered_distinct", "doc_id long, refs str", f"""
    select d.doc_id, coalesce(refs, '') as refs from documents as d left join (
      select doc_id, string_agg(ref, '|' order by p) as refs from (
        select doc_id, arg_min(ref, p) as ref, min(p) as p from ({REFS}) as r group by doc_id, k) as x group by doc_id) as y
    on y.doc_id = d.doc_id""")
def ordered_distinct(spark, sf):
    return kdocs(spark, sf).select("doc_id", F.array_join(C.law_refs(F.col("ktext")), "|").alias("refs"))
