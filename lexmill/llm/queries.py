"""The registered queries of this package, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, common, jaccard, licenses, line_crf, merkle, mixing, packing, prefix_bpe, quality, site_tree, token_files, topk, toxicity
from .training import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def wrap(build: Query) -> Query:
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return wrap


@query("op1_topk_search", """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as c from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, cast(list_sum([p[1] * p[2] for p in list_zip(q.c, v.c)]) as bigint) as score
  from v q join v on v.vec_id <> q.vec_id and len(v.c) = len(q.c) where q.vec_id % 20 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
""")
def op1(spark, sf_dir):
    vectors = common.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), topk.codes(F.col("embedding")).alias("codes")).filter("id is not null and codes is not null")
    return topk.search(vectors, vectors.filter("id % 20 = 0"), k=20)


@query("op2_license_scan")
def op2(spark, sf_dir):
    return licenses.summary(licenses.scan(common.table(spark, sf_dir, "documents"), containment=0.9))


@query("op3_source_mix")
def op3(spark, sf_dir):
    rows = mixing.plan(common.table(spark, sf_dir, "documents")).rows
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def with_fold(scores, folds: int, left_out: int):
    held = F.coalesce(fold(F.col("doc_id"), folds) == left_out, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), *[c for c in scores.columns if c != "doc_id"])


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return with_fold(toxicity.scored(docs, labels, folds=4, left_out=2), 4, 2)


@query("op5_quality")
def op5(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return with_fold(quality.score(docs, quality.train(docs, labels, folds=5, left_out=0)), 5, 0)


@query("op6_line_rules")
def op6(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return line_crf.rules(docs, line_crf.train(docs, labels, folds=5, left_out=0))


@query("op7_ngram_jaccard", r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as s from w
), g as (select doc_id, len(s) as n, unnest(s) as g from s),
c as (
  select a.doc_id as x, b.doc_id as y from g a join g b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by 1, 2, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r(x, y) as (select x, y from c union select r.x, c.y from r join c on r.y = c.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) as component_id
from s left join r on r.x = s.doc_id group by s.doc_id, s.s
""")
def op7(spark, sf_dir):
    return jaccard.join(common.table(spark, sf_dir, "documents"), n=3, percent=90)


@query("op8_packing")
def op8(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=2)


@query("op9_site_text")
def op9(spark, sf_dir):
    return site_tree.extract(common.table(spark, sf_dir, "pages"))


@query("op10_token_files")
def op10(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(
        docs, common.scratch(spark, "token-files"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(manifest)


@query("op11_prefix_bpe")
def op11(spark, sf_dir):
    import public_tokenizers

    return prefix_bpe.digests(
        common.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _field(column: str, shown: str | None = None) -> str:
    v = shown or f"cast({column} as varchar)"
    return f"case when {column} is null then '-' else strlen({v}) || ':' || {v} end"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))


@query("op12_merkle_manifest", f"""
with recursive c as (
  select doc_id as cid, list_reduce(list_prepend(cast(4294967295 as bigint), flatten([[cast(ascii(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]
    for x in string_split(cast(doc_id as varchar), '')])),
    lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) & 1 as odd
  from (select distinct doc_id from documents where doc_id is not null)
), l as (
  select d.doc_id, d.source, sha256({_LEAF} || {_field("text")}) as leaf,
    case when c.odd = 1 then sha256({_LEAF} || {_field("text", "replace(text, chr(10), '')")})
      else sha256({_LEAF} || {_field("text")}) end as changed
  from documents d left join c on c.cid = d.doc_id
), p as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, dense_rank() over (order by source nulls first) - 1 as s from l
), t(s, level, pos, value) as (
  select s, 0, pos, leaf from p
  union all
  select s, level + 1, pos // 3, sha256(string_agg(value, '' order by pos)) from (select *, count(*) over (partition by s) as n from t) where n > 1
  group by s, level, pos // 3
), top as (select s, level, value from (select *, row_number() over (partition by s order by level desc) as r from t) where r = 1
), u(level, pos, value) as (
  select 0, s, value from top
  union all
  select level + 1, pos // 3, sha256(string_agg(value, '' order by pos)) from (select *, count(*) over () as n from u) where n > 1 group by level, pos // 3
), root as (select value, level from u order by level desc limit 1
), f(doc, s, level, pos, value, proof) as (
  select row_number() over (), s, 0, pos, changed, '' from p
  union all
  select f.doc, f.s, f.level + 1, f.pos // 3,
    sha256(coalesce(string_agg(t.value, '' order by t.pos) filter (t.pos < f.pos), '') || any_value(f.value)
      || coalesce(string_agg(t.value, '' order by t.pos) filter (t.pos > f.pos), '')),
    any_value(f.proof) || coalesce(string_agg(t.value, '' order by t.pos) filter (t.pos <> f.pos), '')
  from f join t on t.s = f.s and t.level = f.level and t.pos // 3 = f.pos // 3 join top on top.s = f.s where f.level < top.level
  group by f.doc, f.s, f.level, f.pos
), g(doc, level, pos, value, proof) as (
  select f.doc, 0, f.s, f.value, f.proof from f join top on top.s = f.s and top.level = f.level
  union all
  select g.doc, g.level + 1, g.pos // 3,
    sha256(coalesce(string_agg(u.value, '' order by u.pos) filter (u.pos < g.pos), '') || any_value(g.value)
      || coalesce(string_agg(u.value, '' order by u.pos) filter (u.pos > g.pos), '')),
    any_value(g.proof) || coalesce(string_agg(u.value, '' order by u.pos) filter (u.pos <> g.pos), '')
  from g join u on u.level = g.level and u.pos // 3 = g.pos // 3 where g.level < (select level from root)
  group by g.doc, g.level, g.pos
)
select p.doc_id, p.source, p.leaf, top.value as subroot, root.value as root, cast(strlen(g.proof) // 64 as bigint) as n_siblings,
  sha256(g.proof) as proof_sha256, g.value as folded_root, g.value = root.value as verified
from (select *, row_number() over () as doc from p) p join top on top.s = p.s cross join root join g on g.doc = p.doc and g.level = root.level
""")
def op12(spark, sf_dir):
    return merkle.manifest(common.table(spark, sf_dir, "documents"))


@query("op13_filter_audit", """
with recursive d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), lab as (select doc_id, max(quality) as q, max(toxic) as t from labels group by 1
), m as (
  select part, coalesce(lab.q = 1, false) as good, coalesce(lab.t = 1, false) as toxic,
    {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
     'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
     'E': coalesce(d.doc_id > min(d.doc_id) over (partition by text), false)} as fails
  from d left join lab on lab.doc_id = d.doc_id
), o(filter_order) as (
  select '' union all select filter_order || f from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) where not contains(filter_order, f) and length(filter_order) < 5
), k as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by 1, 2
), x as (
  select part, filter_order, n, good, toxic, fails,
    [case substr(filter_order, i, 1) when 'A' then fails.A when 'B' then fails.B when 'C' then fails.C when 'D' then fails.D else fails.E end for i in range(1, 6)] as hit
  from k, o where length(filter_order) = 5
), y as (select *, coalesce(list_position(hit, true), 99) as gone, len([1 for h in hit if h]) as n_hit from x
), r as (
  select part, filter_order, cast(step as integer) as step, substr(filter_order, cast(step as integer), 1) as f,
    sum(case when gone > step then n else 0 end) as kept, sum(case when gone = step then n else 0 end) as removed,
    sum(case when hit[step] and gone < step then n else 0 end) as redundant, sum(case when hit[step] and n_hit = 1 then n else 0 end) as unique_fails,
    sum(case when gone = step then good else 0 end) as good_lost, sum(case when gone = step then toxic else 0 end) as toxic_lost
  from y, (select unnest(range(1, 6)) as step) group by 1, 2, 3
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, f) as bigint) as shapley from r
""")
def op13(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return audit.audit(docs, labels)
