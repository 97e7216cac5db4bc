"""Page blocks cut from web pages, with coordinates derived from their position."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators.rows import explode_positions
from .base import register, sql_drop_space, sql_strip, table

# a page's pieces between tags are its blocks: four to a line, lines 50 apart, even ones native
BLOCKS = """
    select page_id // 10 as doc_id, page_id % 10 + 1 as page, pos, (pos * 37) % 601 as x0, (pos // 4) * 50 + (pos * 7) % 8 as y0,
      (pos * 37) % 601 + 20 + pos % 60 as x1, (pos // 4) * 50 + (pos * 7) % 8 + 10 + pos % 3 as y1,
      case when pos % 2 = 0 then 'native' else 'ocr' end as source, text from (
        select page_id, unnest(ps) as piece, unnest(range(0, len(ps))) as pos, regexp_extract(piece, '>(.*)$', 1, 's') as text
        from (select page_id, string_split(html, '<') as ps from pages) as a) as b"""
NATIVE = f"select * from ({BLOCKS}) as n where source = 'native'"
OCR = f"select * from ({BLOCKS}) as o where source = 'ocr'"
KEY = sql_drop_space("lower(text)")
KEPT = f"select * from ({OCR}) as o where (doc_id, page, {KEY}) not in (select (doc_id, page, {KEY}) from ({NATIVE}) as n)"
MERGED = f"select * from ({NATIVE}) as n union all select * from ({KEPT}) as k"
ORDERED = f"""select *, row_number() over (partition by doc_id, page order by y0 // 50, x0, y0, case source when 'native' then 0 else 1 end, pos) as place
    from ({MERGED}) as m"""
PAGE_TEXT = f"""select doc_id, page, coalesce(string_agg(t, ' ' order by place) filter (t <> ''), '') as page_text
    from (select *, {sql_strip('text')} as t from ({ORDERED}) as o) as p group by doc_id, page"""


def page_blocks(spark, sf):
    pieces = explode_positions(table(spark, sf, "pages"), ["page_id"], F.split("html", "<"), "pos", "piece")
    i = F.col("pos")
    x0, y0 = (i * 37) % 601, F.floor(i / 4) * 50 + (i * 7) % 8
    return pieces.select(
        F.floor(F.col("page_id") / 10).alias("doc_id"), (F.col("page_id") % 10 + 1).alias("page"), i.alias("pos"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 20 + i % 60).alias("x1"), (y0 + 10 + i % 3).alias("y1"),
        F.when(i % 2 == 0, "native").otherwise("ocr").alias("source"),
        F.regexp_extract("piece", "(?s)>(.*)$", 1).alias("text"))


BLOCK_COLUMNS = "doc_id long, page long, pos long, text str"


@register("region_filter", BLOCK_COLUMNS, f"select * from (select *, y1 + pos % 20 as yy from ({BLOCKS}) as b) as c where x1 - x0 >= 40 and yy - y0 >= 25")
def region_filter(spark, sf):
    return B.region_filter(page_blocks(spark, sf).withColumn("y1", F.col("y1") + F.col("pos") % 20))


@register("ocr_dedup", BLOCK_COLUMNS, KEPT)
def ocr_dedup(spark, sf):
    return B.drop_repeated(page_blocks(spark, sf)).filter("source = 'ocr'")


@register("reading_order", "doc_id long, page long, place long, source str, text str", ORDERED)
def reading_order(spark, sf):
    ordered = B.reading_order(page_blocks(spark, sf), unique=True)
    rows = explode_positions(ordered, ["doc_id", "page"], F.col("blocks"), "i", "b")
    return rows.select("doc_id", "page", (F.col("i") + 1).alias("place"), "b.source", "b.text")


@register("page_text", "doc_id long, page long, page_text str", PAGE_TEXT)
def page_text(spark, sf):
    return B.page_text(B.reading_order(page_blocks(spark, sf), unique=True))


@register("pages_to_doc", "doc_id long, text str", f"""
    select doc_id, string_agg(concat(chr(10), '--- ', page, ' Page ---', chr(10), replace(page_text, ',', '')), '' order by page) as text
    from ({PAGE_TEXT}) as p group by doc_id""")
def pages_to_doc(spark, sf):
    return B.document_text(page_text(spark, sf))
