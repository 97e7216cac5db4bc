"""SQL names for users of ``spark.sql``: native expressions, no Python in the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import constants as K


# Java patterns inside a raw SQL literal
def _trim(expr: str) -> str:
    return f"regexp_replace({expr}, r'^{K.S}+|{K.S}+$', '')"


def _packed(text: str) -> str:
    """The chunk texts of the SQL expression ``text``, which may stand inside a lambda."""
    trim = _trim
    sentences = f"filter(transform(split({trim(text)}, r'(?<={K.SENTENCE_ENDS}){K.S}+'), x -> {trim('x')}), x -> x <> '')"
    return f"""aggregate(
          CASE WHEN length({trim(text)}) <= max_chars THEN filter(array({trim(text)}), x -> x <> '') ELSE {sentences} END,
          named_struct('done', cast(array() AS ARRAY<STRING>), 'buf', ''),
          (a, x) -> CASE
            WHEN a.buf <> '' AND length(a.buf) + length(x) + 1 > max_chars THEN named_struct(
              'done', CASE WHEN length(a.buf) >= min_chars THEN array_append(a.done, {trim('a.buf')}) ELSE a.done END,
              'buf', CASE WHEN overlap_chars > 0 THEN concat(right(a.buf, overlap_chars), ' ', x) ELSE x END)
            ELSE named_struct('done', a.done, 'buf', CASE WHEN a.buf = '' THEN x ELSE concat(a.buf, ' ', x) END) END,
          a -> CASE WHEN length({trim('a.buf')}) >= min_chars AND {trim('a.buf')} <> ''
                    THEN array_append(a.done, {trim('a.buf')}) ELSE a.done END)"""


def register_sql(spark: SparkSession) -> None:
    """Create ``chunk_array(text, max_chars, overlap_chars, min_chars)``: an array of chunk texts.

    Call it in a subquery and explode its result there:
    ``SELECT doc_id, pos, col FROM (SELECT doc_id, chunk_array(text, 500, 50, 20) AS c FROM documents)
    LATERAL VIEW posexplode(c) x AS pos, col``
    """
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION chunk_array(t STRING, max_chars INT, overlap_chars INT, min_chars INT)
        RETURNS ARRAY<STRING> DETERMINISTIC RETURN {_packed('t')}""")


def register_table_functions(spark: SparkSession) -> None:
    """Create two table functions for lateral joins:

    ``chunks_of(text, max_chars, overlap_chars, min_chars)``: ``chunk_index, article, text`` of the chunks of a text that is cut
    at titled articles first; ``citations_of(text)``: ``pos, ref, law, article`` of its law references, one per
    spelling-free form, in the order of their first places.

    ``SELECT d.doc_id, c.* FROM documents d, LATERAL chunks_of(d.text, 800, 100, 50) c``
    """
    head, title, space = K.SECTION_HEAD, K.SECTION_TITLE, K.S
    sections = f"filter(transform(split(t, r'(?={head}{title})'), y -> {_trim('y')}), y -> y <> '')"
    header = f"regexp_replace(regexp_extract(y, r'^({head}){title}', 1), r'{space}+', '')"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION chunks_of(t STRING, max_chars INT, overlap_chars INT, min_chars INT)
        RETURNS TABLE (chunk_index INT, article STRING, text STRING)
        RETURN SELECT pos, c.article, c.text FROM (SELECT posexplode(flatten(transform({sections}, y -> transform(
            CASE WHEN length(y) > max_chars THEN {_packed('y')} WHEN length(y) >= min_chars THEN array(y)
              ELSE cast(array() AS ARRAY<STRING>) END,
            z -> named_struct('article', {header}, 'text', z))))) AS (pos, c))""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION citations_of(t STRING)
        RETURNS TABLE (pos INT, ref STRING, law STRING, article STRING)
        RETURN SELECT pos, r.ref, {_trim("regexp_extract(r.ref, r'^(.*)제[^제]*$', 1)")}, regexp_extract(r.ref, r'제[^제]*$', 0)
        FROM (SELECT posexplode(aggregate(
          array_sort(transform(regexp_extract_all(t, r'{K.LAW_REF}', 0),
            (r, i) -> named_struct('key', regexp_replace(r, r'{space}+', ''), 'at', i, 'ref', r))),
          named_struct('key', '', 'met', cast(array() AS ARRAY<STRUCT<at: INT, ref: STRING>>)),
          (a, x) -> CASE WHEN a.key = x.key THEN a
            ELSE named_struct('key', x.key, 'met', array_append(a.met, named_struct('at', x.at, 'ref', x.ref))) END,
          a -> array_sort(a.met))) AS (pos, r))""")
