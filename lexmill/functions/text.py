"""Scalar text, date, id and JSON functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    """Trim every Unicode white-space character, not only U+0020."""
    return F.btrim(_col(c), F.lit(K.WS_CHARS))


def drop_space(c) -> Column:
    return F.regexp_replace(_col(c), f"{K.S}+", "")


def squeeze(c) -> Column:
    return F.regexp_replace(_col(c), f"{K.S}+", " ")


def blank_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(""))


def first_filled(*cols) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c) -> Column:
    """NFKC form. Only texts holding a character it could change travel to Python."""
    c = _col(c)
    stable = c.rlike(K.NFKC_STABLE)
    return F.coalesce(_nfkc(F.when(~stable, c)), c)


def remove_patterns(c) -> Column:
    """Delete annex, form, enforcement, law-number, table and figure marks; squeeze spaces.

    One scan finds out whether a text has any mark; only then the deletions run in turn.
    """

    def deleted(text):
        for pattern in K.CLEAN_PATTERNS:
            text = F.regexp_replace(text, pattern, "")
        return text

    marked = rf"(?=[\[<]){any_of(K.CLEAN_PATTERNS)}"
    plain = let(_col(c), lambda t: F.when(t.rlike(marked), deleted(t)).otherwise(t))
    return strip(squeeze(plain))


def clean_text(c) -> Column:
    return remove_patterns(nfkc(F.coalesce(_col(c), F.lit(""))))


def transliterate(c, chars: Mapping[str, str] = {}, words: Mapping[str, str] = {}) -> Column:
    """Hanja to hangul from a caller's dictionary: words first, longest first, then characters."""
    c = _col(c)
    for word in sorted(words, key=lambda w: (-len(w), w)):
        c = F.replace(c, F.lit(word), F.lit(words[word]))
    if chars:
        c = F.translate(c, "".join(chars), "".join(chars.values()))
    return c


def strip_controls(c) -> Column:
    c = F.regexp_replace(_col(c), K.CONTROL_CLASS, "")
    c = F.regexp_replace(c, K.SPACE_LIKE_CLASS, " ")
    return F.regexp_replace(c, K.BULLET_CLASS, "")


def clean_chunk_text(c, chars: Mapping[str, str] = {}, words: Mapping[str, str] = {}) -> Column:
    return transliterate(strip_controls(nfkc(c)), chars, words)


def zfill(c, width: int = 6) -> Column:
    c = _col(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def format_date(c) -> Column:
    c = strip(c)
    dashed = F.regexp_replace(c, f"^({K.D}{{4}})({K.D}{{2}})({K.D}{{2}})$", "$1-$2-$3")
    return dashed


def parse_law_date(c) -> Column:
    """ISO date text to a timestamp; blank or malformed text gives NULL."""
    return F.try_to_timestamp(strip(c), F.lit("yyyy-M-d"))


def _iso(window: Column, pattern: str) -> Column:
    parts = [F.regexp_extract(window, pattern, g) for g in (1, 2, 3)]
    iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(window.rlike(pattern), iso)


def _first_date(window: Column) -> Column:
    return let(window, lambda w: F.coalesce(*[_iso(w, p) for p in K.DATE_PATTERNS]))


def revised_date(c, head: int | None = None) -> Column:
    """First date near a revision keyword, else the first one of the text (of its first ``head`` characters, if given).

    The look-ahead tests the keyword before the look-behind gathers what precedes it,
    so positions without a keyword cost one comparison.
    """
    c = _col(c)
    near = (
        rf"(?is)(?={K.REVISION_LEADS})(?={K.REVISION_KEYWORDS})"
        rf"(?<=(^.{{0,{K.KEYWORD_BEFORE - 1}}}|.{{{K.KEYWORD_BEFORE}}}))"
        rf"(?=({K.REVISION_KEYWORDS}.{{0,{K.KEYWORD_AFTER}}}))"
    )
    before = F.regexp_extract_all(c, F.lit(near), F.lit(1))
    after = F.regexp_extract_all(c, F.lit(near), F.lit(2))
    found = F.zip_with(before, after, lambda b, a: _first_date(F.concat(b, a)))
    first = F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))
    return F.coalesce(first, _first_date(F.substring(c, 1, head) if head else c))


def safe_str(c, strict: bool = False) -> Column:
    """NULL and the word "none" become empty. ``strict`` also blanks its substrings."""
    s = strip(F.coalesce(_col(c).cast("string"), F.lit("")))
    low = F.lower(s)
    hit = F.instr(F.lit("none"), low) > 0 if strict else low == "none"
    return F.when(hit, F.lit("")).otherwise(s)


def extract_meta(record: Mapping[str, Column], strict: bool = False) -> dict[str, Column]:
    """Indexing metadata of a corpus record given as named columns (absent ones are NULL)."""
    get = lambda name: safe_str(record.get(name, F.lit(None).cast("string")), strict)
    return {
        "article": get("article"),
        "law_name": get("law_name"),
        "text": get("source_text"),
        "law_date": first_filled(*map(get, ("effectDate", "finalDate", "interpreDate", "law_date"))),
        "category": first_filled(get("agenda"), get("category")),
    }


def title_class(title, sm_class) -> Column:
    return strip(F.concat_ws(" ", blank_to_null(title), blank_to_null(sm_class)))


def compose_law_and_article(title, sm_class, parsed_law, parsed_art, docu_type) -> tuple[Column, Column]:
    """Law name and article of a corpus record from its label and its parsed citations."""
    cited = _col(docu_type).isin(*K.CITED_TYPES)
    has_law = cited & (F.coalesce(_col(parsed_law), F.lit("")) != "")
    law = F.when(has_law, _col(parsed_law)).otherwise(F.coalesce(_col(title), F.lit("")))
    art = F.when(has_law, first_filled(parsed_art, sm_class)).otherwise(title_class(title, sm_class))
    return law, art


def article_key(law_name, chunk_law, category, article) -> Column:
    name = F.coalesce(
        blank_to_null(law_name), blank_to_null(chunk_law), F.concat(_col(category), F.lit("법"))
    )
    return F.concat_ws(" ", name, blank_to_null(article))


def detect_doc_type(name) -> Column:
    name = _col(name)
    ext = F.lower(F.substring_index(name, ".", -1))
    return F.when((F.instr(name, ".") > 0) & ext.isin(*K.DOC_TYPES), ext).otherwise("unknown")


def base_name(name) -> Column:
    return F.substring_index(_col(name), "/", -1)


def file_type(name) -> Column:
    """Stored file kind, NULL when the extension is not accepted. Leading dots are no extension."""
    ext = F.lower(F.regexp_extract(base_name(name), r"^\.*[^.].*(\.[^.]*)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in K.FILE_TYPES.items() for x in pair])
    return F.try_element_at(kinds, ext)


def excerpt(c, n: int = K.EXCERPT_CHARS) -> Column:
    c = _col(c)
    head = strip(F.translate(F.substring(c, 1, n), "\n", " "))
    return F.when(F.length(c) > n, F.concat(head, F.lit("..."))).otherwise(head)


def preview(c, n: int = K.PREVIEW_CHARS) -> Column:
    return F.substring(_col(c), 1, n)


def chat_title(c) -> Column:
    return F.substring(strip(c), 1, K.TITLE_CHARS)


def default_title(title, file_name) -> Column:
    title = _col(title)
    return F.when(title.isNull() | title.isin(*K.PLACEHOLDER_TITLES), _col(file_name)).otherwise(title)


def strip_commas(c) -> Column:
    return F.replace(_col(c), F.lit(","), F.lit(""))


def choose_summary(second, first) -> Column:
    second, first = _col(second), _col(first)
    worse = F.coalesce(second, F.lit("")).eqNullSafe("") | (F.length(second) < F.length(first))
    return F.when(worse, first).otherwise(second)


def text_hash(c) -> Column:
    return F.md5(strip(c))


def to_uuid(c) -> Column:
    """Canonical 36-character id, NULL when malformed. Bare, braced and urn forms are accepted."""
    bare = F.regexp_replace(F.lower(_col(c)), r"urn:|uuid:", "")
    bare = F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit(""))
    dashed = F.regexp_replace(
        bare, "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5"
    )
    return F.when(bare.rlike("^[0-9a-f]{32}$"), dashed)


def parse_analysis(raw) -> tuple[Column, Column]:
    """(category, summary) of a model reply: fenced, bare or broken JSON."""
    body = F.regexp_replace(_col(raw), "```(?:json)?", "")
    body = strip(F.rtrim(strip(body), F.lit("`")))
    doc = F.try_parse_json(body)
    # the parser stops after the first value, so text around it is ruled out here
    parsed = doc.isNotNull() & body.startswith("{") & body.endswith("}")
    text = lambda path: F.try_variant_get(doc, path, "string")
    items = F.try_variant_get(doc, "$.summary", "array<string>")
    closed = F.regexp_extract(body, r'"summary"\s*:\s*"([\s\S]+?)"\s*\}', 1)
    opened = F.regexp_extract(body, r'"summary"\s*:\s*"([\s\S]+)', 1)
    broken_category = F.regexp_extract(body, r'"category"\s*:\s*"([^"]+)"', 1)
    category = F.when(parsed, text("$.category")).otherwise(broken_category)
    summary = F.when(
        parsed, F.coalesce(F.array_join(items, "\n"), text("$.summary"), F.lit(""))
    ).otherwise(first_filled(closed, opened))
    known = F.when(category.isin(*K.CATEGORIES), category).otherwise(K.DEFAULT_CATEGORY)
    return known, summary


def is_valid_label(output, info_size) -> Column:
    return (F.length(strip(F.coalesce(_col(output), F.lit("")))) >= K.MIN_LABEL_CHARS) & (
        F.coalesce(_col(info_size), F.lit(0)) > 0
    )


def is_indexable(article, text) -> Column:
    return (F.coalesce(_col(article), F.lit("")) != "") & has_min_text(text)


def has_min_text(text) -> Column:
    return F.length(strip(F.coalesce(_col(text), F.lit("")))) >= K.MIN_TEXT_CHARS


def any_of(words: Sequence[str]) -> str:
    return "(?:" + "|".join(words) + ")"


@F.pandas_udf(T.StringType())
def _legacy_korean(contents: pd.Series) -> pd.Series:
    def decode(raw):
        for encoding in ("cp949", "euc-kr"):
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                continue
        return None

    return contents.map(lambda raw: None if raw is None else decode(bytes(raw)))


def decode_text(content) -> Column:
    """UTF-8 on the JVM; only bytes that are not UTF-8 travel to Python. NULL when undecodable."""
    content = _col(content)
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, F.decode(content, "UTF-8")).otherwise(_legacy_korean(F.when(~utf8, content)))
