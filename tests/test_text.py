import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import constants as K, text as X


@pytest.mark.parametrize("raw, want", [
    ("[별표 3]  형법 [별지 제2호 서식] 본문 [시행 2020. 1. 1.] [법률 제12호]<표 1><그림>", "형법 본문"),
    ("ﬁle　①\t x ", "file 1 x"),
    (None, ""),
    ("[별지[별표 1] 제1호 서식] 끝", "끝"),
])
def test_clean_text(one, raw, want):
    assert one(X.clean_text("t"), t=raw) == want


def test_chunk_cleaning(one):
    assert one(X.clean_chunk_text("t", {"法": "법"}), t="제1조\x07 法 •—■\tx") == "제1조 법  x"


def test_words_before_characters(one):
    got = one(X.transliterate("t", {"樂": "락", "音": "음"}, {"音樂": "음악"}), t="音樂 樂")
    assert got == "음악 락"


def test_strip_is_unicode(one):
    assert one(X.strip("t"), t="　 \x1c가 나\x85\n") == "가 나"


@pytest.mark.parametrize("raw, want", [("7", "000007"), ("123456", "123456"), ("1234567", "1234567")])
def test_zfill(one, raw, want):
    assert one(X.zfill("t"), t=raw) == want


@pytest.mark.parametrize("raw, want", [("20240105", "2024-01-05"), (" 2024-1-5 ", "2024-1-5"), ("202401051", "202401051")])
def test_format_date(one, raw, want):
    assert one(X.format_date("t"), t=raw) == want


@pytest.mark.parametrize("raw, want", [("2024-3-5", "2024-03-05"), ("2024-02-30", None), ("", None), (" 2024-02-29 ", "2024-02-29")])
def test_parse_law_date(one, raw, want):
    assert one(F.date_format(X.parse_law_date("t"), "yyyy-MM-dd"), t=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("서문 2001.1.1 " + "가" * 600 + " 개정 2024년 3월 15일", "2024-03-15"),
    ("1999-01-02 그리고 끝", "1999-01-02"),
    ("2020/05/06 " + "x" * 60 + "Amended 2021.7.8.", "2021-07-08"),
    ("개정 없음 " + "x" * 200 + " 시행 2022-09-09", "2022-09-09"),
    ("2018-01-01 개정 2019년1월2일", "2019-01-02"),
    ("x" * 510 + " 2011-11-11", "2011-11-11"),
])
def test_revised_date(one, raw, want):
    assert one(X.revised_date("t"), t=raw) == want


def test_revised_date_within_a_given_head(one):
    assert one(X.revised_date("t", head=500), t="x" * 510 + " 2011-11-11") is None


@pytest.mark.parametrize("raw, loose, strict", [("None", "", ""), ("no", "no", ""), (" one ", "one", ""), (None, "", ""), ("nones", "nones", "nones")])
def test_safe_str(one, raw, loose, strict):
    assert one(X.safe_str("t"), t=raw) == loose
    assert one(X.safe_str("t", strict=True), t=raw) == strict


@pytest.mark.parametrize("name, doc, kind", [
    ("a/b.C.PDF", "pdf", "PDF"), ("x.hwpx", "hwpx", "HWP"), (".pdf", "pdf", None), ("noext", "unknown", None), ("a.tar.gz", "unknown", None),
])
def test_file_kinds(one, name, doc, kind):
    assert one(X.detect_doc_type("t"), t=name) == doc
    assert one(X.file_type("t"), t=name) == kind


@pytest.mark.parametrize("raw, category, summary", [
    ('```json\n{"category": "기술문서", "summary": "가"}\n```', "기술문서", "가"),
    ('{"category": "기술문서", "summary": ["가", "나"]}', "기술문서", "가\n나"),
    ('{"category": "nope", "summary": "가"}', "기타", "가"),
    ('답: "category": "법령·규정", "summary": "가 } 나"} 끝', "법령·규정", "가 } 나"),
    ('"category": "법령·규정", "summary": "끝없는', "법령·규정", "끝없는"),
    ("nothing", "기타", ""),
    ('{"summary": "가"}', "기타", "가"),
])
def test_parse_analysis(one, raw, category, summary):
    c, s = X.parse_analysis(F.col("t"))
    assert one(c, t=raw) == category
    assert one(s, t=raw) == summary


def test_uuid_forms(one):
    plain = "0123456789ABCDEF0123456789abcdef"
    want = "01234567-89ab-cdef-0123-456789abcdef"
    for form in (plain, "{" + want + "}", "urn:uuid:" + want, want):
        assert one(X.to_uuid("t"), t=form) == want
    assert one(X.to_uuid("t"), t="legacy_1") is None


def test_decode_text(spark):
    rows = [("가나다".encode(),), ("가나다".encode("cp949"),), (b"\xff\xff\xff",), (b"plain",)]
    got = spark.createDataFrame(rows, "c binary").select(X.decode_text("c")).collect()
    assert [r[0] for r in got] == ["가나다", "가나다", None, "plain"]


def test_stable_class_is_stable():
    """Any text made of the characters that skip normalisation is its own NFKC form."""
    import regex

    stable = regex.compile("[" + regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U%08x" % int(m[1], 16), K.NFKC_STABLE_CLASS) + "]")
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and stable.match(chr(i))]
    assert all(unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0 for c in chars)
    text = "".join(chars)
    assert unicodedata.normalize("NFKC", text) == text
    assert unicodedata.normalize("NFKC", text[::-1]) == text[::-1]


def test_whitespace_constants_agree():
    import regex

    cls = regex.compile("[" + regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U%08x" % int(m[1], 16), K.WS_CLASS) + "]")
    found = {chr(i) for i in range(0x10000) if cls.match(chr(i))}
    assert found == set(K.WS_CHARS) == {chr(i) for i in range(0x10000) if chr(i).isspace()}
