import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import citations as C, constants as K
from lexmill.functions.text import strip
from lexmill.operators.verify import verify_answers



@pytest.mark.parametrize("between, law", [
    ("피고인은 형법", "형법"),
    ("「개인정보 보호법」", "개인정보 보호법"),
    ("관세법(2020. 1. 1. 개정)", "관세법"),
    ("상법 및", "상법"),
    ("또는", ""),
    ("이 사건 규정", "규정"),
    ("그리고 hello", "hello"),
    ("과", ""),
])
def test_law_before(one, between, law):
    assert one(lambda c: C.law_before(c), t=between) == law


@pytest.mark.parametrize("between, tail", [
    ("word, " * 500 + "이 사건 근로기준법 및 ", "근로기준법"),
    ("word 조약: 부속: 규칙", "조약: 부속: 규칙"),
    ("「상법」 " * 50 + "「 민 법 」,", " 「 민 법 」"),
    ("및 또는 형법", "형법"),
    (" x 및형법", "및형법"),
    ("형법 (제1조) .", ""),
])
def test_only_the_tail_is_searched_for_a_law(one, between, tail):
    assert one(lambda c: C._unwrap(c), t=between) == tail


def test_tails_give_what_whole_texts_give(spark):
    parts = ["형법", "법", "규칙", "및", "또는", "는", "·", "’", " ", "\n", ":", ": ", "a1", "-", "「", "」", "「상법」", "(", ")", ".", "제", "\x02", "\x85"]
    r = random.Random(5)
    rows = [("".join(r.choice(parts) for _ in range(r.randint(0, 9))),) for _ in range(4000)]
    c = F.btrim(F.regexp_replace("t", K.PARENTHESES, ""), F.lit(K.EDGE_JUNK_MARKS + K.WS_CHARS))
    run = f"(?<![{K.LAW_CHARS}])"
    usable = lambda w: F.when((w != "") & ~w.isin(*K.LAW_STOP_WORDS), w)
    whole = F.coalesce(
        F.nullif(strip(F.regexp_extract(c, K.BRACKETED_LAW, 1)), F.lit("")), usable(F.regexp_extract(c, run + K.COMPOUND_LAW, 1)),
        usable(F.regexp_extract(c, run + K.WORD_LAW, 1)), F.lit(""))
    compared = spark.createDataFrame(rows, "t string").select("t", C.law_before(F.col("t")).alias("a"), whole.alias("b"))
    assert compared.filter("a <> b").collect() == []
    assert compared.filter("a <> ''").count() > 500


@pytest.mark.parametrize("law, ok", [("형법", True), ("제1항", False), ("항", False), ("전단", False), ("동법", False), ("", False), ("시행령", True)])
def test_valid_law(one, law, ok):
    assert one(lambda c: C.is_valid_law(c), t=law) is ok


def meta(one, text, head=None):
    m = one(lambda c: C.legal_metadata(c, head), t=text)
    return m["laws"], m["citations"]


def test_inheritance_and_filter(one):
    laws, cits = meta(one, "형법 제1조, 시행령 제2조 및 법 제3조의2, 제4조 관세법 시행령 제5조, 형법 제1조")
    # "시행령" follows 형법; a bare 법 and a bare article too; only the last word before 제5조 is its law
    assert laws == "형법, 형법 시행령"
    assert cits == "형법 제1조, 형법 시행령 제2조, 형법 제3조의2, 형법 제4조, 형법 시행령 제5조"


def test_bare_citations_stay_when_alone(one):
    assert meta(one, "(제1조), 제 2 조의 3") == ("", "제1조, 제2조의3")


def test_head_limits_what_is_read(one):
    text = "형법 제1조 " + "가 " * 400 + "민법 제2조"
    assert meta(one, text, 800)[1] == "형법 제1조"
    assert meta(one, text)[1] == "형법 제1조, 민법 제2조"
    assert meta(one, "") == ("", "")


@pytest.mark.parametrize("joined, strict, want", [
    ("형법 제1조, 형법 제1조, 전단 제2조", True, "형법 제1조"),
    ("개인정보 보호법 제3조", True, ""),
    ("개인정보 보호법 제3조", False, "개인정보 보호법 제3조"),
    ("형법 제1조에 따라 처벌", True, "형법 제1조"),
    ("종전, 제5조의2", True, "제5조의2"),
    ("서울특별시, 민법", True, "민법"),
    ("", True, ""),
])
def test_post_clean(one, joined, strict, want):
    assert one(lambda c: C.post_clean(c, strict), t=joined) == want


def test_law_mode_prefers_first_on_ties(one):
    assert one(lambda c: C.law_mode(c), t="공직선거법 제1조 도로교통법 제2조") == "공직선거법"
    assert one(lambda c: C.law_mode(c), t="공직선거법 제1조 도로교통법 제2조\n도로교통법 제3조") == "도로교통법"
    # names that end like an excluded word do not count
    assert one(lambda c: C.law_mode(c), t="근로기준법 제1조") == ""
    assert one(lambda c: C.law_mode(c), t="수사방법 제1조") == ""
    assert one(lambda c: C.law_mode(c), t="형법 제1조") == ""
    assert one(lambda c: C.law_mode(c), t="개인정보 보호법 제1조") == "개인정보 보호법"


def test_law_refs_keep_first_spelling(one):
    assert one(lambda c: C.law_refs(c), t="관세법  제30조, 관세법 제30조, 관세법 시행령 제17조, 민법 제839조의2") == [
        "관세법  제30조", "관세법 시행령 제17조", "민법 제839조의2"]


@pytest.mark.parametrize("section, want", [("제 3 조 의 2 (목적) 본문", "제3조의2"), ("제1조 본문", ""), ("앞 제1조(목적)", "")])
def test_article_header(one, section, want):
    assert one(lambda c: C.article_header(c), t=section) == want


def test_verification(spark):
    answers = spark.createDataFrame(
        [(1, "형법 제1조와 민법 제2조, 관세법 시행령 제3조"), (2, "인용 없음"), (3, "상법 제9조")], "query_id long, answer string")
    hits = spark.createDataFrame(
        [(1, "형법  제1조, 관세법 시행령 제3조", "민법 제2조"), (1, "", "민법 제5조"), (2, None, "형법 제1조")],
        "query_id long, article string, text string")
    got = {r["query_id"]: r for r in verify_answers(answers, hits).collect()}
    assert got[1]["verified_refs"] == ["형법 제1조", "관세법 시행령 제3조"] and got[1]["unverified_refs"] == ["민법 제2조"]
    assert got[1]["warnings"][0].startswith("'민법 제2조'") and not got[1]["verified"]
    assert got[2]["verified"] and got[2]["answer_refs"] == []
    assert got[3]["unverified_refs"] == ["상법 제9조"]
    strict = {r["query_id"]: r for r in verify_answers(answers, hits, strict=True).collect()}
    assert strict[1]["verified_refs"] == []


@pytest.mark.parametrize("build", [C.law_refs, C.law_mode, lambda t: C.legal_metadata(t)["citations"]])
def test_long_texts_take_time_in_proportion(one, build):
    """Four times the text may take some eight times as long, not sixteen."""
    import time

    def text(n):
        return " ".join(f"개인정보 보호법 제{i}조에 따라 동법 제{i + 1}조와 시행령 제{i}조의2" for i in range(n))

    def seconds(n):
        start = time.perf_counter()
        one(lambda t: F.xxhash64(build(t)), t=text(n))
        return time.perf_counter() - start

    seconds(100)
    assert seconds(6000) < 8 * max(0.25, seconds(1500))
