"""What the physical plans must and must not hold, and hot keys."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import blocks, corpus, index, prompts, sessions, windows
from lexmill.plans import fixtures
from lexmill.plans.catalog import QUERIES
from lexmill.sources import files

from .conftest import SF

IN_ROW = ["sections", "sentences", "chunks", "chunk_documents", "chunk_stats", "sample_chunks", "sample_text", "law_mode",
          "cit_articles", "cit_law", "cit_valid", "cit_inherit", "cit_filter", "cit_metadata", "cit_post", "law_refs",
          "revised_date", "parse_analysis", "sparse_weights"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", IN_ROW)
def test_in_row_operators_do_not_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not any(kind in text for kind in ("hashpartitioning", "rangepartitioning", "SinglePartition"))
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {n for n in QUERIES if n.startswith("stream_")}))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_is_used(spark):
    text = QUERIES["min_text"](spark, SF)._jdf.queryExecution().toString()
    assert "html" not in text and "ReadSchema: struct<doc_id:bigint,text:string,n_chars:bigint>" in text
    scan = QUERIES["scan_users"](spark, SF)._jdf.queryExecution().toString()
    assert "c_mktsegment" not in scan.split("Physical Plan")[1]


def test_namespace_filter_reaches_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("public", 1, "a"), ("user_1", 2, "b")], "namespace string, vec_id long, v string")
    files.write_vectors(rows, str(tmp_path / "v"))
    text = plan(files.read_vectors(spark, str(tmp_path / "v"), "public"))
    assert "EqualTo(namespace,public)" in text.split("PushedFilters")[1]


def test_reading_order_of_large_pages(spark):
    import random
    import time

    rng, seconds = random.Random(1), []
    for n in (4000, 8000):
        tops = sorted(rng.uniform(0, 40 * n) for _ in range(n))
        bottoms = [t + rng.choice([5, 12, 30, 4000]) for t in tops]
        start = time.perf_counter()
        blocks.line_numbers(tops, bottoms, 20.0)
        seconds.append(time.perf_counter() - start)
    assert seconds[0] < 0.5 and seconds[1] < 6 * seconds[0] + 0.1
    data = [(1, 1, i, float(i * 37 % 601), float(i // 4 * 50), float(i * 37 % 601 + 9), float(i // 4 * 50 + 9), f"t{i % 900}", "ocr" if i % 2 else "native") for i in range(4000)]
    df = spark.createDataFrame(data, BLOCK + ", source string").cache()
    df.count()
    start = time.perf_counter()
    assert len(blocks.reading_order(df, unique=True).first()["blocks"]) == 4000
    assert time.perf_counter() - start < 10


def test_lines_equal_a_plain_fold():
    import random

    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(0, 60)
        tops = sorted((rng.choice([None, rng.uniform(0, 120)]) if rng.random() < 0.1 else rng.uniform(0, 120) for _ in range(n)), key=lambda t: (t is not None, t or 0))
        bottoms = [None if t is None else t + rng.choice([-30, 0, 6, 15, 80]) for t in tops]
        lines, want = [], []
        for t, b in zip(tops, bottoms):
            c = None if t is None else (t + b) / 2
            at = next((i for i, line in enumerate(lines) if c is not None and line[0] is not None and abs(c - line[0] / line[1]) < 20.0), None)
            if at is None:
                lines.append([c, 1])
                at = len(lines) - 1
            else:
                lines[at][0] += c
                lines[at][1] += 1
            want.append(at + 1)
        assert blocks.line_numbers(tops, bottoms, 20.0) == want


def test_lag_by_blocks_equals_lag_on_a_hot_session(spark):
    rows = [(0 if i % 3 else i, i, f"q{i}" if i % 7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "s long, t long, q string")
    got = windows.lag_by_blocks(df, ["s"], ["t"], F.floor(F.col("t") / 50), "q", "p")
    want = df.withColumn("p", F.expr("lag(q) over (partition by s order by t)"))
    assert sorted(got.select("s", "t", "p").collect()) == sorted(want.select("s", "t", "p").collect())
    text = plan(got)
    assert "hashpartitioning(s" in text and "_block" in text


def test_look_back_equals_a_window_on_a_hot_session(spark):
    df = spark.createDataFrame([(0 if i % 3 else i % 30, i, f"q{i}") for i in range(400)], "s long, t long, q string")
    for width in (3, 50, 10_000):
        got = windows.look_back(df, ["s"], "t", F.floor(F.col("t") / width), ["q"], 5, "p")
        want = df.withColumn("p", F.expr(
            "collect_list(struct(t, q)) over (partition by s order by t rows between 5 preceding and 1 preceding)"))
        assert sorted(got.select("s", "t", "p").collect()) == sorted(want.select("s", "t", "p").collect())


def test_recent_rows_are_pruned_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)], "s long, t long")
    out = windows.most_recent(df, ["s"], [F.desc("t")], 3)
    assert sorted(r["t"] for r in out.collect()) == [47, 48, 49]
    assert "WindowGroupLimit" in plan(out)


def test_corpus_rows_are_parsed_once(spark):
    optimized = QUERIES["corpus_build"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_extract_all(") == 1


def test_only_wanted_records_are_cleaned(spark):
    lines = spark.createDataFrame([("판결문", f"{i:06d}", 1.0, "f", 0, "글") for i in range(5)], "docu_type string, rid string, seq double, file string, pos long, content string")
    wanted = spark.createDataFrame([("판결문", "000002"), ("판결문", "000002"), ("법령", "000003"), ("판결문", None)], "docu_type string, rid string")
    assert [r["rid"] for r in corpus.ordered_concat(lines, wanted=wanted).collect()] == ["000002"]


def test_labels_without_an_id_are_spread(spark):
    labels = spark.createDataFrame(
        [("판결문", "000000", f"출력 {i}") for i in range(200)] + [("판결문", "000001", "출력")], "docu_type string, rid string, output string")
    texts = spark.createDataFrame([("판결문", "000001", "본문")], "docu_type string, rid string, joined_text string")
    got = corpus.join_source(labels, texts)
    assert got.count() == 201 and got.filter("is_fallback").count() == 200
    assert got.filter("rid = '000001'").first()["source_text"] == "본문"


def page(*items):
    return [(1, 1, i, *map(float, box), text) for i, (box, text) in enumerate(items)]


BLOCK = "doc_id long, page long, pos int, x0 double, y0 double, x1 double, y1 double, text string"


def test_reading_order_two_columns(spark):
    native = spark.createDataFrame(page(
        ((300, 12, 400, 22), "둘"), ((10, 10, 100, 20), "하나"), ((10, 100, 100, 110), "넷,"), ((300, 29, 400, 31), "셋")), BLOCK)
    ocr = spark.createDataFrame(page(((5, 100, 8, 110), "그림"), ((5, 300, 8, 310), "하 나"), ((0, 0, 1, 1), "  ")), BLOCK)
    merged = blocks.merge_blocks(native, ocr)
    ordered = blocks.reading_order(merged)
    # 셋 is 14 below the mean of its line (15, 17): within 20, so it belongs there and sorts by x
    assert [b["text"] for b in ordered.first()["blocks"]] == ["  ", "하나", "둘", "셋", "그림", "넷,"]
    doc = blocks.document_text(blocks.page_text(ordered)).first()["text"]
    assert doc == "\n--- 1 Page ---\n하나 둘 셋 그림 넷"


def test_regions(spark):
    df = spark.createDataFrame(page(((0, 0, 39, 30), "a"), ((0, 0, 40, 24), "b"), ((0, 0, 40, 25), "c")), BLOCK)
    assert [r["text"] for r in blocks.region_filter(df).collect()] == ["c"]


def test_ready_states_are_a_parameter(spark):
    chats = spark.createDataFrame([(1,), (2,), (3,)], "session_id long")
    docs = spark.createDataFrame([(1, "READY"), (1, "READY"), (2, "EMBEDDED"), (3, "FAILED")], "session_id long, status string")
    mode = lambda **k: {r[0]: r[1] for r in sessions.context_mode(chats, docs, **k).collect()}
    assert mode() == {1: "hybrid", 2: "hybrid", 3: "general"}
    assert mode(states=("READY",)) == {1: "hybrid", 2: "general", 3: "general"}


def test_reference_labels(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame(
        [(1, 2, "", "민법", "c", " 본문 "), (1, 1, "형법 제1조", "", "", ""), (1, 3, None, None, None, None)],
        "query_id long, rank int, article string, law_name string, category string, text string")
    got = {r[0]: r[1] for r in prompts.reference_block(q, hits).collect()}
    assert got[2] == "[참고자료]\n관련 자료를 찾을 수 없습니다."
    assert got[1] == ("[참고자료]\n1. [조문: 형법 제1조] [본문]\n본문 내용 없음\n2. [법령명: 민법] [조문: 확인 불가] [본문]\n본문\n"
                      "3. [조문: 확인 불가] [본문]\n본문 내용 없음")


def test_record_article_names_the_law_once(spark):
    df = spark.createDataFrame([("", "상법", "c", "상법 제1조"), ("형법", "상법", "c", "상법 제1조"), ("", "", "세무", "제1조"), ("", "", "세무", "")],
                               "given string, law string, category string, article string")
    got = df.select(index.record_article(F.col("given"), F.col("law"), F.col("category"), F.col("article"))).collect()
    assert [r[0] for r in got] == ["상법 제1조", "형법 제1조", "세무법 제1조", "세무법"]
