from pyspark.sql import functions as F

from lexmill.functions import constants as K
from lexmill.functions.chunking import ChunkConfig
from lexmill.functions.sql import register_sql
from lexmill.operators import embed, flows, index
from lexmill.plans import fixtures
from lexmill.plans.base import table
from lexmill.plans.catalog import QUERIES

from .conftest import SF


def test_sql_function_equals_the_operator(spark):
    register_sql(spark)
    docs = table(spark, SF, "documents")
    docs.createOrReplaceTempView("docs_sql")
    got = spark.sql("""
        SELECT doc_id, pos, col FROM (SELECT doc_id, chunk_array(text, 500, 50, 20) AS c FROM docs_sql)
        LATERAL VIEW posexplode(c) x AS pos, col""")
    want = index.chunk_documents(docs, ChunkConfig(500, 50, 20), detect=False).select("doc_id", "chunk_index", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_table_functions_are_plain_generators(spark):
    for name, args in (("sql_chunks", "chunks_of"), ("sql_citations", "citations_of")):
        text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in text and "Join" not in text and "Python" not in text and "hashpartitioning" not in text, args
    spark.createDataFrame([(1, None), (2, ""), (3, "형법 제1조와 형법  제1조, 민법 제2조의3 및 형법제1조")], "doc_id long, t string").createOrReplaceTempView("odd_sql")
    got = spark.sql("SELECT doc_id, c.* FROM odd_sql, LATERAL citations_of(t) c ORDER BY pos").collect()
    assert [tuple(r) for r in got] == [(3, 0, "형법 제1조", "형법", "제1조"), (3, 1, "민법 제2조의3", "민법", "제2조의3")]
    assert spark.sql("SELECT doc_id, c.* FROM odd_sql, LATERAL chunks_of(t, 800, 100, 5) c").count() == 1


def test_index_records(spark):
    docs = spark.createDataFrame([
        (1, 7, "도로교통법 제1조(목적) 이 법은 도로에서 일어나는 위험을 막는다. 제2조(정의) 이 법에서 쓰는 말의 뜻은 다음과 같다.", "법령·규정", "2024-01-01"),
        (2, 8, "짧다", "법령·규정", ""),
    ], "doc_id long, user_id long, text string, category string, law_date string")
    rows = flows.index_documents(docs, F.lit("2024-01-01 00:00:00")).collect()
    assert {r["namespace"] for r in rows} == {"user_7"} and len(rows) == 2
    assert {r["metadata"]["article"] for r in rows} == {"도로교통법 제1조", "도로교통법 제2조"}
    assert all(r["id"] == r["metadata"]["vector_id"] and len(r["dense"]) == 64 and r["idx"] for r in rows)


def test_document_meta(spark):
    text = "도로교통법 제1조(목적) 이 법은 도로에서 일어나는 위험을 막는다. 2024. 3. 5. 개정"
    rows = [
        (1, text, '{"category": "법령·규정", "summary": "짧은"}', '{"category": "기타", "summary": "더 긴 요약"}'),
        (2, text, '{"category": "보고서·연구자료", "summary": "첫 요약이 더 길다"}', '{"summary": ""}'),
        (3, text, '{"category": "기술문서", "summary": "x"}', "{}"),
        (4, "  ", "{}", "{}"),
        (5, "짧은 글", '{"category": "법령·규정"}', "{}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, preview_reply string, analysis_reply string")
    got = {r["doc_id"]: r for r in flows.document_meta(docs).collect()}
    assert (got[1]["category"], got[1]["law_name"], got[1]["law_date"], got[1]["summary"]) == ("법령·규정", "도로교통법", "2024-03-05", "더 긴 요약")
    assert (got[2]["law_name"], got[2]["summary"], got[2]["error"]) == ("", "첫 요약이 더 길다", None)
    assert [got[i]["error"] for i in (3, 4, 5)] == ["not_legal", "no_text", "no_chunks"]
    sample = {r["doc_id"]: r["sample"] for r in flows.analysis_input(docs).collect()}
    assert sample[1].startswith("[청크 0]\n제1조(목적)") and sample[5] == ""


def test_prompts_from_questions_to_messages(spark):
    turns = fixtures.turns(spark, SF)
    messages = turns.withColumn("answer", F.coalesce("answer", F.lit("")))
    questions = messages.select(F.col("message_id").alias("query_id"), "session_id", (F.col("session_id") % 5 + 5).alias("user_id"))
    docs = fixtures.documents(spark, SF)
    source = table(spark, SF, "documents").select(
        "doc_id", (F.col("doc_id") % 5 + 5).alias("user_id"), "text", F.lit("법령·규정").alias("category"), F.lit("").alias("law_date"))
    own = flows.index_documents(source, F.lit("now"), detect=False)
    shared = flows.index_documents(source, F.lit("now"), detect=False, public=True)
    vectors = own.unionByName(shared).select(F.col("id").alias("vec_id"), "namespace", "dense", "idx", "val")

    def evidence(hits):
        return hits.withColumn("article", F.concat(F.lit("형법 제"), F.col("rank").cast("string"), F.lit("조"))).withColumn(
            "law_name", F.lit("")).withColumn("category", F.lit("")).withColumn("text", F.col("vec_id"))

    made, gate = flows.prepare_prompts(questions, messages, docs, vectors, evidence, "규칙", F.floor(F.col("turn") / 100))
    rows = {r["query_id"]: r["messages"] for r in made.collect()}
    passed = {r["query_id"] for r in gate.filter("is_legal").collect()}
    assert set(rows) == passed and gate.count() == questions.count() and passed
    before = {(r["session_id"], r["turn"]): r for r in messages.collect()}
    for (session, turn), r in before.items():
        if r["message_id"] in rows:
            sent = rows[r["message_id"]]
            earlier = [b for (s, t), b in sorted(before.items()) if s == session and t < turn][-K.HISTORY_TURNS:]
            assert sent[0]["content"] == "규칙" and len(sent) == 2 + 2 * len(earlier)
            assert [m["content"] for m in sent[1:-1:2]] == [b["question"] for b in earlier]
            assert sent[-1]["content"].endswith("[질문]\n" + r["question"]) and "[조문: 형법 제1조]" in sent[-1]["content"]


def test_every_file_is_gated_by_its_whole_text(spark):
    law = "관세법 제1조 목적 이 법은 관세의 부과 징수 를 정한다"
    stored = embed.embed(spark.createDataFrame([(900, "public", law), (901, "user_5", "eigen text")], "vec_id long, namespace string, text string")).drop("text")
    files = spark.createDataFrame([(1, law), (2, " ".join(["x"] * 300) + " " + " ".join([law] * 60)), (3, "eigen text"), (4, ""), (5, None)], "query_id long, text string")
    got = {r["query_id"]: (r["best_score"], r["is_legal"]) for r in flows.legal_files(files, stored).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1][0] > 0.99
    assert [got[i][1] for i in sorted(got)] == [True, True, False, False, False]
    assert not any(r["is_legal"] for r in flows.legal_files(files, stored.filter("namespace <> 'public'")).collect())


def test_gate_has_a_row_for_every_document(spark):
    got = [r["query_id"] for r in QUERIES["legal_file_text"](spark, SF).select("query_id").collect()]
    assert sorted(got) == sorted(r["doc_id"] for r in table(spark, SF, "documents").select("doc_id").collect())
