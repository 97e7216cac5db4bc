import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import chunking as H
from lexmill.functions.chunking import ChunkConfig
from lexmill.operators import index



def pack(sentences, cfg):
    """The packing rule, written out for comparison."""
    out, buf = [], ""
    for s in sentences:
        if buf and len(buf) + len(s) + 1 > cfg.max_chars:
            if len(buf) >= cfg.min_chars:
                out.append(buf.strip())
            tail = buf[-cfg.overlap_chars:] if cfg.overlap_chars else ""
            buf = f"{tail} {s}" if tail else s
        else:
            buf = f"{buf} {s}" if buf else s
    if buf.strip() and len(buf.strip()) >= cfg.min_chars:
        out.append(buf.strip())
    return out


def test_sections(one):
    got = one(lambda c: H.split_sections(c), t="머리말 제1조(목적) 가. 제 2 조의 3 (정의) 나, 제4조 없음")
    assert got == ["머리말", "제1조(목적) 가.", "제 2 조의 3 (정의) 나, 제4조 없음"]
    assert one(lambda c: H.split_sections(c), t="  구조 없음 ") == ["구조 없음"]
    assert one(lambda c: H.split_sections(c), t="  ") == []


@pytest.mark.parametrize("cfg", [ChunkConfig(40, 10, 5), ChunkConfig(30, 0, 20), ChunkConfig(25, 40, 1)])
def test_packing_matches_the_rule(spark, cfg):
    rng = random.Random(42)
    cases = []
    for i in range(60):
        n = rng.randint(1, 30)
        cases.append((i, ["".join(rng.choice("가나다ab ") for _ in range(rng.randint(1, 35))).strip() or "x" for _ in range(n)]))
    rows = spark.createDataFrame(cases, "i int, s array<string>").select("i", "s", H.assemble(F.col("s"), cfg).alias("c")).collect()
    for r in rows:
        assert r["c"] == pack(r["s"], cfg)


def test_document_chunks(spark):
    long = "제1조(목적) " + " ".join(f"문장 {i}입니다." for i in range(60)) + " 도로교통법 제2조(정의) 짧은 본문 스무 글자를 넘기기 위한 문장"
    docs = spark.createDataFrame([(1, long), (2, ""), (3, None), (4, "짧음")], "doc_id long, text string")
    rows = index.chunk_documents(docs, ChunkConfig(200, 20, 20)).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {1}
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert rows[0]["article"] == "도로교통법 제1조" and rows[-1]["article"] == "도로교통법 제2조"
    stats = {r["doc_id"]: r for r in index.chunk_stats(docs, ChunkConfig(200, 20, 20)).collect()}
    assert stats[1]["total_chunks"] == len(rows) and stats[1]["total_chars"] == sum(r["char_count"] for r in rows)
    assert stats[2]["total_chunks"] == 0 and stats[2]["avg_chars"] == 0.0


def test_splitter_and_progress_hooks(spark):
    from pyspark.sql import Observation

    docs = spark.createDataFrame([(1, "가나다라|마바사아|자차카타")], "doc_id long, text string")
    cut = index.chunk_documents(docs, ChunkConfig(6, 0, 1), False, splitter=lambda s: F.split(s, r"\|"))
    seen = Observation("run")
    got = cut.observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert sorted(r["text"] for r in got) == ["가나다라", "마바사아", "자차카타"] and seen.get["rows"] == 3
    assert index.observed(cut, "chunks", chars=F.sum("char_count")).count() == 3


def test_sample_indexes(spark):
    chunks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("chunk_index"), F.lit("x" * 900).alias("text")))
    for n, want in ((10, list(range(10))), (11, [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]), (100, [0, 1, 2, 3, 49, 50, 96, 97, 98, 99])):
        df = spark.range(1).select(F.lit(n).alias("n")).select(H.sample_array(chunks).alias("s"))
        assert [c["chunk_index"] for c in df.first()["s"]] == want
    text = spark.range(1).select(F.lit(20).alias("n")).select(H.sample_text(H.sample_array(chunks)).alias("s")).first()["s"]
    assert text.count("[청크 ") == 8


def test_no_exchange_in_chunking(spark):
    docs = spark.createDataFrame([(1, "제1조(목적) 가")], "doc_id long, text string")
    plan = index.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_first_copy_survives_without_gathering_copies(spark):
    rows = [(i, "같은 글" if i % 3 else f"글 {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in index.dedup_exact(df).collect()}
    assert kept == {1} | {i for i in range(0, 300, 3)}
    plan = index.dedup_exact(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
