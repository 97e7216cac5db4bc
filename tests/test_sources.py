import json

from pyspark.sql import functions as F

from lexmill.functions.chunking import ChunkConfig
from lexmill.operators import corpus, index
from lexmill.sources import files


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def make_sources(root):
    bom = b"\xef\xbb\xbf"
    folder = root / "TS_판결문"
    write(folder / "a.csv", bom + "판례일련번호,문장번호,내용\n7,2,둘째 문장\n7,1,\"첫째,\n\"\"인용\"\" 형법 제1조\"\n".encode())
    write(folder / "sub" / "B.CSV", "내용,기타,판례일련번호\n순서 없는 글,x,123456\n,x,123456\n")
    write(folder / "c.csv", "판례일련번호,비고\n1,내용 열이 없음\n")
    write(folder / "d.csv", "판례일련번호,문장번호,내용\n1234567,1,긴 번호\n000000,1,없는 번호\n")


def label(i, output, **info):
    return {"info": {"precedId": i, **info}, "label": {"output": output, "input": "질문"}}


def make_labels(root):
    folder = root / "TL_판결문_QA"
    write(folder / "one.json", json.dumps(label("7", "답변입니다 하나", title="관세법", smClass="제9조", finalDate="20240102"), ensure_ascii=False))
    many = [label("123456", "ab"), label("999", "대체 답변  형법 제3조 참조", title="", smClass=""), {"info": {}, "label": {"output": "정보가 없는 답변"}}]
    write(folder / "in" / "many.json", b"\xef\xbb\xbf" + json.dumps(many, ensure_ascii=False).encode())
    write(folder / "broken.json", '{"info": {"precedId"')


def test_csv_columns_are_found_by_name(spark, tmp_path):
    make_sources(tmp_path)
    rows = files.read_source_csv(spark, str(tmp_path), "판결문").orderBy("rid", "seq", "pos").collect()
    got = [(r["rid"], r["seq"], r["content"]) for r in rows]
    assert got == [
        ("000000", 1.0, "없는 번호"), ("000007", 1.0, '첫째,\n"인용" 형법 제1조'), ("000007", 2.0, "둘째 문장"),
        ("123456", 0.0, "순서 없는 글"), ("123456", 0.0, ""), ("1234567", 1.0, "긴 번호"),
    ]
    assert files.read_source_csv(spark, str(tmp_path), "법령").count() == 0


def test_wide_csv_is_read_whole(spark, tmp_path):
    names = [f"비고{i}" for i in range(71)]
    write(tmp_path / "TS_판결문" / "wide.csv", ",".join(["판례일련번호", *names, "내용"]) + "\n7," + "," * 71 + "끝 열의 글\n")
    rows = files.read_source_csv(spark, str(tmp_path), "판결문").collect()
    assert [(r["rid"], r["content"]) for r in rows] == [("000007", "끝 열의 글")]


def test_labels_skip_broken_files(spark, tmp_path):
    make_labels(tmp_path)
    rows = files.read_labels(spark, str(tmp_path))
    assert rows.count() == 4
    assert sorted(r["info"].get("precedId", "-") for r in rows.collect()) == ["-", "123456", "7", "999"]


def test_corpus_from_files_to_chunks(spark, tmp_path):
    make_sources(tmp_path / "src")
    make_labels(tmp_path / "lab")
    made = corpus.build_corpus(files.read_labels(spark, str(tmp_path / "lab")), files.read_sources(spark, str(tmp_path / "src")))
    rows = {r["info"]["precedId"]: r for r in made.collect()}
    assert set(rows) == {"7", "999"}
    assert rows["7"]["source_text"] == '첫째, "인용" 형법 제1조 둘째 문장'
    assert rows["7"]["article"] == "형법 제1조" and rows["7"]["law_name"] == "형법"
    assert rows["7"]["info"]["finalDate"] == "2024-01-02" and not rows["7"]["is_fallback"]
    assert rows["999"]["is_fallback"] and rows["999"]["source_text"] == "대체 답변 형법 제3조 참조"
    assert rows["999"]["article"] == "형법 제3조"

    out = str(tmp_path / "corpus")
    files.write_corpus_jsonl(made.drop("is_fallback"), out)
    text = "".join(p.read_text() for p in (tmp_path / "corpus").glob("part-*"))
    assert "형법 제1조" in text and "\\u" not in text
    (tmp_path / "corpus" / "part-extra.json").write_text('\n{"broken"\n{"article": "a", "source_text": "%s"}\n' % ("가" * 20))
    back = files.read_corpus_jsonl(spark, out).cache()
    assert files.bad_lines(back).count() == 1 and files.good_lines(back).count() == 3
    records = files.good_lines(back).select(
        F.monotonically_increasing_id().alias("doc_id"), "article", F.col("source_text").alias("text"))
    stats = {r["reason"]: r["records"] for r in index.index_stats(records, ChunkConfig(min_chars=5), files.bad_lines(back)).collect()}
    assert stats["malformed"] == 1 and sum(stats.values()) == 4


def test_statistics_total(spark, tmp_path):
    make_labels(tmp_path)
    flat = corpus.label_columns(files.read_labels(spark, str(tmp_path))).withColumn("is_fallback", F.col("rid") == "000999")
    total = [r for r in corpus.pipeline_stats(flat).collect() if r["docu_type"] is None][0]
    assert (total["total"], total["skip"], total["fallback"], total["saved"]) == (4, 2, 1, 2)


def test_uploads(spark, tmp_path):
    write(tmp_path / "u8.txt", "유니코드 글")
    write(tmp_path / "old.TXT", "옛 글".encode("cp949"))
    write(tmp_path / "bad.txt", b"\xff\xff")
    write(tmp_path / "x.pdf", b"%PDF")
    ups = files.read_uploads(spark, str(tmp_path))
    assert {r["file_name"]: r["doc_type"] for r in ups.collect()} == {"u8.txt": "txt", "old.TXT": "txt", "bad.txt": "txt", "x.pdf": "pdf"}
    assert {r["file_name"]: r["text"] for r in files.upload_texts(ups).collect()} == {"u8.txt": "유니코드 글", "old.TXT": "옛 글", "bad.txt": None}


def test_json_array(spark, tmp_path):
    write(tmp_path / "legal.json", json.dumps([{"text": f"글 {i}", "category": "c", "law_date": ""} for i in range(4)]))
    assert files.read_json_array(spark, str(tmp_path / "legal.json"), 3).count() == 3


def test_vector_table_upsert_touches_named_namespaces(spark, tmp_path):
    path = str(tmp_path / "vectors")
    base = spark.createDataFrame([(1, "a", "public"), (2, "b", "public"), (1, "c", "user_1")], "vec_id long, v string, namespace string")
    files.write_vectors(base, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "vectors" / "data").glob("base-*/part-*")}
    new = spark.createDataFrame([(2, "B", "public"), (3, "d", "user_2")], "vec_id long, v string, namespace string")
    files.upsert_vectors(spark, path, new)
    files.upsert_vectors(spark, path, new)
    got = sorted((r["namespace"], r["vec_id"], r["v"]) for r in files.read_vectors(spark, path).collect())
    assert got == [("public", 1, "a"), ("public", 2, "B"), ("user_1", 1, "c"), ("user_2", 3, "d")]
    assert before and all(p.stat().st_mtime_ns == t for p, t in before.items())
    plan = files.read_vectors(spark, path, "public")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(namespace), EqualTo(namespace,public)]" in plan
