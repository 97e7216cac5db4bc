import csv
import io
import json
import random

import pytest

from lexmill.functions import constants as K
from lexmill.sources import files
from lexmill.sources.records import csv_records, json_objects, quoted_lines, text_pieces


@pytest.fixture
def ranges(spark):
    """Small byte ranges, so that a small file is read by many tasks."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def some_csv(rng, n):
    cell = lambda: rng.choice(["", "a", 'five" disk', "x,y", "line\nbreak", 'say ""', '"', '"",""\n",', "글 " * rng.randint(0, 30), "\n\n", "end\n"])
    rows = [[cell() for _ in range(3)] for _ in range(n)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for i, r in enumerate(rows):
        writer.writerow([f"{i}", *r])
    return out.getvalue()


def test_csv_records_of_ranges(spark, ranges, tmp_path):
    rng = random.Random(11)
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text(some_csv(rng, 400 + 300 * k))
    (tmp_path / "one.csv").write_text('0,"' + "never ends for long\n" * 900 + '",b\n1,x,y\n')
    (tmp_path / "none.csv").write_text("")
    pieces = text_pieces(spark, str(tmp_path), "*.csv")
    assert pieces.select("_file", "_range").distinct().count() > 20
    got = {}
    for r in csv_records(spark, str(tmp_path), "*.csv").collect():
        got.setdefault(r["_file"].rpartition("/")[2], []).append((r["pos"], r["record"]))
    assert "none.csv" not in got
    for name in ("f0.csv", "f1.csv", "f2.csv", "one.csv"):
        parsed = [next(csv.reader(io.StringIO(t), strict=True)) for _, t in sorted(got[name])]
        with open(tmp_path / name, newline="") as f:
            assert parsed == list(csv.reader(f))


def test_a_quote_inside_an_open_cell_is_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1,5" disk,a\n2,"b\nc",d\n')
    rows = quoted_lines(text_pieces(spark, str(tmp_path), "*.csv")).orderBy("_at").collect()
    assert [r["inside"] for r in rows] == [0, 0, 1]


def test_source_csv_of_five_megabytes(spark, tmp_path):
    kind = K.CORPUS_TYPES[0]
    folder = tmp_path / f"{K.SOURCE_FOLDER_PREFIX}{kind}"
    folder.mkdir()
    rng, want = random.Random(5), []
    with open(folder / "big.csv", "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow([K.SEQ_COLUMN, K.SOURCE_ID_COLUMN[kind], K.CONTENT_COLUMN])
        for i in range(12_000):
            text = rng.choice(["문장 ", 'a "quoted" ', "줄\n바꿈 ", "x,y "]) * rng.randint(1, 60)
            out.writerow([i, i % 700, text])
            want.append((f"{i % 700:06d}", float(i), text))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        assert text_pieces(spark, str(folder), "*.csv").rdd.getNumPartitions() > 10
        got = [(r["rid"], r["seq"], r["content"]) for r in files.read_source_csv(spark, str(tmp_path), kind).orderBy("file", "pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2].strip() for g in got] == [w[2].strip() for w in want]


def some_json(rng, n):
    text = lambda: rng.choice(["", "plain", "a } b", "[{", 'say "x"', "back\\slash\\", "줄\n", "\\u007b", "{}" * rng.randint(0, 40)])
    return [{"text": text(), "category": text(), "law_date": None, "more": {"k": [text(), {"z": text()}]}} for _ in range(n)]


@pytest.mark.parametrize("style", [dict(), dict(indent=1), dict(ensure_ascii=False, separators=(",", ":"))])
def test_json_objects_of_ranges(spark, ranges, tmp_path, style):
    rng, want = random.Random(7), {}
    for k in range(3):
        want[f"a{k}.json"] = some_json(rng, 150 * k)
        (tmp_path / f"a{k}.json").write_text(json.dumps(want[f"a{k}.json"], **style) + "\n" * k, encoding="utf-8-sig" if k == 1 else "utf-8")
    want["o.json"] = some_json(rng, 1)
    (tmp_path / "o.json").write_text(json.dumps(want["o.json"][0], **style))
    want["n.json"] = some_json(rng, 1)
    (tmp_path / "n.json").write_text(" " + json.dumps(want["n.json"][0], **style) + "\n")
    got = {}
    for r in json_objects(spark, str(tmp_path), "*.json").collect():
        assert r["closed"], r
        got.setdefault(r["_file"].rpartition("/")[2], []).append((r["pos"], json.loads(r["record"])))
    assert {k: [o for _, o in sorted(v, key=lambda x: x[0])] for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_broken_json_files_are_skipped(spark, ranges, tmp_path):
    good = some_json(random.Random(1), 40)
    (tmp_path / "good.json").write_text(json.dumps(good))
    whole = json.dumps(some_json(random.Random(2), 200))
    for k, text in enumerate((whole[:-1], whole[:-2], whole[:len(whole) // 2], whole.replace('": ', '" ', 1), '{"text": "open', '{"text": 1', "{", "no json")):
        (tmp_path / f"bad{k}.json").write_text(text)
    assert files.read_json_array(spark, str(tmp_path / "*.json")).count() == 40
    assert files.read_json_array(spark, str(tmp_path / "good.json"), 3).count() == 3
