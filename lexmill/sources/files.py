"""Readers and writers for source CSV, label JSON, corpus JSON lines, uploads, vectors and tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import constants as K
from ..functions.text import base_name, decode_text, detect_doc_type, file_type, strip, zfill
from .records import FILE, csv_records, json_objects, text_pieces
from .vector_store import VectorStore

_MAP = T.MapType(T.StringType(), T.StringType())
CORPUS_SCHEMA = T.StructType([
    T.StructField("info", _MAP), T.StructField("label", _MAP),
    *[T.StructField(c, T.StringType()) for c in ("docu_type", "task_type", "law_name", "article", "source_text",
                                                 "law_date", "category")],
])
SENTENCE_SCHEMA = "docu_type string, rid string, seq double, file string, pos bigint, content string"
LABEL_SCHEMA = "info map<string,string>, label map<string,string>, docu_type string, task_type string"


def _or_empty(spark: SparkSession, schema: str | T.StructType, read) -> DataFrame:
    """The table that ``read`` gives, or an empty one where its folder is missing."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table of a job that may have had nothing to write."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(path))


def read_source_csv(spark: SparkSession, root: str, docu_type: str) -> DataFrame:
    """Source sentences of one document type from every CSV file below its folder.

    Files may order their columns differently and lack some. Records are cut out of byte ranges (``records``), so a large
    file is read by many tasks. Each file's own header row, found by its id and content column names, says which
    position holds what; files without both names contribute nothing. The widest header decides how many
    positions are parsed: cells beyond a file's own header have no name.
    """
    id_name = K.SOURCE_ID_COLUMN[docu_type]
    folder = f"{root}/{K.SOURCE_FOLDER_PREFIX}{docu_type}"

    def load():
        found = csv_records(spark, folder, "*.[cC][sS][vV]").filter(strip("record") != "")
        named = F.contains("value", F.lit(id_name)) & F.contains("value", F.lit(K.CONTENT_COLUMN))
        lines = text_pieces(spark, folder, "*.[cC][sS][vV]")
        width = lines.filter(named).agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
        cells = [f"c{i}" for i in range(width)]
        parsed = F.from_csv("record", ", ".join(f"{c} string" for c in cells), {"escape": '"', "maxCharsPerColumn": "-1"})
        rows = found.select(F.col(FILE).alias("file"), "pos", parsed.alias("_c")).select("file", "pos", F.array(*[F.col(f"_c.{c}") for c in cells]).alias("row"))
        names = F.transform("row", lambda c: strip(F.regexp_replace(c, "^﻿", "")))
        is_header = F.array_contains(names, id_name) & F.array_contains(names, K.CONTENT_COLUMN)
        headers = rows.filter(is_header).groupBy("file").agg(
            F.min("pos").alias("_at"), F.min_by(names, "pos").alias("_names")
        )
        place = lambda name: F.array_position("_names", name).cast("int")
        cell = lambda name: F.when(place(name) > 0, F.get("row", place(name) - 1))
        seq = F.when(place(K.SEQ_COLUMN) > 0, cell(K.SEQ_COLUMN).try_cast("double")).otherwise(0.0)
        return (
            rows.join(headers, "file").filter(F.col("pos") > F.col("_at"))
            .select(
                F.lit(docu_type).alias("docu_type"), zfill(strip(cell(id_name))).alias("rid"), seq.alias("seq"),
                "file", "pos", F.coalesce(cell(K.CONTENT_COLUMN), F.lit("")).alias("content"),
            )
        )

    return _or_empty(spark, SENTENCE_SCHEMA, load)


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    parts = [read_source_csv(spark, root, t) for t in K.CORPUS_TYPES]
    return _union(parts)


def read_label_json(spark: SparkSession, root: str, docu_type: str, task: str) -> DataFrame:
    """Label records of one type and task: files hold an object or an array of objects; broken ones are skipped."""
    return label_objects(spark, f"{root}/{K.LABEL_FOLDER_PREFIX}{docu_type}_{task}", "*.json", docu_type, task)


def label_objects(spark: SparkSession, folder: str, glob: str, docu_type: str, task: str) -> DataFrame:
    """Label records of the files below one folder."""
    return _or_empty(spark, LABEL_SCHEMA, lambda: _whole_files(
        json_objects(spark, folder, glob), "info map<string,string>, label map<string,string>"
    ).withColumns({"docu_type": F.lit(docu_type), "task_type": F.lit(task)}))


def _whole_files(objects: DataFrame, schema: str) -> DataFrame:
    """The parsed objects of files in which every object can be read."""
    read = objects.select(FILE, "closed", F.from_json("record", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("_o"))
    bad = read.filter(~F.col("closed") | F.col("_o._bad").isNotNull()).select(F.col(FILE).alias("_f")).distinct()
    return read.join(bad, F.col(FILE) == F.col("_f"), "left_anti").select("_o.*").drop("_bad")


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    from ..operators.corpus import corpus_parts

    return _union([read_label_json(spark, root, d, t) for d, t in corpus_parts()])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_corpus_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, non-ASCII kept, as a folder of part files."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Corpus lines plus ``_corrupt_record`` for malformed ones; blank lines do not count."""
    schema = T.StructType(CORPUS_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def good_lines(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def bad_lines(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")


def read_json_array(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """Documents ``text, category, law_date`` of a file that holds one JSON array."""
    folder, _, name = path.rstrip("/").rpartition("/")
    rows = _whole_files(json_objects(spark, folder, name), "text string, category string, law_date string")
    return rows.limit(max_docs) if max_docs is not None else rows


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``path, file_name, doc_type, file_type, length, content``."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", base_name("path").alias("file_name"), detect_doc_type("path").alias("doc_type"),
                file_type("path").alias("file_type"), "length", "content")
    )


def upload_texts(uploads: DataFrame) -> DataFrame:
    """Decoded text uploads; ``text`` is NULL where no encoding fits."""
    return uploads.filter("doc_type = 'txt'").withColumn("text", decode_text("content")).drop("content")


def write_vectors(df: DataFrame, path: str, key: str = "vec_id", order: str | None = None) -> None:
    """Add records to a vector table, which need not exist yet; a known key's record is replaced."""
    VectorStore(df.sparkSession, path, ("namespace", key)).upsert(df, order)


def read_vectors(spark: SparkSession, path: str, namespace: str | None = None, key: str = "vec_id") -> DataFrame:
    return VectorStore(spark, path, ("namespace", key)).read(namespace)


def upsert_vectors(spark: SparkSession, path: str, updates: DataFrame, key: str = "vec_id", order: str | None = None,
                   batch: tuple[str, int] | None = None) -> None:
    """Insert or replace by id; only the updates themselves are written. Where ids repeat, ``order`` says which row counts."""
    VectorStore(spark, path, ("namespace", key)).upsert(updates, order, batch)


def delete_vectors(spark: SparkSession, path: str, ids: DataFrame, key: str = "vec_id") -> None:
    VectorStore(spark, path, ("namespace", key)).delete(ids)


def append_chunks(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_table(spark: SparkSession, source: str, name: str, jdbc: dict | None = None) -> DataFrame:
    """A relational table from Parquet, or over JDBC with the caller's (partitioned) options."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(url=source, dbtable=name, **jdbc).load()
    return spark.read.parquet(f"{source}/{name}.parquet")


def spread(df: DataFrame, column: Column | None = None) -> DataFrame:
    """Use every core before heavy per-row work when a small input has fewer splits than that.

    Large inputs already have more splits and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores) if column is None else df.repartition(cores, column)
