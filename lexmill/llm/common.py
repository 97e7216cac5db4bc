"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: Words of the contracts that split at ASCII white space, and those of lower-cased letters and digits.
SPACE_WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once: write it below the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation of what lies before it. Texts are long, so rows go to Python in
    smaller batches than Spark's default meanwhile.
    """
    path, spark = scratch(df.sparkSession, name), df.sparkSession
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(MOST_BATCH_ROWS, int(before)) if int(before) > 0 else MOST_BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


#: The session's setting for rows in a batch to Python, and the most while a table is staged.
BATCH_ROWS, MOST_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def drop(spark: SparkSession, *staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(
    df: DataFrame, columns: dict[str, pa.DataType], schema: str, work: Callable[[Iterator[dict]], Iterator[dict]],
    rows_at_once: int = 0,
) -> DataFrame:
    """``mapInArrow`` over some columns: ``work`` turns dicts of column lists into dicts of output columns.

    ``columns`` names the output's Arrow types, ``schema`` the same as Spark DDL. Batches are cut to
    ``rows_at_once`` rows (``SLICE`` by default) before they become Python objects, so memory follows the slice.
    """
    out = pa.schema(list(columns.items()))
    step = rows_at_once or SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    yield {k: v.to_pylist() for k, v in zip(batch.schema.names, batch.slice(at, step).columns)}

        for rows in work(slices()):
            yield pa.RecordBatch.from_pydict({k: rows[k] for k in out.names}, schema=out)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what a task has freed to the system: a worker outlives its stage, and later ones need the memory elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text: str = "text") -> DataFrame:
    """The rows whose text passes, all columns as they are. ``make`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text))
            flags: list[bool] = []
            for at in range(0, batch.num_rows, SLICE):
                flags += keep([t or "" for t in values.slice(at, SLICE).to_pylist()])
            yield batch.filter(pa.array(flags, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


#: Rows that a task turns into Python objects at a time.
SLICE = 512


def members(df: DataFrame, column: str, most_bits: int = 1 << 28) -> np.ndarray:
    """A bitmap of the low bits of a long column's values, to leave out rows that a join will not keep.

    Its size follows the number of values up to ``most_bits`` (32 MB); beyond that it only lets more rows pass, and
    the exact join that comes after decides.
    """
    want = 32 * df.count()
    bits = min(most_bits, 1 << max(20, int(want).bit_length()))
    place = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    rows = df.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    return out


def is_member(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.int64(8 * len(bitmap) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
