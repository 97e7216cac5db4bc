"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "lexmill", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where the setting is absent, as in local tests, a scratch folder stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="lexmill-")


_scopes = threading.local()


def staged(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Compute ``df`` once: write it below the shared folder as Parquet and read it back, with statistics of its size.

    Several consumers then read it instead of repeating its plan, and a lost executor costs no recomputation of what lies
    before. The folder stays until it is discarded or, inside ``swept``, until that block ends.
    """
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    for paths in getattr(_scopes, "open", [])[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Compute a small, expensive result once and keep it in the shared folder."""
    return staged(df, "cut")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Delete what this thread stages inside the block when it ends: for results that are written inside it, as by a micro-batch."""
    paths: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), paths]
    try:
        yield
    finally:
        _scopes.open = _scopes.open[:-1]
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def ship_with_closures() -> None:
    """Send this package's task code inside closures, for runs where executors cannot import it.

    On a cluster, ``--py-files`` is the usual way; this keeps notebooks and local runs working
    from any working directory.
    """
    from pyspark import cloudpickle

    import lexmill

    cloudpickle.register_pickle_by_value(lexmill)
