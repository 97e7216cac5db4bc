"""A table of vectors kept by key: a sorted base, appended deltas, and a manifest that one rename swaps.

``data/`` holds folders of Parquet files that are never changed, ``manifests/`` one small JSON file per version of the
table. A write makes a folder of its own and then a manifest that names it; the manifest is written aside and renamed to the
next version's name, which fails where another writer took that name, and is then tried again on the newer version. So a
reader sees a whole version or the one before, and what a killed writer leaves is named by no manifest.

An upsert or delete of a few ids writes those rows alone (a *delta*, with the number of its version). A read joins the deltas' newest row
per key over the base. Many deltas are merged into one, and when they outgrow a share of the base, everything is written anew as
files of ranges of the key, as many as its bytes ask for: a namespace of any size is many files, small ones share one, and
a filter on the key prunes files and row groups by their bounds.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

VERSION, GONE = "_version", "_gone"


@dataclass
class Manifest:
    """One version of a table. ``base`` and ``deltas`` name folders with their bytes; ``applied``: the last batch of every writer."""

    version: int = 0
    schema: str = ""
    base: dict | None = None
    deltas: list[dict] = field(default_factory=list)
    applied: dict[str, int] = field(default_factory=dict)


class VectorStore:
    def __init__(
        self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("namespace", "vec_id"), file_bytes: int = 256 << 20,
        most_deltas: int = 16, most_share: float = 0.5,
    ):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.file_bytes, self.most_deltas, self.most_share = file_bytes, most_deltas, most_share

    # ---- reading -----------------------------------------------------------------------------
    def manifest(self) -> Manifest:
        """The newest version; version 0 of a table that does not exist yet."""
        names = self._list(f"{self.path}/manifests")
        versions = [n for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/manifests/{max(versions)}", wholetext=True).first()["value"]
        return Manifest(**json.loads(text))

    def read(self, namespace: str | None = None, at: Manifest | None = None) -> DataFrame:
        """The rows of a version, one per key."""
        now = at or self.manifest()
        if not now.schema:
            raise FileNotFoundError(f"no vectors at {self.path}")
        schema = StructType.fromJson(json.loads(now.schema))
        wanted = (lambda df: df) if namespace is None else (lambda df: df.filter(F.col(self.keys[0]) == namespace))
        base = self._folder(now.base, schema, wanted) if now.base else self.spark.createDataFrame([], schema)
        if not now.deltas:
            return base
        newest = self._newest(self._deltas(now, schema, wanted))
        same = [F.col(f"_base.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in self.keys]
        kept = base.alias("_base").join(newest.select(*self.keys).alias("_new"), same, "left_anti")
        return kept.unionByName(newest.filter(~F.col(GONE)).drop(VERSION, GONE))

    def _folder(self, part: dict, schema: StructType, wanted) -> DataFrame:
        return wanted(self.spark.read.schema(schema).parquet(f"{self.path}/data/{part['folder']}"))

    def _deltas(self, now: Manifest, schema: StructType, wanted) -> DataFrame:
        wide = StructType(schema.fields + [StructField(VERSION, LongType()), StructField(GONE, BooleanType())])
        return wanted(self.spark.read.schema(wide).parquet(*[f"{self.path}/data/{d['folder']}" for d in now.deltas]))

    def _newest(self, rows: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(F.max_by(row, VERSION).alias("_r")).select("_r.*")

    # ---- writing -----------------------------------------------------------------------------
    def upsert(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> Manifest:
        """Insert or replace by key. Of several rows of a key the one with the greatest ``order`` counts; without an order
        a repeated key is an error. ``batch`` (writer, number): a number that this writer has applied before changes nothing."""
        return self._append(self._one_per_key(rows, order).withColumn(GONE, F.lit(False)), batch)

    def delete(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> Manifest:
        """Delete by key; unknown keys are no error."""
        now = self.manifest()
        if not now.schema:
            return now
        schema = StructType.fromJson(json.loads(now.schema))
        gone = ids.select(*self.keys).distinct()
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in self.keys]
        return self._append(gone.select(*self.keys, *others, F.lit(True).alias(GONE)), batch)

    def _one_per_key(self, rows: DataFrame, order: str | None) -> DataFrame:
        keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != order])
        if order:
            return rows.groupBy(*keys).agg(F.max_by(row, order).alias("_r")).select("_r.*")
        met = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(row).alias("_r"))
        told = F.raise_error(F.concat(F.lit("a key comes more than once, name an order: "), *[F.coalesce(F.col(f"_k{i}").cast("string"), F.lit("null")) for i in range(len(keys))]))
        return met.select(F.when(F.col("_n") == 1, F.col("_r")).otherwise(told.cast(met.schema["_r"].dataType)).alias("_r")).select("_r.*")

    def _append(self, rows: DataFrame, batch: tuple[str, int] | None) -> Manifest:
        now = self.manifest()
        if batch and now.applied.get(batch[0], -1) >= batch[1]:
            return now
        plain = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(GONE).schema))  # all may be null
        if now.schema:
            have = StructType.fromJson(json.loads(now.schema))
            lacking = [f.name for f in have if f.name not in plain.names] + [c for c in plain.names if c not in have.names]
            if lacking:
                raise ValueError(f"columns differ from those of {self.path}: {lacking}")
            rows, plain = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in have], GONE), have
        name = f"delta-{uuid.uuid4().hex}"
        # the version that this becomes is only known when the manifest stands; deltas of one folder share it
        while True:
            folder = f"{name}-{now.version + 1:012d}"
            rows.withColumn(VERSION, F.lit(now.version + 1).cast("long")).select(*plain.names, VERSION, GONE).write.mode("overwrite").parquet(f"{self.path}/data/{folder}")
            new = Manifest(now.version + 1, plain.json(), now.base, [*now.deltas, self._part(folder)], dict(now.applied))
            if batch:
                new.applied[batch[0]] = batch[1]
            if self._commit(new):
                return self._tidy(new)
            now = self.manifest()
            if batch and now.applied.get(batch[0], -1) >= batch[1]:
                return now

    def _tidy(self, now: Manifest) -> Manifest:
        """Merge deltas where they are many, write the base anew where they are large."""
        size = sum(d["bytes"] for d in now.deltas)
        if now.base is None or size > self.most_share * now.base["bytes"]:
            return self.compact(now)
        return self._merge(now) if len(now.deltas) > self.most_deltas else now

    def _merge(self, now: Manifest) -> Manifest:
        schema = StructType.fromJson(json.loads(now.schema))
        folder = f"merged-{uuid.uuid4().hex}"
        self._newest(self._deltas(now, schema, lambda df: df)).write.parquet(f"{self.path}/data/{folder}")
        return self._replace(now, lambda later, new: Manifest(later.version + 1, later.schema, later.base, [self._part(folder), *new], later.applied))

    def compact(self, now: Manifest | None = None) -> Manifest:
        """Write all rows of a version as a new base, sorted by key in files of about ``file_bytes``."""
        now = now or self.manifest()
        size = sum(p["bytes"] for p in [*now.deltas, *([now.base] if now.base else [])])
        files = max(1, math.ceil(size / self.file_bytes))
        folder, keys = f"base-{uuid.uuid4().hex}", [F.asc_nulls_first(k) for k in self.keys]
        rows = self.read(at=now)
        rows = rows.repartitionByRange(files, *keys) if files > 1 else rows.coalesce(1)
        rows.sortWithinPartitions(*keys).write.parquet(f"{self.path}/data/{folder}")
        return self._replace(now, lambda later, new: Manifest(later.version + 1, later.schema, self._part(folder), new, later.applied))

    def _replace(self, now: Manifest, build) -> Manifest:
        """Commit what stands for the base and deltas of ``now``, keeping deltas that came meanwhile; else leave it to the other writer."""
        known = {d["folder"] for d in now.deltas}
        later = now
        while True:
            if later.base != now.base or not known <= {d["folder"] for d in later.deltas}:
                return later
            made = build(later, [d for d in later.deltas if d["folder"] not in known])
            if self._commit(made):
                return made
            later = self.manifest()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete older manifests than the last ``keep`` and the folders that none of those names; no writer may be at work."""
        versions = sorted(n for n in self._list(f"{self.path}/manifests") if n.endswith(".json"))
        kept = [json.loads(self.spark.read.text(f"{self.path}/manifests/{v}", wholetext=True).first()["value"]) for v in versions[-keep:]]
        named = {p["folder"] for m in kept for p in [*m["deltas"], *([m["base"]] if m["base"] else [])]}
        for v in versions[:-keep]:
            self._delete(f"{self.path}/manifests/{v}")
        gone = [d for d in self._list(f"{self.path}/data") if d not in named]
        for d in gone:
            self._delete(f"{self.path}/data/{d}")
        return gone

    # ---- files -------------------------------------------------------------------------------
    def _hadoop(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        own = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, conf, own, own.getFileSystem(conf)

    def _list(self, path: str) -> list[str]:
        _, _, own, fs = self._hadoop(path)
        return [s.getPath().getName() for s in fs.listStatus(own)] if fs.exists(own) else []

    def _delete(self, path: str) -> None:
        _, _, own, fs = self._hadoop(path)
        fs.delete(own, True)

    def _part(self, folder: str) -> dict:
        _, _, own, fs = self._hadoop(f"{self.path}/data/{folder}")
        return {"folder": folder, "bytes": int(fs.getContentSummary(own).getLength())}

    def _commit(self, new: Manifest) -> bool:
        """Make ``new`` the newest version; False if another writer made that version first."""
        jvm, conf, aside, fs = self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{new.version:012d}.json")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        qualified = fs.makeQualified(final)
        try:  # unlike FileSystem.rename this one never replaces a file
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(fs.makeQualified(aside), qualified, options)
            return True
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(final):
                return False
            raise PySparkException(f"manifest not written: {e}") from e
