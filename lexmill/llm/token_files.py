"""Token-ID output: Arrow files of equal-length sequences and masks, readable at random without copying.

Each file of ``write_token_files`` holds a range of documents in ascending ``doc_id`` order as one run of
ids cut into rows of ``length`` ids: ``input_ids fixed_size_list<uint16|uint32>`` and
``mask fixed_size_list<bool>`` (false only behind the last id of a file). A memory-mapped file gives any
row without copying. Beside it lies an index file with the documents' places. The returned manifest has
one row per file and names only files of tasks that succeeded; what a lost task left is never read.

Cases: a null text is empty (its end id alone), a null ``doc_id`` comes first, equal ids keep their rows
side by side in the order of their ids' length and check sum, an empty table gives an empty manifest.
Other columns are not looked at. Files are opened through ``pyarrow.fs`` by the shared folder's URI.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .tokens import Encoder

MANIFEST = "part int, file string, n_docs long, n_tokens long"


def encode(docs: DataFrame, tokenizer: str, end_id: int, dtype: str = "<u4") -> DataFrame:
    """``doc_id, n_tokens, crc, ids``: each whole text's ids with the end id, as numbers of ``dtype``, compressed."""
    import zstandard

    end = end_id.to_bytes(4, "little")

    def work(slices):
        encoder, squeeze = Encoder.of(tokenizer), zstandard.ZstdCompressor(level=1)
        for rows in slices:
            ids = [x + end for x in encoder.encode(rows["text"])]
            packed = ids if dtype == "<u4" else [np.frombuffer(x, "<u4").astype(dtype) for x in ids]
            yield {
                "doc_id": rows["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "crc": [zlib.crc32(x) for x in ids],
                "ids": [squeeze.compress(x) for x in packed],
            }

    return common.map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")),
        {"doc_id": pa.int64(), "n_tokens": pa.int64(), "crc": pa.int64(), "ids": pa.binary()},
        "doc_id long, n_tokens long, crc long, ids binary", work,
    )


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 2048, rows_per_batch: int = 256,
    narrow: bool = True,
) -> DataFrame:
    """Write the files below ``folder`` (a URI all executors reach); the manifest, one row per file.

    Ranges of ``doc_id`` come from quantiles of that column alone, so texts are read once, encoded where
    they lie, and only compressed ids are shuffled. ``narrow`` stores 16-bit ids (vocabularies below 65,536).
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    part = F.lit(0) if not cuts else F.coalesce(
        F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))), F.lit(0))
    dtype, arrow_id = ("<u2", pa.uint16()) if narrow else ("<u4", pa.uint32())
    ordered = (
        encode(docs, tokenizer, end_id, dtype).withColumn("part", part.cast("int"))
        .repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "n_tokens", "crc")
    )
    shape = pa.schema([("input_ids", pa.list_(arrow_id, length)), ("mask", pa.list_(pa.bool_(), length))])
    index_shape = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    step = length * rows_per_batch

    def work(slices):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        fs = path = data = index = None
        part, n_docs, at, pending, held = 0, 0, 0, [], 0

        def put(flat: np.ndarray) -> None:
            pad = -len(flat) % length
            mask = np.ones(len(flat) + pad, bool)
            mask[len(flat):] = False
            ids = np.concatenate([flat, np.zeros(pad, dtype)])
            data.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(a), length) for a in (ids, mask)], schema=shape))

        for rows in slices:
            if data is None:
                fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                part = rows["part"][0]
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                fs.create_dir(root, recursive=True)
                path, streams = f"{folder}/{name}", [fs.open_output_stream(f"{root}/{name}{x}.arrow") for x in ("", ".index")]
                data, index = (pa.ipc.new_file(s, x) for s, x in zip(streams, (shape, index_shape)))
            starts = []
            for n_tokens, packed in zip(rows["n_tokens"], rows["ids"]):
                starts.append(at)
                at += n_tokens
                held += n_tokens
                pending.append(np.frombuffer(unpack.decompress(packed), dtype))
                if held >= step:
                    flat = np.concatenate(pending)
                    for k in range(0, held - held % step, step):
                        put(flat[k:k + step])
                    pending, held = [flat[held - held % step:]], held % step
            n_docs += len(starts)
            index.write_batch(pa.record_batch([pa.array(v, pa.int64()) for v in (rows["doc_id"], starts, rows["n_tokens"])], schema=index_shape))
        if data is not None:
            if held:
                put(np.concatenate(pending))
            for f in (data, index, *streams):
                f.close()
            yield {"part": [part], "file": [path], "n_docs": [n_docs], "n_tokens": [at]}

    return common.stage(common.map_batches(
        ordered, {"part": pa.int32(), "file": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64()}, MANIFEST, work
    ), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before it: the manifest's running sum plus the place in the file.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "file", F.coalesce(before, F.lit(0)).alias("before"))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = files.repartitionById(n, F.pmod("part", F.lit(n)).cast("int"))

    def work(slices):
        for rows in slices:
            for file, before in zip(rows["file"], rows["before"]):
                for batch, crcs in _digests(file):
                    starts = [before + s for s in batch["start"].to_pylist()]
                    yield {"doc_id": batch["doc_id"].to_pylist(), "start": starts, "n_tokens": batch["n_tokens"].to_pylist(), "ids_crc32": crcs}

    return common.map_batches(
        spread.select("file", "before"),
        {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()},
        "doc_id long, start long, n_tokens long, ids_crc32 long", work,
    )


def open_file(uri: str):
    """A reader of one Arrow file; memory-mapped where the file system is local."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    local = isinstance(fs, pyarrow.fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))


def ids_between(reader, start: int, stop: int, rows_per_batch: int):
    """Zero-copy views of the ids in [start, stop) of a file, batch by batch."""
    length = reader.schema.field("input_ids").type.list_size
    step = length * rows_per_batch
    while start < stop:
        k = start // step
        flat = reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        end = min(stop, (k + 1) * step)
        yield flat[start - k * step:end - k * step]
        start = end


def _digests(file: str):
    """Index batches with the check sum of every document's ids as 32-bit numbers; one batch of ids is widened at a time."""
    reader, index = open_file(f"{file}.arrow"), open_file(f"{file}.index.arrow")
    rows_per_batch = reader.get_batch(0).num_rows if reader.num_record_batches else 1
    step, at, wide = rows_per_batch * reader.schema.field("input_ids").type.list_size, -1, memoryview(b"")
    for i in range(index.num_record_batches):
        batch = index.get_batch(i)
        crcs = []
        for start, n in zip(batch["start"].to_pylist(), batch["n_tokens"].to_pylist()):
            crc, stop = 0, start + n
            while start < stop:
                k = start // step
                if k != at:
                    at, wide = k, memoryview(next(ids_between(reader, k * step, (k + 1) * step, rows_per_batch)).astype("<u4")).cast("B")
                end = min(stop, (k + 1) * step)
                crc = zlib.crc32(wide[4 * (start - k * step):4 * (end - k * step)], crc)
                start = end
            crcs.append(crc)
        yield batch, crcs
