import pyarrow as pa
from pyspark.sql import types as T

from lexmill.operators import embed


def test_texts_leave_the_encoder_in_small_batches():
    class Table:
        schema = T.StructType([T.StructField("text", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_pydict({"text": [f"word{i} and word{i % 7}" for i in range(1000)] + [None]})
    out = list(embed.embed(Table())(iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and [t for b in out for t in b.column("text").to_pylist()] == batch.column("text").to_pylist()
