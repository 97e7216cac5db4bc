import pytest

#: Texts of every awkward kind: null, empty, blank, one word, repeated rows, a very long one.
TEXTS = [
    None, "", "  \n\t ", "word", "One two three four five.", "One two three four five.", "  lead and  double  spaces\n\nand lines \n",
    "Ünï cödé 漢字 🙂 <|endoftext|> it's", "long " * 30_000, "a b", "x\x1cy\x85z\xa0w",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column and further columns whose names clash with the operators' own."""
    rows = [(i if i != 3 else None, t, "src" if i % 3 else None, i, "x", 1.0) for i, t in enumerate(TEXTS)]
    rows.append(rows[4])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, block string, score double")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
