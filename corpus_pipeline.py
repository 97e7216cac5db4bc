"""A training corpus from raw documents: filter, keep one of each group of near copies, mix sources, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of
``documents``. ``run`` writes each stage's rows and reads them again.

Cases, in every stage: a null or empty text is a text without words, which the filters judge like any other (the line rules reject
it); a null ``doc_id`` or source is a value of its own; rows that repeat an id are judged each, and one of them is left after
the third stage, the one with the smallest text; further columns go along; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm import common, jaccard, line_crf, mixing, packing, quality
from lexmill.llm.queries import tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def keep_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go. The line model learns from the raw documents, which still hold bad ones."""
    raw, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return line_crf.keep_content(docs, line_crf.train(raw, labels))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays, and those without an id.

    Near copies share 80 % of their five-word sequences or more, which takes in more than op7's own contract.
    """
    groups = common.stage(jaccard.join(docs, n=5, percent=80, deletion=False), "pipeline-groups")
    first = groups.filter("component_id = doc_id").select("doc_id").distinct()
    repeated = common.stage(groups.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is not null and n > 1").select("doc_id"), "pipeline-ids")
    named = docs.join(first, "doc_id", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.coalesce("text", F.lit("")), row)).alias("row"))
    return (
        named.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(several.select("row.*"))
        .unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, shard by shard in shuffled order."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality classifier", keep_quality),
    ("quality rules", keep_content),
    ("n-gram Jaccard join", keep_one),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: No SQL: the first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, name.replace(" ", "-"))
    return docs
