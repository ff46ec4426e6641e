"""A training corpus from raw documents: five stages, each an operator of brookql.llm over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookql.llm import exact_spans, mixing, near_dups, pieces, toxicity
from brookql.llm.shared import discard, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half; the model learns from the labels of the documents given."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("toxicity < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: that with the smallest id, once; rows without an id all stay."""
    docs = docs.select(*COLUMNS)
    kept = near_dups.link(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    once = F.row_number().over(W.partitionBy("doc_id").orderBy("text", "source", "lang", "n_chars"))
    some = docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").withColumn("once", once).where("once = 1")
    return some.select(*COLUMNS).union(docs.where("doc_id is null"))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur elsewhere; n_chars follows, and a document left empty stays as such."""
    left = exact_spans.remove_repeats(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    return mixing.mix(docs.select(*COLUMNS))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding them gives its text back."""
    return pieces.encode(docs.select("doc_id", "source", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("span_dedup", drop_repeated_spans),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]
#: Neither the models nor the suffix arrays can be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
