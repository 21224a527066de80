"""From raw documents to token ids: quality rules, toxicity, near-duplicates, source mix, SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of documents. `run` writes what each stage returns to the shared checkpoint folder and reads it back, so a
stage is computed once and survives lost executors; what a stage was made from goes once it is written. Each stage's own
module states what it does with nulls, empty texts, ties, repeated rows and clashing names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import near_copies, piece_bpe, quality_rules, source_mix, toxicity
from pagemill.llm.common import read
from pagemill.llm.queries import PIECES, vocabulary
from pagemill.session import delete_folder, ensure_checkpoint_dir, make_importable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to the quality rules."""
    return quality_rules.accepted(docs)


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labels of this corpus, scores below one half."""
    make_importable(spark)
    return toxicity.civil(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose five-word SimHash fingerprints BK-trees find close, and whose shingle
    sets have a Jaccard similarity of 4/5 or more."""
    make_importable(spark)
    return near_copies.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return source_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in place of its text."""
    make_importable(spark)
    return piece_bpe.encoded_documents(docs, vocabulary(PIECES))


STAGES = [
    ("quality rules", quality),
    ("toxicity", civility),
    ("near duplicates", near_duplicates),
    ("source mix", mixture),
    ("token ids", tokens),
]

#: A learned classifier decides in the second stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            delete_folder(spark, f"{folder}/{number - 1}")
    return docs
