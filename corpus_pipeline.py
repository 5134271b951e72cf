"""The corpus pipeline: five stages over documents, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pressmark.llm import bpe_tree, order_minhash, packing, quality_crf, quality_rules, suffix_dedup
from pressmark.session import shared_folder


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier calls good; it is fitted on the labelled documents of sf_dir.

    A null text is empty and judged as such; repeated rows and ids are judged row by row; an empty table stays empty.
    """
    return quality_crf.keep(docs, quality_crf.fit(*_labelled(spark, sf_dir)))


def quality_rule(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; these are fitted on the labelled documents of sf_dir.

    Cases as in quality_classifier.
    """
    return quality_rules.keep(docs, quality_rules.fit(*_labelled(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id.

    Texts without a word stay; of equal rows one stays; a null id comes last among equals.
    """
    return order_minhash.keep(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of 200 bytes or more that repeat; what is left may be empty.

    A null text stays null; texts shorter than 200 bytes lose nothing; repeated rows lose what they share.
    """
    return suffix_dedup.cleaned(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens.

    A null text is one piece of its end token.
    """
    return packing.pieces(docs, bpe_tree.tokenizer_file())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

#: Learned models have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder as Parquet and read again; a stage's input goes when its output is there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            gone = spark._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return docs
