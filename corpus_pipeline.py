"""The corpus pipeline: five operators over the documents table, each stage written and read again by the next.

quality classifier > line dedup > n-gram Jaccard join > benchmark decontamination > best-fit packing
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from tidegrid.llm.common import fresh_names, removed, shared_folder, table
from tidegrid.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the given labels of these documents, accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    (score,) = fresh_names(docs, "score")
    return quality.score(docs, model, metadata=("n_chars",), keep=score).filter(quality.accepted(F.col(score))).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier line, exactly or at a similarity of 0.8 of their runs of five words."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 connect: the smallest id."""
    return jaccard_join.survivors(docs, words=5, similarity=(80, 100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The quality model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir; each stage's rows are written as Parquet to the shared folder.

    What a stage has written is removed once the next one is done with it; the last stage's rows are the result.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        own = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        if before is not None:
            removed(spark, before)
        docs, before = spark.read.parquet(own), own
    return docs
