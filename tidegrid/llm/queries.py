"""The registered queries of the corpus operators: whole tables, production parameters, the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, langid, line_dedup, lm_score, neighbours, packing, quality, secrets, sharding
from .common import held_out, table

SHARDS = 24


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, metadata=("n_chars",))
    scored = quality.score(docs, model, metadata=("n_chars",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", quality.accepted(F.col("score")).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.with_digest(secrets.scan_secrets(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.backoff_scores(table(spark, sf_dir, "documents"), order=3)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, texts = langid.labelled_texts(docs, id_col="doc_id", text_col="text", lang_col="lang", chars_per_language=24_000, texts_per_language=60)
    found = langid.identify(docs, languages, texts)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, similarity=(85, 100))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_secrets, op3_lm_score, op4_language, op5_sharding, op6_packing, op7_decontaminate, op8_line_dedup, op9_neighbours, op10_jaccard)}

ORACLES: dict[str, str] = {}
