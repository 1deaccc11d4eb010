"""The pipeline's stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosswise.llm.chunks import drop_repeats
from crosswise.llm.packing import pack_documents
from crosswise.llm.queries import table, vocabulary
from crosswise.llm.resemblance import drop_resembling
from crosswise.llm.suffixes import decontaminate
from crosswise.llm.toxicity import drop_toxic, train


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_resembling(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", repeats_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
