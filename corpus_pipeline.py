"""The corpus pipeline: quality, language, near duplicates, benchmark leaks, then mixing by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, langid, mixing, ngram_join, quality
from lexiloom.llm.common import materialise, release, scratch_mark, table

LEAST_LANGUAGE_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on all labels, does not reject. Null and empty texts are scored like
    any text without words; without labels nothing is rejected."""
    return quality.quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: letters, and a score that shows one language ahead of the others. Where no row has a lang
    to learn from, nothing can be told about any, and all rows stay."""
    if docs.where("lang is not null").isEmpty():
        return docs
    found = langid.languages(docs)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each class of linked texts; ids that repeat or are null don't matter to it."""
    return ngram_join.first_of_classes(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("item_ids") == 0).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them, in order of virtual finish time. Texts without words
    are never taken; null ids and sources are values like others."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents; each stage's rows are written as Parquet and read again, and what a stage
    has read and written on the way is then deleted. Columns that clash with an operator's are replaced by it within a
    stage and come back as they were, since every stage but the last returns the columns that it was given."""
    docs = table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
