"""Training sequences from ``documents``: five stages, each written as Parquet and read again by the next one.

All stages but the last return the columns of ``documents``; the last returns the pieces of the packed sequences. Every decision takes effect:
rejected documents, copies and near copies are gone, and a document that the mix takes twice is there twice.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from specval.llm import exact, mixing, ngram_join, packing, quality
from specval.session import clear_scratch, materialize, scratch_scope


def own_scratch(stage):
    """Gives the stage a place of its own for intermediate tables, and drops those of the other stages: their results are written by now."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for other in {f.__name__ for _, f in STAGES} - {stage.__name__}:
            clear_scratch(spark, f"stage-{other}")
        scratch_scope(spark, f"stage-{stage.__name__}")
        try:
            return stage(spark, docs, sf_dir)
        finally:
            scratch_scope(spark, "main")

    return run_stage


@own_scratch
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on those of ``docs`` that have a label and aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels)


@own_scratch
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return exact.drop_exact_copies(docs)


@own_scratch
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the row with the smallest id."""
    return ngram_join.drop_similar(docs)


@own_scratch
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it."""
    return mixing.mixed(docs)


@own_scratch
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: SQL cannot express the classifier, the similarity groups and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        scratch_scope(spark, f"result-{k}")
        docs = materialize(made, name)
        if before is not None:
            clear_scratch(spark, before)
        before = f"result-{k}"
    clear_scratch(spark, f"stage-{STAGES[-1][1].__name__}")
    scratch_scope(spark, "main")
    return docs
