"""A corpus from documents to token files: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import decontamination, minhash, mixing, tokens, toxicity
from arbora.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; it is fitted on the labelled ones among docs."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: by shingles of five words, as no contract binds the stage to two."""
    return minhash.dedup(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; a row a document with its place in them."""
    return tokens.tokenize(spark, docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", contaminated), ("mixing", mixed), ("token_ids", token_ids)]

#: SQL can't express the classifier, the forest and the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        docs = before = out
    return docs
