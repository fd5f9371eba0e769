"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of their docs; the last returns a row per piece, with its
place in a sequence. A stage leaves the tables that its lazy result reads in the shared folder; ``run``, which
writes each stage before the next, removes them and its own tables, but those of the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossierlake.llm import decontam, exact, minhash, packing, quality
from dossierlake.llm._scratch import Scratch, stage_tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the rated ones among them, doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_selected(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, packed."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact", drop_exact),
    ("near", drop_near),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The regression, the sketches and the packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with stage_tables(spark):
            docs = between.keep(stage(spark, docs, sf_dir), name)
        if k:
            between.discard(STAGES[k - 1][0])
