"""The corpus pipeline: toxic documents out, one document of each near-duplicate group, benchmark passages out, secrets masked, sources mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import decontaminate, mixing, secrets, shingle_join, toxicity
from tidepanel.llm.common import in_small_batches, kept
from tidepanel.llm.queries import table


#: Words of a shingle, and percent of similarity, of near duplicates.
COPY_WIDTH, COPY_SIMILAR = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of the documents given."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest id."""
    return shingle_join.first_of_each(in_small_batches(docs), COPY_WIDTH, COPY_SIMILAR)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redacted(in_small_batches(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture draws, with the number of times each is seen and its turn."""
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_copies),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The first stage rests on a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
