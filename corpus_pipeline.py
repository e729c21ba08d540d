"""Training-corpus pipeline: each stage is one operator of pitspark.llm; its output is written and read as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitspark.llm import decontaminate, mixing, quality, simhash, token_output
from pitspark.llm.common import delete_path, inside, materialise, new_path
from pitspark.llm.queries import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half or more of a benchmark item go."""
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), keep=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; what a block cuts out of a document is a row of its own."""
    return mixing.mixed_documents(docs, blocks_per_shard=32)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; the rows are their index."""
    return token_output.write_token_shards(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-id output", token_stage),
]

#: No stage but decontamination could be put in SQL: trained scores, fingerprints, a seeded selection and a tokenizer decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`. What a stage worked with goes once its output is written, and that once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        label = name.replace(" ", "-")
        after = new_path(spark, label)
        with inside(spark, f"{label}-work") as work:
            try:
                docs = materialise(stage(spark, docs, sf_dir), label, after)
            except BaseException:
                delete_path(spark, after)
                raise
            finally:
                delete_path(spark, work)
                if before:
                    delete_path(spark, before)
        before = after
    try:
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        delete_path(spark, before)
