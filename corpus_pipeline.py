"""Training-text pipeline: documents without toxic ones, without near-duplicates and secrets, mixed by source, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last give documents with the columns
they came with. Nulls, empty and long texts, repeated rows and further columns are as the operators' docstrings say; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import common, mixing, packing, secrets, simhash, toxicity


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled ones rejects go."""
    return toxicity.drop_toxic(docs, toxicity.fit(*toxicity.training(spark, sf_dir)))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents joined by five-word similarity of 0.8 or more the one with the smallest id stays."""
    return simhash.keep_one_similar(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secrets.redact(docs, secrets.learn(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target asks for, some not at all, none more than three times."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("simhash_near_dedup", duplicate_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fingerprints, learned scores and token ids are beyond SQL; tests/llm/test_pipeline.py has plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written to the shared folder and read by the next."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
