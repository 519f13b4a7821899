"""The corpus pipeline: documents pass the stages in turn, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripledger.llm import decontaminate, disclosure, jaccard, packing, toxicity
from tripledger.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go."""
    return toxicity.acceptable(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return jaccard.first_of_each(docs, jaccard.Likeness(width=5, num=8, den=10))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a passage of the benchmark occurs go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced; ``n_chars`` follows the text."""
    return disclosure.sanitised(docs, length="n_chars")


def as_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, each in its place in a sequence of at most 2048 tokens."""
    # By this stage the executors' heaps have grown to their limit: workers remember less than where packing runs alone.
    return packing.packed(docs, packing.session_path(spark, "byte_bpe_50k.json"), ids=True, remembered=150_000)


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("best-fit packing", as_sequences),
]

#: Toxicity, disclosure and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
