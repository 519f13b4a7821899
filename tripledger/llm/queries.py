"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm import (
    decontaminate,
    disclosure,
    grid_order,
    hard_negatives,
    id_file,
    jaccard,
    kd_search,
    licences,
    packing,
    prefix_trie,
    quality,
    toxicity,
    warc,
)
from tripledger.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = packing.session_path(spark, "byte_bpe_50k.json")
    return packing.packed(table(spark, sf_dir, "documents"), path)


@_query
def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = packing.session_path(spark, "word_bpe_49k.json")
    return id_file.read(id_file.write(table(spark, sf_dir, "documents"), path))


@_query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), jaccard.Likeness(width=3, num=90, den=100))


@_query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(spark, warc.write(table(spark, sf_dir, "pages")))


@_query
def op8_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(table(spark, sf_dir, "documents"))


@_query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"))


@_query
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``source/part/lang/doc_id.txt`` with 1024 ids to a part. One in which the scan finds a
    licence is a licence file of its part and lies there."""
    found = licences.matched(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    speaks = F.col("own").isNotNull()
    part = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1024).cast("string"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.when(speaks, F.concat_ws("/", part, name)).otherwise(F.concat_ws("/", part, "lang", name))
    path = F.when(F.col("doc_id").isNotNull(), path)  # a document without an id is no file of any part
    result = licences.inherited(found.select("doc_id", "own", "cosine", path.alias("path"), speaks.alias("speaks")), ("doc_id",))
    return result.select("path", "own", "cosine", "licence", "origin", "directory", "doc_id")


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), moved)


@_query
def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_order.near_vectors(table(spark, sf_dir, "embeddings"))
