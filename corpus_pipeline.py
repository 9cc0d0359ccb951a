"""A training corpus from documents: the stages in order, each on what the stage before kept.

Defined cases: null and empty texts are judged by their quality score like others, and have no language, so they go; rows with a
null id are judged like others, and are near copies only of rows with a null id and an equal text; repeated rows are copies,
of which one stays; an id on several texts is several rows; of linked texts the one of least id stays; texts of any length are
read whole; further columns, whatever their names, go through all stages but the last unchanged; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluvia.llm import bpe, decontaminate, langid, lsh_forest, quality
from fluvia.llm.common import prepare, stored, table
from fluvia.llm.tokenize import default_path


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches."""
    prepare(spark)
    return langid.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id."""
    prepare(spark)
    return lsh_forest.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    prepare(spark)
    return bpe.round_trip_digests(docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_text),
    ("language", known_language),
    ("near copies", one_of_each),
    ("benchmark", without_benchmark),
    ("tokens", token_digests),
]

#: Classifiers and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage keeps is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
