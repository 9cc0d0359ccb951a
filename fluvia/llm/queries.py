"""The queries ``opN_<name>``: each operator over its whole table, with production parameters.

Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns have the results that the operators' modules state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import bpe, decontaminate, langid, longest_match, lsh_forest, quality, repair, shards, topk, wrapper
from fluvia.llm.common import table
from fluvia.llm.tokenize import default_path


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return lsh_forest.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document."""
    return longest_match.token_counts(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.tiktoken"))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law ``bytes``."""
    return shards.balanced(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrapper.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out third."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out third."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the written files."""
    folder = repair.write_documents(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
    return repair.read_digests(spark, folder)


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that stands in a document within its edit budget."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of every fiftieth vector id."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_jaccard_join,
        op3_token_counts,
        op4_balanced_shards,
        op5_main_text,
        op6_quality,
        op7_language,
        op8_repair_token_files,
        op9_benchmark_leaks,
        op10_exact_top_k,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_top_k": """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
