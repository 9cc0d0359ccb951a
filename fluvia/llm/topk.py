"""Exact top-k inner-product search by term-at-a-time accumulation.

Queries and candidates are dealt into blocks; a pair of blocks meets in one task.  There each term (vector
component) in turn scatters its query weights times its postings into a dense array of scores, the k best
of each row are selected by partition, and the blocks' lists are merged per query.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a
null id; missing trailing components count as zero; rows with equal ids are rows of their own, as candidates and
as queries, whose candidates are ranked together under their id; a row is no candidate of a query with its id;
fewer than k candidates give as many ranks; scores are 64-bit, so components must stay below about 10^8 after scaling; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 8192, 2048


def quantised(embedding: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null unless all components are finite numbers."""
    x = F.col(embedding).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * scale)))


def accumulate(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """Dense scores [query, candidate]: one term after another scatters weight times postings."""
    terms = max((len(v) for v in [*queries, *candidates]), default=0)
    weights = np.zeros((terms, len(queries)), np.int64)
    postings = np.zeros((terms, len(candidates)), np.int64)
    for i, v in enumerate(queries):
        weights[: len(v), i] = v
    for i, v in enumerate(candidates):
        postings[: len(v), i] = v
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    scaled = np.empty_like(scores[0])
    for term in range(terms):
        for q in np.flatnonzero(weights[term]):
            np.multiply(postings[term], weights[term, q], out=scaled)
            scores[q] += scaled
    return scores


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows, ties to the smaller id."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), quantised(embedding).alias("v"), is_query.alias("q")).where("v is not null and vec_id is not null")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    block = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    candidates = rows.select("vec_id", "v", F.lit(False).alias("q"), block(blocks).alias("cb")).withColumn("qb", each(query_blocks))
    queries = rows.where("q").select("vec_id", "v", F.lit(True).alias("q"), block(query_blocks).alias("qb")).withColumn("cb", each(blocks))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        is_q = group["q"].to_numpy()
        vec_id, v = group["vec_id"].to_numpy(), group["v"].to_numpy()
        # In id order, a stable sort by score keeps the smaller id first.
        own, other = np.flatnonzero(is_q), np.flatnonzero(~is_q)
        other = other[np.argsort(vec_id[other], kind="stable")]
        out = []
        for at in range(0, len(own), 256):
            part = own[at : at + 256]
            scores = accumulate(list(v[part]), list(v[other]))
            for i, q in enumerate(part):
                row = scores[i]
                free = vec_id[other] != vec_id[q]
                if not free.all():
                    row, ids = row[free], vec_id[other][free]
                else:
                    ids = vec_id[other]
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    above, level = np.flatnonzero(row > least), np.flatnonzero(row == least)
                    found = np.concatenate([above, level[: k - len(above)]])
                else:
                    found = np.arange(len(row))
                out.append(pd.DataFrame({"query_id": vec_id[q], "vec_id": ids[found], "score": row[found]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})

    found = queries.select(*candidates.columns).unionByName(candidates).groupBy("qb", "cb").applyInPandas(best, "query_id long, vec_id long, score long")
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(over).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
