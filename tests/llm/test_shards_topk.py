import itertools
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluvia.llm import queries, shards, topk


def test_differencing_is_tight_and_whole():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1000, 200).tolist()
    places = shards.differencing([[s] + [0] * 7 for s in sizes])
    sums = [0] * 8
    for s, p in zip(sizes, places, strict=True):
        sums[p[0]] += s
        assert sorted(p) == list(range(8))
    assert max(sums) - min(sums) <= 3
    assert shards.differencing([]) == []
    best = min(max(sum(s for s, b in zip(sizes[:6], bins) if b == k) for k in range(2)) for bins in itertools.product(range(2), repeat=6))
    two = shards.differencing([[s, 0] for s in sizes[:6]])
    assert max(sum(s for s, p in zip(sizes[:6], two) if p[0] == k) for k in range(2)) <= 7 / 6 * best


@pytest.mark.parametrize("n", [0, 1, 400])
def test_shards_hold_whole_groups_and_gapless_slots(spark, n):
    texts = [None if i % 50 == 3 else "" if i % 50 == 4 else "hot" if i % 3 == 0 else "é" * (i * 7 % 301) for i in range(n)]
    df = spark.createDataFrame([(i if i % 40 else None, t, "law", 1) for i, t in enumerate(texts)], "doc_id long, text string, shard string, bucket int")
    got = shards.balanced(df).toPandas()
    assert len(got) == n
    by_crc = {}
    for _, r in got.iterrows():
        assert by_crc.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    assert sorted(zip(got["size"], got["text_crc32"], strict=True)) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    if n == 400:
        sums = got.groupby("shard")["size"].sum()
        assert len(sums) == 8 and sums.max() - sums.min() < 0.02 * sums.mean()


@pytest.mark.parametrize("groups", [1, 60])
def test_shards_equal_differencing_of_the_tasks_in_memory(spark, monkeypatch, groups):
    """Whole documents of the smallest table: rows and groups by a dictionary, sums against the largest group and the mean."""
    monkeypatch.setattr(shards, "TASK_GROUPS", groups if groups > 1 else 10**6)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = shards.balanced(docs).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()} and len(got) == len(texts)
    place = {}
    assert all(place.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"] for r in got)
    sums = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    weight = {}
    for t in texts.values():
        weight[t] = weight.get(t, 0) + len(t.encode()) + 1
    if groups == 1:
        order = sorted(weight.values(), reverse=True)
        places = shards.differencing([[w] + [0] * 7 for w in order])
        alone = [0] * 8
        for w, p in zip(order, places, strict=True):
            alone[p[0]] += w
        assert max(sums) - min(sums) <= 2 * (max(alone) - min(alone)) + 2
    assert max(sums) <= max(max(weight.values()), sum(sums) / 8 * (1.02 if groups == 1 else 1.1))
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 70)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 6) / 4], 1, "x") for i in range(300)]
    rows += [(300, None, 1, "x"), (350, [float("nan")] * 6, 1, "x"), (None, [1.0] * 6, 1, "x"), (301, [1.0, None], 1, "x"), (302, [9.0, 9.0], 1, "x"), (400, [float("inf")], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()}
    sound = {i: np.floor(256 * np.array(v + [0] * (6 - len(v)))).astype(int) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in sound if i % 50 == 0):
        best = sorted(((-int(sound[q] @ v), i) for i, v in sound.items() if i != q))[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    few = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0, 5).collect()] == [(0, 1, 7, 256 * 512)]
    assert topk.top_k(few.where("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("blocks", [(70, 3), (8192, 2048)])
def test_top_k_with_repeated_ids_equals_sql(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(300)]
    # The best candidate five times, one twice, one id on two vectors, and queries on equal and on two vectors.
    rows += [(7, [0.75] * 6)] * 5 + [(8, [-0.75] * 6)] * 2 + [(9, [0.5, -0.75, 0.25, 0.5, -0.5, 0.75]), rows[50], (100, [-0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    con = duckdb.connect()
    con.register("given", pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    con.execute("CREATE VIEW embeddings AS SELECT * FROM given")
    want = con.execute(queries.ORACLE_SQL["op10_exact_top_k"]).fetchall()
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 30
