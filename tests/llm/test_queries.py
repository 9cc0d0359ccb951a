import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fluvia.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_every_operator_is_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_top_k_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op10_exact_top_k"]).fetchall()
    got = queries.op10_exact_top_k(spark, DATA).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_contract_columns(spark):
    wanted = {
        "op1_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op4_balanced_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op5_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op6_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op7_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op8_repair_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op10_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    }
    for name, columns in wanted.items():
        found = dict(queries.QUERIES[name](spark, DATA).dtypes)
        assert {c: found.get(c) for c in columns} == columns, name


def test_pipeline_stages_work_on_what_was_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(kept.collect(), kept.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    want = {r["doc_id"]: r["ids_sha256"] for r in last.collect()}
    assert want == {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, DATA).collect()}
    leaky = {r["doc_id"] for r in queries.op9_benchmark_leaks(spark, DATA).select("doc_id").distinct().collect()}
    assert not leaky & set(want)
    classes = {r["doc_id"]: r["class_id"] for r in queries.op2_jaccard_join(spark, DATA).collect()}
    assert len({classes[d] for d in want}) == len(want)


def test_empty_tables_go_through(spark, tmp_path):
    for name in ("documents", "pages", "embeddings", "benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").where("false").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_null_ids_repeats_long_texts_and_clashing_names(spark, tmp_path):
    """Rows made of a document that all stages keep: one of its copies stays, unique texts under shared and null ids stay."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    whole = sorted((r for r in docs.collect() if r["doc_id"] in kept and len(r["text"]) > 900), key=lambda r: r["doc_id"])[:3]
    halves = [(" ".join(w.split()[: len(w.split()) // 2]), " ".join(w.split()[len(w.split()) // 2 :])) for w in (r["text"] for r in whole)]
    lang = whole[0]["lang"]
    long = " ".join(r["text"] for r in docs.collect() if r["doc_id"] in kept and r["lang"] == lang)
    assert len(long) > 50_000
    odd = [(10**6, halves[0][0], lang), (10**6, halves[0][0], lang), (10**6, halves[0][1], lang), (None, halves[1][0], lang), (None, halves[1][0], lang), (None, halves[1][1], None), (10**6 + 1, long, lang), (10**6 + 2, None, None), (10**6 + 3, "", "en")]
    more = spark.createDataFrame([(*r[:2], r[2], "odd", 1) for r in odd], docs.schema)
    names = ("score", "stats", "c", "class_id", "keeper", "n", "gone", "size", "ids", "item_id", "rejected", "_c", "key", "held_out")
    both = docs.unionByName(more)
    for name in names:
        both = both.selectExpr("*", f"'x' AS {name}")
    both.write.parquet(str(tmp_path / "documents.parquet"))
    stage_docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = stage_docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = stage(spark, stage_docs, str(tmp_path))
        assert stage_docs.columns == columns
        stage_docs = spark.createDataFrame(stage_docs.collect(), stage_docs.schema)
    left = stage_docs.where("source = 'odd'").collect()
    assert sorted((str(r["doc_id"]), r["text"][:60]) for r in left) == sorted({(str(i), t[:60]) for i, t, _ in odd if t})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} >= {10**6, None, 10**6 + 1} and sum(r["doc_id"] == 10**6 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 2
