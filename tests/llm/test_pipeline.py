"""The pipeline's stages against what they are told to keep, and the SQL oracles."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import queries  # noqa: E402


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        after = spark.createDataFrame(after.collect(), after.schema)
        assert after.columns == columns, name
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        docs = after
    assert 0.7 * n < docs.count() <= n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).filter("`sum(length)` <> `max(doc_tokens)`").count() == 0


def test_run_on_odd_and_empty_tables(spark, sf_dir, tmp_path):
    """run() itself: nulls anywhere, repeated rows, very long texts, clashing names, and no rows at all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = " ".join(r[0] for r in docs.filter("lang = 'en'").select("text").limit(40).collect())
    odd = [(None, "the of and", None, None, None), (90_001, None, "en", "s", 0), (90_002, "", "en", "s", 0), (90_003, "   ", None, "s", 3), (90_004, words * 3, "en", "s", 1), (90_004, words * 3, "en", "s", 1)]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    names = ("score", "rejected", "lang_pred", "fp", "node", "component", "lines", "hashes", "length", "record_type")
    every.withColumns({c: F.lit("x") for c in names}).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    per = {r["doc_id"]: (r["n"], r["t"]) for r in got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert all(n == t for n, t in per.values())
    assert not {90_001, 90_002, 90_003} & set(per) and per[90_004][0] > 1_000
    assert len(per) > 0.7 * docs.count()
    docs.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())
