"""The operators as queries over whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aq, bpe, jpeg, langid, line_dedup, packing, phrases, quotes, repair, secret_scan, simhash, voronoi, warc
from .common import saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aq.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(_table(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media, _ = saved(jpeg.to_media(_table(spark, sf_dir, "documents")), "media")
    return jpeg.features(media).drop("thumbnail")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), count_cols=("lines_kept", "lines_removed"), drop_empty=False)
    return found.select("doc_id", "lines_kept", "lines_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(_table(spark, sf_dir, "conversations"))


def op13_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_additive_quantisation, op2_language_id, op3_secret_scan, op4_warc_zstd, op5_quote_links, op6_packing, op7_jpeg, op8_line_dedup, op9_bpe, op10_simhash, op11_phrases, op12_conversation_repair, op13_voronoi_topk)}

#: Four base32 letters from each five hex digits of a SHA-1.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((('0x' || substr(sha1(body), CAST(i // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '')"""

ORACLE = {
    "op4_warc_zstd": f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digests AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest FROM bodies),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM firsts""",
    "op8_line_dedup": line_dedup.oracle(),
    "op11_phrases": phrases.oracle(),
    "op13_voronoi_topk": voronoi.oracle(),
}
