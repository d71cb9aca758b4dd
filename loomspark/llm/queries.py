"""The registered queries of this package and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, jaccard_join, kn_lm, license_scan, pu_quality, sentencepiece_trie, sharding, token_file, url_filter
from .common import text_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def quality_scorer(spark: SparkSession, docs: DataFrame, sf_dir: str) -> pu_quality.Scorer:
    return pu_quality.fit(docs, table(spark, sf_dir, "labels"), fold(4) != 2)


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = pu_quality.score(docs, quality_scorer(spark, docs, sf_dir))
    return scored.select(F.col("_id").alias("doc_id"), "score").select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.withColumnRenamed("_id", "doc_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("_id", "doc_id")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))
    return rows.withColumnRenamed("_id", "doc_id")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kn_lm.fit(docs, where=fold(10) != 0)
    scored = kn_lm.score(docs, model).withColumnRenamed("_id", "doc_id")
    return scored.select("doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


#: The contract's rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, RULES))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_file.write(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_file.read(spark, folder).withColumnRenamed("_id", "doc_id")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_trie.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False)
    return out.withColumnRenamed("_id", "doc_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "span_labels", "span_starts", "span_ends", "span_edits")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pu_quality, op2_decontamination, op3_exact_dedup, op4_jaccard_join, op5_kneser_ney, op6_url_filter, op7_token_file, op8_sentencepiece, op9_license_scan, op10_sharding)}


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT doc_id, CASE WHEN n > 1 THEN keep_id ELSE doc_id END AS keep_id, CAST(n AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP6_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, r_host, r_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT DISTINCT host, path, r_host || r_path AS rule, verdict,
             row_number() OVER (PARTITION BY host, path ORDER BY length(r_host || r_path) DESC, verdict DESC, r_host) AS k
      FROM (SELECT DISTINCT host, path FROM h) JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON m.host = h.host AND m.path = h.path AND m.k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op6_url_filter": OP6_SQL}
