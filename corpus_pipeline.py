"""A corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, decontamination, SentencePiece.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import decontaminate, exact_dedup, jaccard_join, pu_quality, sentencepiece_trie
from loomspark.llm.common import fresh_path, text_batches
from loomspark.llm.queries import quality_scorer, table, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.7 go."""
    text_batches(spark)
    return pu_quality.keep_good(docs, quality_scorer(spark, docs, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    text_batches(spark)
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts that links of similarity 0.8 join, the row with the smallest doc_id stays."""
    text_batches(spark)
    return jaccard_join.keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a test item's question and answer go."""
    text_batches(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and decoded_equal of each row's SentencePiece ids."""
    text_batches(spark)
    return sentencepiece_trie.encode(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False).withColumnRenamed("_id", "doc_id")


STAGES = [("quality", quality), ("exact_dedup", exact), ("jaccard", near), ("decontamination", benchmark), ("sentencepiece", encode)]

#: The classifier and the ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
