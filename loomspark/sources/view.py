"""A look at a tree of Parquet files: ``python -m loomspark.sources.view FOLDER [ROWS]``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union(spark: SparkSession, base: str) -> DataFrame:
    """The rows of all Parquet files below base, with the file of each."""
    files = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(base)
    return files.withColumn("file", F.input_file_name())


def tree(spark: SparkSession, base: str, rows: int = 5) -> str:
    """Each file with its number of rows, and the first rows of all."""
    every = union(spark, base)
    counts = every.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy("file")
    lines = [f"{r['file']}: {r['n']} rows" for r in counts.toLocalIterator()]
    return "\n".join([*lines, every.drop("file")._show_string(rows, False)])


if __name__ == "__main__":
    print(tree(SparkSession.builder.getOrCreate(), sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 5))
