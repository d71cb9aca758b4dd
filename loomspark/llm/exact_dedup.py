"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

1. One pass over the texts keeps (length, hash of the first bytes) per row.
2. Lengths of one row are out; then pairs of length and prefix hash of one row are out.
3. A second pass hashes the full content of rows whose pair survived.  Texts never go
   through a shuffle; only lengths and digests do.

Group sizes come from partial aggregation, so a group that holds a third of all rows is
reduced before the shuffle; groups of more than a thousandth of the rows go back to them by a
broadcast (fewer than a thousand groups), the others by an equi-join.  Where more pairs survive than may
be broadcast, full hashes are taken of all rows, as shuffling the texts to the pairs costs more; the
result is the same.

Defined cases: a null text counts as empty; empty texts are equal to each other; of equal
texts the row with the largest id stays (null ids are smallest); rows that repeat both id
and text are each reported as kept, and ``keep_one`` returns one of them (a null text and an empty
one are the same); an empty table
gives no rows; other columns pass through ``keep_one`` and play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted, scratch

PREFIX_CHARS = 64
#: Up to so many surviving (length, prefix) pairs are sent to every task; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: The same for the ids and digests of rows that go.
BROADCAST_LOST = 200_000


def _keys(text: Column) -> list[Column]:
    return [F.octet_length(text).cast("long").alias("_len"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_pre")]


def surviving(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The (_len, _pre) pairs that more than one row has."""
    with scratch(docs.sparkSession):
        sketch = cut(docs.select(*_keys(F.coalesce(F.col(text_col), F.lit("")))), "sketch")
        by_len = sketch.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_len")
        return cut(sketch.join(by_len, "_len", "left_semi").groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_len", "_pre"), "pairs", result=True)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: _id, keep_id, group_size, kept, text_sha256 (null where no other row could be equal, unless digest_all)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pairs = surviving(docs, text_col).withColumn("_hit", F.lit(True))
    rows = docs.select(F.col(id_col).alias("_id"), *_keys(text), text.alias("_text"))
    sha = F.sha2(F.col("_text").cast("binary"), 256)
    if pairs.count() <= BROADCAST_PAIRS:
        rows = rows.join(F.broadcast(pairs), ["_len", "_pre"], "left").withColumn("text_sha256", sha if digest_all else F.when(F.col("_hit"), sha))
    else:  # digests, not texts, go through the shuffle
        rows = rows.select("_id", "_len", "_pre", sha.alias("text_sha256")).join(pairs, ["_len", "_pre"], "left")
        rows = rows if digest_all else rows.withColumn("text_sha256", F.when(F.col("_hit"), F.col("text_sha256")))
    rows = cut(rows.select("_id", "_len", F.coalesce("_hit", F.lit(False)).alias("_hit"), "text_sha256"), "digests")
    groups = cut(rows.where("_hit").groupBy("_len", "text_sha256").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "groups")
    lone = rows.where("not _hit").select("*", F.lit(None).cast(groups.schema["_keep"].dataType).alias("_keep"), F.lit(None).cast("long").alias("_n"))
    out = join_counted(rows.where("_hit"), groups, ["_len", "text_sha256"], "_n").unionByName(lone)
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select("_id", keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that an equal text with a larger id stands for; all columns stay.

    Rows that repeat an id and a text become one.  Only the texts of rows whose id stands there
    more than once are hashed again.
    """
    g = cut(exact_groups(docs, id_col, text_col), "groups")
    often = cut(g.groupBy("_id").agg(F.count(F.lit(1)).alias("_times"), F.max("group_size").alias("_n")).where("_times > 1").select(F.col("_id").alias("_often"), "_n"), "often")
    lost = g.where("not kept").select(F.col("_id").alias("_lost_id"), F.col("text_sha256").alias("_lost_sha"))
    lost = cut(lost.join(often, F.col("_lost_id").eqNullSafe(F.col("_often")), "left").select("_lost_id", "_lost_sha", F.col("_n").isNull().alias("_sole")), "lost")
    if lost.count() <= BROADCAST_LOST:
        lost = F.broadcast(lost)
    text = F.coalesce(docs[text_col], F.lit(""))
    out = docs.join(lost, docs[id_col].eqNullSafe(lost["_lost_id"]) & (lost["_sole"] | (F.sha2(text.cast("binary"), 256) == lost["_lost_sha"])), "left_anti")
    twice = often.where("_n > 1").select("_often")
    if twice.isEmpty():
        return out
    many = out.join(twice, out[id_col].eqNullSafe(twice["_often"]), "left_semi")
    row = Window.partitionBy(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).orderBy(F.lit(0))
    many = many.select("*", F.row_number().over(row).alias("_row_of_text")).where("_row_of_text = 1").select(*docs.columns)
    return out.join(twice, out[id_col].eqNullSafe(twice["_often"]), "left_anti").unionByName(many)
