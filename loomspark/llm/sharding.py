"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group.  Groups are dealt to buckets by a hash of their digest.
In a bucket every group starts as a partial partition (its bytes in one part, 0 in the
others); the two partial partitions of the largest spread are combined, the largest parts of one
with the smallest of the other, until one is left.  The buckets' partial partitions (so many
numbers as there are shards each) are combined in the same way in a tree of tasks, which gives every
bucket a permutation of its parts; nothing comes to the driver.

Groups are indivisible, so a group larger than one shard's even share makes its shard that much
larger, and the others share the rest evenly.  Where equal bytes matter more than whole groups, ``split``
deals such a group to runs of rows, each of which is an item like any group.

Defined cases: a null text has no bytes, but its size counts the fixed overhead; ties go by
digest and position, so runs repeat exactly; repeated rows each get a slot; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted, scratch

GROUPS_PER_BUCKET = 20_000
#: Partial partitions that one task of the tree combines.
FAN = 500


def differencing(sums: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions; (total of each part, for each input the part of each of its own).

    sums: arrays of ``parts`` totals each.  The second result has one row per input: entry j
    is the final part of the input's part j.
    """
    n = len(sums)
    place = np.tile(np.arange(parts), (n, 1))
    if not n:
        return np.zeros(parts, np.int64), place
    heap = [(-int(s.max() - s.min()), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    total: dict[int, np.ndarray] = dict(enumerate(sums))
    made: list[tuple[int, np.ndarray, int, np.ndarray]] = []  # children and where their parts went
    new = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = total.pop(a), total.pop(b)
        ox, oy = np.argsort(-x, kind="stable"), np.argsort(y, kind="stable")
        z = x[ox] + y[oy]
        to_x, to_y = np.empty(parts, np.int64), np.empty(parts, np.int64)
        to_x[ox] = to_y[oy] = np.arange(parts)
        total[new] = z
        made.append((a, to_x, b, to_y))
        heapq.heappush(heap, (-int(z.max() - z.min()), new))
        new += 1
    root = heap[0][1]
    moved = {root: np.arange(parts)}
    for k in range(len(made) - 1, -1, -1):  # from the root down
        to = moved.pop(n + k)
        a, to_x, b, to_y = made[k]
        moved[a], moved[b] = to[to_x], to[to_y]
    for i in range(n):
        place[i] = moved[i]
    return total[root], place


def _bucket_parts(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_bytes", "key", "run"], ascending=[False, True, True], kind="stable")
        sums = []
        for b in pdf["item_bytes"].to_numpy():
            s = np.zeros(parts, np.int64)
            s[0] = b
            sums.append(s)
        total, place = differencing(sums, parts)
        return pd.DataFrame({"bucket": pdf["bucket"], "key": pdf["key"], "run": pdf["run"], "n": pdf["n"], "part": place[:, 0].astype("int32"), "part_bytes": total[place[:, 0]]})

    return run


def _combined(parts: int):
    """Combine the partial partitions of a node of the tree: where each part of each of them goes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "part"], kind="stable")
        ids = pdf["bucket"].unique()
        sums = np.zeros((len(ids), parts), np.int64)
        sums[np.searchsorted(ids, pdf["bucket"].to_numpy()), pdf["part"].to_numpy()] = pdf["part_bytes"].to_numpy()
        total, place = differencing(list(sums), parts)
        return pd.DataFrame({"bucket": np.repeat(ids, parts), "part": np.tile(np.arange(parts, dtype=np.int32), len(ids)), "up": pdf["up"].iloc[0], "to_part": place.ravel().astype(np.int32), "to_bytes": total[place.ravel()]})

    return run


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, split: int | None = None) -> DataFrame:
    """One row per input row: _id, size, text_crc32, shard and slot (gapless from 0 in id order).

    split: None keeps every group whole; a number lets a group larger than one shard's even share be
    dealt to runs of about that part of the share.
    """
    with scratch(docs.sparkSession):
        placed = cut(_placed(docs, shards, id_col, text_col, overhead, split), "placed", result=True)
    return slots(placed)


def _placed(docs: DataFrame, shards: int, id_col: str, text_col: str, overhead: int, split: int | None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    rows = cut(docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.substring(F.sha2(raw, 256), 1, 32).alias("key")), "sizes")
    groups = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")), "groups")
    sums = groups.agg(F.sum(F.col("n") * F.col("size")).alias("b"), F.count(F.lit(1)).alias("g")).first()
    rows = rows.withColumn("run", F.lit(0))
    items = groups.select("key", F.lit(0).alias("run"), "n", (F.col("n") * F.col("size")).alias("item_bytes"))
    if split:
        share = max(1, (sums["b"] or 0) // shards)
        large = groups.where(F.col("n") * F.col("size") > share).select("key", F.ceil(F.col("n") * F.col("size") * split / share).cast("int").alias("runs"))  # fewer than `shards` groups
        # the rows of a run: dealt by a hash of the id, so runs hold about equally many rows; counted below
        rows = rows.join(F.broadcast(large), "key", "left").withColumn("run", F.coalesce(F.pmod(F.xxhash64("_id", F.lit(7)), F.col("runs")), F.lit(0)).cast("int")).drop("runs")
        items = rows.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("item_bytes"))
    buckets = max(1, -(-sums["g"] // GROUPS_PER_BUCKET))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("key", "run"), F.lit(buckets)))
    dealt = cut(items.groupBy("bucket").applyInPandas(_bucket_parts(shards), "bucket long, key string, run int, n long, part int, part_bytes long"), "parts")
    # a tree of FAN buckets a node, up to one partition of all; then the way down to each bucket's parts
    tops, levels = dealt.select("bucket", "part", "part_bytes").distinct(), []
    while buckets > 1:
        buckets = -(-buckets // FAN)
        level = tops.withColumn("up", F.floor(F.col("bucket") / FAN)).groupBy("up").applyInPandas(_combined(shards), "bucket long, part int, up long, to_part int, to_bytes long")
        levels.append(cut(level, "level"))
        tops = levels[-1].select(F.col("up").alias("bucket"), F.col("to_part").alias("part"), F.col("to_bytes").alias("part_bytes")).distinct()
    where = None
    for level in reversed(levels):
        level = level.select("bucket", "part", "up", "to_part")
        where = level.select("bucket", "part", F.col("to_part").alias("shard")) if where is None else level.join(where.toDF("up", "to_part", "shard"), ["up", "to_part"]).select("bucket", "part", "shard")
    placed = dealt.join(where, ["bucket", "part"]) if where is not None else dealt.withColumn("shard", F.col("part"))
    of_item = cut(placed.select("key", "run", "n", "shard"), "items")
    return join_counted(rows, of_item, ["key", "run"], "n").select("_id", "size", "text_crc32", "shard")


def slots(placed: DataFrame) -> DataFrame:
    """slot: 0, 1, 2 … in each shard in id order, numbered in ranges of shard and id and then shifted."""
    n = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["shard", "_id", "text_crc32", "size"]
    placed = cut(placed.repartitionByRange(n, *order).withColumn("piece", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("before"))  # at most a row for each shard and piece that meet: n + shards
    own = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(*order[1:])) - 1
    return placed.withColumn("own", own).join(F.broadcast(before), ["shard", "piece"]).select("_id", "size", "text_crc32", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"))
