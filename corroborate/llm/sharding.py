"""Sharding by longest processing time: groups that must stay together, largest first, each to the
least-loaded shard.

Large groups (at least ``fine`` of an even share) are scheduled one by one. There are at most
shards / fine of them, whatever the input. Smaller groups are first put into that many bundles by
hash and each bundle is scheduled like a group, so the heap's input stays bounded while every byte
is still placed by the same rule.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.llm.common import materialize


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """{item: shard} for (item, size) pairs: by size descending (ties by item), to the least load."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def assign(docs: DataFrame, shards: int = 40, fine: float = 1 / 500, doc_id: str = "doc_id", text: str = "text", chunks: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; rows with equal texts share a shard.

    size: UTF-8 bytes of the text plus 16; a null text has none and groups with the empty text
    (checksum 0). Slots are gapless from 0 in each shard, ordered by a hash chunk of the row, then
    doc_id (nulls first); fully equal rows are interchangeable. The same rows get the same slots under
    any settings of the session. An empty table gives no rows. Only doc_id and text are read, so other
    columns cannot clash; a text of any length counts by its size and checksums. A group larger than
    an even share fills its shard alone, since groups are never split. ``chunks`` is how many parts a
    shard's rows are numbered in: raise it with the rows.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), _row_size(t).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("group"))
    rows = materialize(rows, "rows")
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least, bundles = max(1, int(total / shards * fine)), int(shards / fine)
    bundle = F.pmod(F.xxhash64("group"), F.lit(bundles))
    own = F.col("bytes") >= least
    # One row for each large group and each bundle: at most 2 * shards / fine in all.
    key = F.when(own, F.xxhash64(F.lit("own"), "group")).otherwise(bundle)
    items = groups.groupBy(key.alias("item"), own.alias("own")).agg(F.sum("bytes").cast("long").alias("bytes"), F.max("group").alias("group")).collect()
    ranked = {i: r for i, r in enumerate(sorted(items, key=lambda r: (bytes(r["group"]), r["own"])))}
    placed = schedule([(i, r["bytes"]) for i, r in ranked.items()], shards)
    large = [(bytes(r["group"]), placed[i]) for i, r in ranked.items() if r["own"]]
    small = [(int(r["item"]), placed[i]) for i, r in ranked.items() if not r["own"]]
    large_df = spark.createDataFrame(large, "group binary, own_shard int")
    small_df = spark.createDataFrame(small, "bundle long, bundle_shard int")
    where = rows.withColumn("bundle", bundle)
    where = where.join(F.broadcast(large_df), "group", "left").join(F.broadcast(small_df), "bundle", "left")
    where = where.select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "bundle_shard").alias("shard"))
    return _slots(where, chunks)


def _slots(where: DataFrame, chunks: int) -> DataFrame:
    """Gapless slots without one task per shard: rows are numbered inside hash chunks, chunks by prefix sums."""
    spark = where.sparkSession
    cut = where.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(chunks)).cast("int"))
    counts = cut.groupBy("shard", "chunk").agg(F.count("*").alias("n")).collect()  # shards * chunks rows at most
    starts, at = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["chunk"])):
        starts.append((r["shard"], r["chunk"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["n"]
    first = spark.createDataFrame(starts, "shard int, chunk int, start long")
    order = Window.partitionBy("shard", "chunk").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    out = cut.withColumn("k", F.row_number().over(order)).join(F.broadcast(first), ["shard", "chunk"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("k") - 1).cast("long").alias("slot"))
