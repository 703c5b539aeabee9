"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def best_shard(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(score, shard) of the shard with the highest score -weight / ln(u)."""
    scores = [F.struct((F.lit(-float(w)) / F.log(uniform(key, first + i))).alias("score"), F.lit(-(first + i)).alias("minus")) for i, w in enumerate(weights)]
    return F.array_max(F.array(*scores))


def assign_shards(docs: DataFrame, weights: list[float], grown: float | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """One row per row of docs: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    A key goes to the shard with the highest weighted score, so its place depends
    on the key and the shards alone, shares follow the weights, and one more shard
    (of weight `grown`) takes rows only into itself: grown_shard. slot counts the
    rows of a shard from 0 without gaps: rows are numbered inside `buckets` hash
    buckets per shard, after the exact counts of the buckets before. The table of
    those counts has len(weights) * buckets rows whatever the input, which bounds
    its broadcast. size is the UTF-8 length plus 1. Null texts count as empty, a
    null id as the empty key; rows that repeat an id share a shard and have slots
    of their own; further columns are not read; an empty table gives none.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.col("doc_id")
    placed = own.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        best_shard(key, weights).alias("best"),
        (best_shard(key, [grown], len(weights)) if grown else F.lit(None)).alias("more"),
        F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int").alias("bucket"),
    )
    shard = (-F.col("best.minus")).cast("int")
    placed = placed.withColumn("shard", shard)
    if grown:
        placed = placed.withColumn("grown_shard", F.when(F.col("more.score") > F.col("best.score"), F.lit(len(weights))).otherwise(F.col("shard")).cast("int"))
    else:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = placed.drop("best", "more")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("k", inside).join(F.broadcast(starts), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("k") - 1).alias("slot"), "grown_shard")
