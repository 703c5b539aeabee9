"""Exact deduplication by a 128-bit content hash with comparison of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    Rows are grouped by the MD5 of their text and, inside a hash, by the bytes
    themselves, so a collision splits into groups of its own. Grouping combines on
    the map side: of a text that fills a third of the table, each task sends one
    row. keep ("min" or "max") says which id of a group stays. Null texts count as
    empty. Rows that repeat the id that stays are all kept. A null id is never
    preferred; a group of null ids only keeps them all. Further columns are not
    read; an empty table gives an empty result.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("h", F.unhex(F.md5("text")))
    groups = own.groupBy("h", "text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Digest after grouping: texts leave the plan here, and the join below has two exchanges that can be split.
    groups = groups.select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    rows = own.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
    out = rows.join(groups.hint("merge"), ["h", "text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
