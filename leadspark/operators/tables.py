"""Keyed tables: upserts, latest versions, intervals, caches, merges and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], seq: str, updated: list[str], kept: list[str]) -> DataFrame:
    """One row per key: updated columns from the last write, kept ones from the first."""
    rows = existing.unionByName(incoming)
    return rows.groupBy(*key).agg(*[F.max_by(c, seq).alias(c) for c in updated], *[F.min_by(c, seq).alias(c) for c in kept])


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """existing and the incoming rows whose key it lacks."""
    return existing.unionByName(incoming.join(existing, key, "left_anti"))


def latest_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def number_rows(rows: DataFrame, keys: list[str], run: Column, order: list, name: str = "rank") -> DataFrame:
    """rows with `name`: the place of each row (from 1) among the rows of its keys, ordered by run, then order.

    Rows are numbered inside runs, after the counts of the runs before, so no task
    sorts a whole key; null keys are keys. rows is read twice: write it first where it
    is costly.
    """
    own = rows.withColumn("__run", run)
    counts = own.groupBy(*keys, "__run").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__run").alias("__of"), F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(*order))
    met = F.col("__run").eqNullSafe(F.col("__of"))
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    numbered = own.withColumn("__inside", inside).join(starts.hint("merge"), met)
    return numbered.select(*rows.columns, (F.col("__start") + F.col("__inside")).alias(name))


def validity(versions: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """Approved versions with valid_from and valid_to; the next approval supersedes the one before."""
    w = Window.partitionBy(key).orderBy(at, seq)
    own = versions.where(F.col("status") == "approved").withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))
    return own.withColumn("state", F.when(F.col("valid_to").isNull(), "approved").otherwise("superseded"))


def as_of(lookups: DataFrame, entries: DataFrame, key: str, at: str, entry: str, ttl_days: int) -> DataFrame:
    """lookups with the id of the latest entry of their key that was made by then and has not expired; one sort, no range join."""
    both = lookups.select(*lookups.columns, F.lit(None).cast("long").alias("__entry"), F.lit(None).cast("timestamp").alias("__made"))
    made = entries.select(key, at, F.col(entry).alias("__entry"), F.col(at).cast("timestamp").alias("__made"))
    rows = both.unionByName(made, allowMissingColumns=True).withColumn("__is", F.when(F.col("__entry").isNull(), 1).otherwise(0))
    w = Window.partitionBy(key).orderBy(at, "__is", "__entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__last", F.last(F.when(F.col("__is") == 0, F.struct("__entry", "__made")), ignorenulls=True).over(w)).where("__is = 1")
    valid = F.col(at).cast("timestamp") < F.col("__last.__made") + F.make_interval(days=F.lit(ttl_days))
    return rows.select(*lookups.columns, F.when(valid, F.col("__last.__entry")).alias("entry"))


def reusable(cached: DataFrame, quotes: DataFrame, pages: DataFrame, contacts: DataFrame, current: DataFrame) -> DataFrame:
    """cached(key, ...) analyses that still hold, with mode: every quote (key, url, quote) stands in a page of that url, every contact (key, value) is among the current ones (key, value).

    An analysis without quotes or contacts has none that fails.
    """
    seen = quotes.join(pages.select("url", "text").hint("merge"), "url", "left").groupBy("key", "url", "quote").agg(F.bool_or(F.coalesce(F.contains("text", F.col("quote")), F.lit(False))).alias("found"))
    gone = contacts.select("key", "value").join(current.select("key", "value").hint("merge"), ["key", "value"], "left_anti")
    failed = seen.where("not found").select("key").union(gone.select("key")).distinct()
    return cached.join(failed.hint("merge"), "key", "left_anti").withColumn("mode", F.lit("cache"))


def project_policy(policies: DataFrame, views: dict[str, list[str]]) -> DataFrame:
    """Approved policies with, for each audience, the JSON of its fields."""
    own = policies.where(F.col("status") == "approved")
    return own.select("*", *[F.to_json(F.struct(*[F.col(f"policy.{f}").alias(f) for f in fields])).alias(name) for name, fields in views.items()])


def propagate(strategies: DataFrame, approved: DataFrame, market: str) -> DataFrame:
    """Open strategies of a market move to its newly approved policy: next version, queries cleared."""
    new = approved.select(market, F.col("hash").alias("__hash"))
    both = strategies.join(new, market, "left")
    moves = F.col("__hash").isNotNull() & (F.col("hash") != F.col("__hash")) & ~F.col("status").isin("completed", "failed")
    return both.select(
        *[c for c in strategies.columns if c not in ("hash", "version", "queries")],
        F.when(moves, F.col("__hash")).otherwise(F.col("hash")).alias("hash"),
        (F.col("version") + F.when(moves, 1).otherwise(0)).alias("version"),
        F.when(~moves, F.col("queries")).alias("queries"),
    )
