"""Leads: scores, status, rankings, reports, exports and campaign summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_safe

STATUSES = ("qualified", "needs_review", "rejected", "approved")


# Fixed values below: points and words of scores and roles.
def score(leads: DataFrame) -> DataFrame:
    """leads(products, scales, role, high) with fit, scale, confidence, qualified and import capability."""
    fit = F.least(F.lit(98), F.col("products") * 18 + 34)
    scale = F.least(F.lit(95), F.col("scales") * 13 + 28)
    confidence = F.when(F.col("role") == "Unknown", 0.58).otherwise(F.least(F.lit(0.97), F.lit(0.76) + F.col("products") * F.lit(0.04)))
    good = ~F.col("role").isin("Retailer", "Service", "Unknown") & (fit >= 60) & (scale >= 50)
    capability = F.when(F.col("high"), "High").when(F.col("scales") > 0, "Medium").otherwise("Unknown")
    return leads.withColumns({"fit": fit.cast("long"), "scale": scale.cast("long"), "confidence": confidence, "qualified": good, "import_capability": capability})


def business_role(text: Column) -> Column:
    """A company's role by the first of these words."""
    t = F.lower(text)
    return (
        F.when(F.contains(t, F.lit("repair shop")) | F.contains(t, F.lit("retail")), "Retailer")
        .when(F.contains(t, F.lit("distributor")), "Distributor")
        .when(F.contains(t, F.lit("importer")), "Importer")
        .when(F.contains(t, F.lit("wholesaler")), "Wholesaler")
        .when(F.contains(t, F.lit("manufacturer")), "Manufacturer")
        .otherwise("Unknown")
    )


def status(confidence: Column, qualified: Column) -> Column:
    """needs_review below a confidence of 0.8, else qualified or rejected."""
    return F.when(confidence < 0.8, "needs_review").when(qualified, "qualified").otherwise("rejected")


def with_overrides(leads: DataFrame, decisions: DataFrame) -> DataFrame:
    """leads with the status of the latest manual decision(id, seq, decision) where there is one."""
    last = decisions.groupBy("id").agg(F.max_by("decision", "seq").alias("decision"))
    return leads.join(last.hint("merge"), "id", "left").withColumn("status", F.coalesce("decision", "status")).drop("decision")


def rank_leads(leads: DataFrame, keys: list[str]) -> DataFrame:
    """leads with their rank: qualified first, then fit plus scale, then domain."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("qualified"), F.desc(F.col("fit") + F.col("scale")), "domain"))
    return leads.withColumn("rank", order.cast("long"))


def compact(leads: DataFrame, key: str, cap: int) -> DataFrame:
    """The first `cap` leads of each group for a report, with how many were left out."""
    order = Window.partitionBy(key).orderBy(F.desc("qualified"), F.desc("confidence"), F.desc("fit"), F.desc("scale"), "id")
    total = F.count("*").over(Window.partitionBy(key))
    out = leads.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("omitted", F.greatest(F.lit(0), total - cap).cast("long"))
    return out.where(F.col("rank") <= cap)


def status_counts(rows: DataFrame, key: str, column: str = "status", values=STATUSES) -> DataFrame:
    """Counts by key and status, zero where there is none."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def campaign_report(leads: DataFrame, key: str) -> DataFrame:
    """Per campaign: counts by status, average scores, risks, and the five best leads."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("qualified"), F.desc(F.col("fit") + F.col("scale")), "domain"))
    ranked = leads.withColumn("__r", best)
    own = ranked.groupBy(key).agg(
        F.count("*").alias("leads"),
        F.count_if(F.col("status") == "qualified").alias("qualified"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.round(F.avg("fit"), 6).alias("avg_fit"),
        F.bool_or(F.col("orders") == 0).alias("uncontacted"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__r") <= 5, F.struct("__r", "domain")))), lambda x: x["domain"]), ",").alias("recommended"),
    )
    risks = F.filter(F.array(F.when(F.col("needs_review") > 0, F.lit("unreviewed")), F.when(F.col("qualified") == 0, F.lit("none_qualified")), F.when(F.col("uncontacted"), F.lit("coverage"))), lambda x: x.isNotNull())
    return own.withColumn("risks", F.array_join(risks, ",")).drop("uncontacted")


def export_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns made safe for spreadsheets, in a fixed order."""
    kinds = dict(rows.dtypes)
    return rows.select(*[csv_safe(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in columns])


def summary_fields(row: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value): a summary sheet, one row per field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return row.select(key, pairs.alias("p")).select(key, "p.field", "p.value")


def history(runs: DataFrame, key: str) -> DataFrame:
    """Per key: runs, the last one, sums, distinct domains, and the five most recent runs."""
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("finished"), F.desc("run")))
    ranked = runs.withColumn("__r", order)
    recent = F.transform(F.array_sort(F.collect_list(F.when(F.col("__r") <= 5, F.struct("__r", "run")))), lambda x: x["run"].cast("string"))
    return ranked.groupBy(key).agg(F.count("*").alias("runs"), F.max("finished").alias("last_run"), F.sum(F.coalesce("queries", "planned")).alias("queries"), F.countDistinct("domain").alias("domains"), F.array_join(recent, ",").alias("recent"))


def target_history(runs: DataFrame, aliases: DataFrame, mode: str = "serper") -> DataFrame:
    """history() by country of runs(country, mode, ...) in one search mode; aliases(alias, id) resolve names by trimmed lower case, and runs of unknown countries fall out."""
    known = aliases.select(F.lower(F.trim("alias")).alias("alias"), "id").distinct()
    own = runs.where(F.col("mode") == mode).withColumn("alias", F.lower(F.trim("country"))).drop("country")
    return history(own.join(known.hint("merge"), "alias").withColumnRenamed("id", "country"), "country")
