"""Token budgets over messages and prompt sections, and usage totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_within(messages: DataFrame, key: str, turn: str, budget: int) -> DataFrame:
    """The newest messages of each conversation whose tokens fit the budget, up to the first that does not."""
    spent = F.sum("tokens").over(Window.partitionBy(key).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return messages.withColumn("spent", spent).where(F.col("spent") <= budget)


def fit_sections(sections: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, pos, action, used): sections(key, pos, tokens, required, may_cut) taken in order into a budget.

    A section that fits is included; one that does not is truncated to nine tenths
    of what is left, if it may be and more than 32 tokens are left; else it is
    dropped when optional and fails when required.
    """
    rows = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tokens", "required", "may_cut"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<pos:bigint,action:string,used:bigint>>").alias("out"))

    def take(state, x):
        left = F.lit(budget) - state["used"]
        fits = x["tokens"] <= left
        cut = ~fits & x["may_cut"] & (left > 32)
        spent = F.when(fits, x["tokens"]).when(cut, F.floor(left * 9 / 10)).otherwise(F.lit(0)).cast("long")
        action = F.when(fits, "included").when(cut, "truncated").when(x["required"], "failed").otherwise("dropped")
        return F.struct((state["used"] + spent).alias("used"), F.concat(state["out"], F.array(F.struct(x["pos"].cast("long").alias("pos"), action.alias("action"), spent.alias("used")))).alias("out"))

    return rows.select(key, F.inline(F.aggregate("s", start, take)["out"]))


def usage(messages: DataFrame, key: str) -> DataFrame:
    """Per run: messages and tokens read and written."""
    return messages.groupBy(key).agg(F.count("*").alias("messages"), F.sum(F.when(F.col("role") == "assistant", F.col("tokens")).otherwise(0)).alias("output"), F.sum(F.when(F.col("role") != "assistant", F.col("tokens")).otherwise(0)).alias("input"))
