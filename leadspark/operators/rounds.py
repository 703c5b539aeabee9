"""Discovery rounds: yields, streaks, saturation, brands, exclusion filters and stop reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..sources.sinks import new_folder, stored

# Words that make no brand.
GENERIC = ("co", "company", "corp", "corporation", "enterprise", "enterprises", "establishment", "global", "group", "inc", "industries", "industry", "international", "llc", "ltd", "service", "services", "shop", "solutions", "store", "trade", "trading", "شركة", "مجموعة", "مؤسسة", "تجارة", "للتجارة")
BLOCK_PAGE = r"(?iu)(?:captcha|access denied|robot|verification|verify you are human|blocked|error|not found|页面|机器人|验证|拦截|错误|无法访问|提示)"
SATURATED, LOW_NEW = 3, 7
MAX_DOMAINS, MAX_BRANDS, FILTER_CHARS = 12, 8, 1000


def query_group(given: Column, language: Column, rationale: Column, index: Column) -> Column:
    """A query's group: the given one, or language, rationale and every three queries."""
    word = lambda c, otherwise: F.coalesce(F.nullif(text.normalize(c), F.lit("")), F.lit(otherwise))
    own = F.concat_ws("::", word(language, "unknown"), word(rationale, "legacy"), F.concat(F.lit("legacy-"), F.floor(index / 3).cast("string")))
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), own)


def is_distinctive_brand(value: Column, strategy_terms: list[str]) -> Column:
    """Whether a name tells its company apart: short, no sentence, no block page, and one word that is neither generic nor the strategy's."""
    blocked = sorted({w for t in strategy_terms for w in t.lower().split()} | set(GENERIC))
    words = text.tokens(value)
    telling = F.exists(words, lambda w: ~w.isin(blocked) & ((F.length(w) >= 4) | w.rlike(r"[^\x00-\x7F]")))
    plain = ~F.trim(value).rlike(BLOCK_PAGE) & ~F.trim(value).rlike(r"[\n\r.!?。！？]")
    return (F.length(F.trim(value)) <= 80) & (F.size(words) <= 8) & plain & (F.length(text.normalize(value)) >= 3) & telling


def low_yield_streak(rounds: DataFrame, low: Column) -> DataFrame:
    """rounds(grp, round, ...) with the number of low rounds in a row up to each round, and whether the group is saturated."""
    w = Window.partitionBy("grp").orderBy("round")
    island = F.sum(F.when(low, 0).otherwise(1)).over(w)
    own = rounds.withColumn("low", low).withColumn("__i", island)
    inside = F.sum(F.when(F.col("low"), 1).otherwise(0)).over(Window.partitionBy("grp", "__i").orderBy("round"))
    return own.withColumn("streak", F.when(F.col("low"), inside).otherwise(0).cast("long")).withColumn("saturated", F.col("streak") >= SATURATED).drop("__i")


def group_progress(rounds: DataFrame) -> DataFrame:
    """Per group: executed rounds, total new, and new count and rate of the last round."""
    return rounds.groupBy("grp").agg(
        F.count("*").alias("executed"),
        F.sum("new").alias("new_total"),
        F.max_by("new", "round").alias("last_new"),
        F.round(F.max_by(F.col("new") / F.nullif(F.col("raw"), F.lit(0)), "round"), 6).alias("last_rate"),
    )


def stop_reason(groups: DataFrame, campaign: str, executed: str, saturated: str, limit: int) -> DataFrame:
    """Why each campaign stopped: its query budget, all groups saturated, or an exhausted plan."""
    own = groups.groupBy(campaign).agg(F.sum(executed).alias("executed"), F.bool_and(saturated).alias("all_saturated"))
    reason = F.when(F.col("executed") >= limit, "max_queries").when(F.col("all_saturated"), "all_groups_saturated").otherwise("plan_exhausted")
    return own.select(campaign, "executed", reason.alias("reason"))


def brand_fingerprints(evidence: DataFrame, terms: list[str]) -> DataFrame:
    """(brand, domain, value, confidence): names from sure identity evidence of accepted leads, the last of each brand and domain."""
    own = evidence.where((F.col("kind") == "identity") & (F.col("confidence") >= 0.85) & F.col("status").isin("qualified", "approved"))
    own = own.where(is_distinctive_brand(F.col("value"), terms)).withColumn("brand", text.normalize(F.col("value")))
    return own.groupBy("brand", "domain").agg(F.max_by(F.trim("value"), "pos").alias("value"), F.max_by("confidence", "pos").alias("confidence"))


def unique_brands(brands: DataFrame) -> DataFrame:
    """Brands that one domain alone carries."""
    once = brands.groupBy("brand").agg(F.countDistinct("domain").alias("n")).where("n = 1")
    return brands.join(once.select("brand"), "brand", "left_semi")


def fill_budget(candidates: DataFrame, key: str, chars: int = FILTER_CHARS) -> DataFrame:
    """(key, filters, used): candidates(key, pos, token, brand) taken in order while they fit the budget; what does not fit is passed over."""
    rows = candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "brand"))).alias("c"))
    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("brands"), F.array().cast("array<string>").alias("out"))

    def take(state, x):
        cost = F.length(x["token"]) + 1
        fits = (F.size(state["out"]) < MAX_DOMAINS + MAX_BRANDS) & (state["used"] + cost <= chars) & (~x["brand"] | (state["brands"] < MAX_BRANDS))
        return F.struct(
            F.when(fits, state["used"] + cost).otherwise(state["used"]).alias("used"),
            F.when(fits & x["brand"], state["brands"] + 1).otherwise(state["brands"]).alias("brands"),
            F.when(fits, F.concat(state["out"], F.array(x["token"]))).otherwise(state["out"]).alias("out"),
        )

    return rows.select(key, F.aggregate("c", zero, take).alias("s")).select(key, F.col("s.out").alias("filters"), F.col("s.used").alias("used"))


def exclusion_filters(seen: DataFrame, brands: DataFrame, key: str, chars: int = FILTER_CHARS) -> DataFrame:
    """(key, filters, used): what a campaign's next query leaves out: its MAX_DOMAINS most repeated domains, then brands while they fit.

    seen(key, domain, n) with n repeats; brands(key, domain, n, brand, confidence).
    """
    order = lambda *c: F.row_number().over(Window.partitionBy(key).orderBy(*c))
    sites = seen.select(key, urls.exclude_domain(F.col("domain")).alias("token"), F.lit(False).alias("brand"), order(F.desc("n"), "domain").alias("pos")).where(F.col("pos") <= MAX_DOMAINS)
    named = brands.select(key, urls.exclude_brand(F.col("brand")).alias("token"), "n", "confidence", "brand").where("token is not null")
    # Of brands of one length only the first MAX_BRANDS can be taken: where one does not fit, no later one does.
    length = F.row_number().over(Window.partitionBy(key, F.length("token")).orderBy(F.desc("n"), F.desc("confidence"), "brand"))
    named = named.withColumn("k", length).where(F.col("k") <= MAX_BRANDS)
    named = named.select(key, "token", F.lit(True).alias("brand"), (order(F.desc("n"), F.desc("confidence"), "brand") + MAX_DOMAINS).alias("pos"))
    return fill_budget(sites.unionByName(named), key, chars)


def replay_saturation(hits: DataFrame, low_new: int = LOW_NEW, max_rounds: int = 10_000) -> DataFrame:
    """(campaign, grp, round, new, executed): rounds after a group saturated are not run, so their hits are not seen.

    hits(campaign, grp, round, domain); rounds run in the order of (round, grp) within a
    campaign, max_rounds of them at most. The replay starts with all rounds run and
    repeats: count what each round would find new, then cut each group where its streak
    saturates. Each repetition makes at least the next cut final, so it ends after at
    most as many as a campaign has groups. Keys must not be null.
    """
    spark = hits.sparkSession
    save = lambda df: stored(df, new_folder(spark, "replay"))
    own = save(hits.select("campaign", "grp", "round", "domain").distinct())
    state = save(own.select("campaign", "grp", "round").distinct().withColumn("executed", F.lit(True)))
    key, at = ["campaign", "grp", "round"], F.struct("round", "grp")
    while True:
        first = F.min(F.when(F.col("executed"), at)).over(Window.partitionBy("campaign", "domain"))
        seen = own.join(state.hint("merge"), key).withColumn("first", first)
        found = seen.groupBy(*key, "executed").agg(F.count_if(F.col("first").isNull() | (at <= F.col("first"))).alias("would"))
        group = Window.partitionBy("campaign", "grp").orderBy("round")
        island = F.sum(F.when(F.col("would") > low_new, 1).otherwise(0)).over(group)
        streak = F.count_if(F.col("would") <= low_new).over(Window.partitionBy("campaign", "grp", "island").orderBy("round"))
        over = F.max(F.col("streak") >= SATURATED).over(group.rowsBetween(Window.unboundedPreceding, -1))
        run = found.withColumn("island", island).withColumn("streak", streak).withColumn("run", ~F.coalesce(over, F.lit(False)))
        ran = F.sum(F.col("run").cast("int")).over(Window.partitionBy("campaign").orderBy("round", "grp"))
        after = save(run.select(*key, "would", F.col("executed").alias("before"), (F.col("run") & (ran <= max_rounds)).alias("executed")))
        if after.where("before <> executed").isEmpty():
            return after.select(*key, F.when(F.col("executed"), F.col("would")).otherwise(0).alias("new"), "executed")
        state = after.select(*key, "executed")


def resume_plan(rounds: DataFrame) -> DataFrame:
    """What to do with each round after a stop: redo an unfinished search, go on with an unfinished analysis, keep the rest."""
    act = F.when(F.col("status") == "completed", "keep").when(F.col("phase").isin("search", "crawl"), "redo").otherwise("continue")
    return rounds.withColumn("action", act)
