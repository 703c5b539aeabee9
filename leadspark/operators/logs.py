"""Log analytics over record tables; the same aggregates serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nested import number_at

# Names of events, and the parts of a report that count them or sum a number of their data.
REQUEST = ("http.request.completed",)
AGENT_RUN = ("agent.trace.recorded", "orchestrator.agent.completed")
CRAWL = ("crawler.completed",)
CAMPAIGN = ("pipeline.campaign.completed",)
SEARCH = ("search.serper.completed",)
COUNTED = {
    ("http", "requests"): REQUEST,
    ("agents", "completed"): AGENT_RUN,
    ("agents", "failed"): ("agent.run.failed", "orchestrator.agent.failed"),
    ("search", "requests"): SEARCH,
    ("search", "cache_hits"): ("search.serper.cache_hit",),
    ("search", "failed"): ("search.serper.network_failed", "search.serper.http_failed"),
    ("crawler", "completed"): CRAWL,
    ("crawler", "failed"): ("crawler.page_skipped",),
    ("crawler", "cache_hits"): ("crawler.cache_hit", "crawler.inflight_reused"),
    ("campaigns", "completed"): CAMPAIGN,
    ("campaigns", "retries"): ("pipeline.candidate.retry_scheduled", "discovery.candidate.retry_scheduled"),
    ("orchestrator", "sessions_created"): ("orchestrator.session.created",),
    ("orchestrator", "chats_completed"): ("orchestrator.chat.completed",),
    ("orchestrator", "strategies_approved"): ("orchestrator.strategy.approved",),
    ("orchestrator", "executions_completed"): ("orchestrator.execution.completed",),
    ("orchestrator", "executions_failed"): ("orchestrator.execution.failed",),
}
SUMMED = {
    ("search", "returned_hits"): (SEARCH, "hitCount"),
    ("crawler", "pages"): (CRAWL, "pageCount"),
    ("crawler", "contact_candidates"): (CRAWL, "contactCandidateCount"),
    ("campaigns", "leads"): (CAMPAIGN, "leadCount"),
    ("campaigns", "qualified"): (CAMPAIGN, "qualified"),
    ("campaigns", "needs_review"): (CAMPAIGN, "needsReview"),
    ("campaigns", "rejected"): (CAMPAIGN, "rejected"),
    ("campaigns", "analysis_failures"): (CAMPAIGN, "analysisFailures"),
}
AVERAGED = {("http", "average_ms"): REQUEST, ("agents", "average_ms"): AGENT_RUN, ("crawler", "average_ms"): CRAWL}

KEYS = ["event", "level", "status", "agent"]
NUMBERS = ["durationMs", *dict.fromkeys(field for _, field in SUMMED.values())]
#: Sums are decimals, so that they do not depend on the order of records or states.
EXACT = "decimal(38,6)"
ERRORS = ["ts", "event", "message", "request_id", "session_id", "campaign_id"]


def _number(data: Column, name: str) -> Column:
    """A number of a record's data; null for what is absent or of another kind."""
    return number_at(data, name, EXACT)


def log_state(records: DataFrame) -> DataFrame:
    """Partial state of a report over records(ts, level, event, agent, data), data being JSON.

    A row per event, level, status and agent, of which programs have few: how many
    records, first and last time, sums of the numbers of NUMBERS and the longest
    duration. Statuses are kept for requests (0 where there is none) and agents for
    their runs (unknown where there is none). A record without a level counts under
    unknown, one without an event goes, and so does a number that is none.
    """
    own = records.where(F.col("event").isNotNull()).select("ts", "level", "event", "agent", F.try_parse_json(F.col("data").cast("string")).alias("data"))
    own = own.select(
        "ts",
        "event",
        F.coalesce("level", F.lit("unknown")).alias("level"),
        F.when(F.col("event").isin(*REQUEST), F.coalesce(_number(F.col("data"), "statusCode").cast("long"), F.lit(0))).alias("status"),
        F.when(F.col("event").isin(*AGENT_RUN), F.coalesce("agent", F.lit("unknown"))).alias("agent"),
        *[_number(F.col("data"), name).alias(name) for name in NUMBERS],
    )
    sums = [F.sum(F.coalesce(name, F.lit(0).cast(EXACT))).cast(EXACT).alias(name) for name in NUMBERS]
    return own.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("durationMs").alias("longest"), *sums)


def merged_states(states: DataFrame) -> DataFrame:
    """States of several sets of records as the state of all: sums, firsts and lasts, in any order."""
    sums = [F.sum(name).cast(EXACT).alias(name) for name in NUMBERS]
    return states.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("longest").alias("longest"), *sums)


def report(state: DataFrame) -> DataFrame:
    """(part, name, value, at) of a state: the parts of a log report, one row a figure.

    Parts: total, period (from and to, in `at`), levels, events, http, http_status,
    agents, by_agent, search, crawler, campaigns and orchestrator. Figures that no
    record adds to are 0; averages are rounded, halves upwards. Without records the
    period is null and the parts that list names are empty. The state is read twice:
    give a written one.
    """
    among = lambda events, c: F.sum(F.when(F.col("event").isin(*events), c))
    n = F.col("n")
    figures = {("total", "records"): F.sum(n)}
    figures |= {place: among(events, n) for place, events in COUNTED.items()}
    figures |= {place: among(events, F.col(field)) for place, (events, field) in SUMMED.items()}
    figures |= {place: F.floor(among(events, F.col("durationMs")).cast("double") / among(events, n) + 0.5) for place, events in AVERAGED.items()}
    figures["http", "maximum_ms"] = F.greatest(F.lit(0).cast(EXACT), F.max(F.when(F.col("event").isin(*REQUEST), F.col("longest"))))
    figures["http", "failed"] = F.sum(F.when(F.col("status") >= 400, n))
    row = lambda part, name, value, time: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), value.alias("value"), time.alias("at"))
    no_time = F.nullif(F.min("first_ts"), F.min("first_ts"))
    rows = [row(part, name, F.coalesce(value.cast("double"), F.lit(0.0)), no_time) for (part, name), value in figures.items()]
    rows += [row("period", name, F.lit(None).cast("double"), time) for name, time in (("from", F.min("first_ts")), ("to", F.max("last_ts")))]
    single = state.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    none = F.nullif("first_ts", "first_ts")
    lists = [("levels", F.col("level")), ("events", F.col("event")), ("http_status", F.col("status").cast("string")), ("by_agent", F.col("agent"))]
    entries = F.array(*[F.struct(F.lit(part).alias("part"), name.alias("name"), n.alias("n"), none.alias("at")) for part, name in lists])
    listed = state.select(F.inline(entries)).where(F.col("name").isNotNull())
    return single.unionByName(listed.groupBy("part", "name").agg(F.sum("n").cast("double").alias("value"), F.max("at").alias("at")))


def error_records(records: DataFrame) -> DataFrame:
    """ERRORS of the records that are errors or requests that failed on the server; the error's message goes before the record's."""
    status = _number(F.try_parse_json(F.col("data").cast("string")), "statusCode")
    failed = (F.col("level") == "error") | (F.col("event").isin(*REQUEST) & (status >= 500))
    return records.where(failed).select("ts", "event", F.coalesce("error_message", "message").alias("message"), "request_id", "session_id", "campaign_id")


def newest(errors: DataFrame, n: int = 20) -> DataFrame:
    """The n newest rows of ERRORS; among those of one time the larger texts, so that parts merge to the newest of all."""
    return errors.orderBy(*[F.desc_nulls_last(c) for c in ERRORS]).limit(n)


def events_since(logs: DataFrame, since) -> DataFrame:
    return logs.where(F.col("ts") >= F.lit(since).cast("timestamp")).groupBy("event").agg(F.count("*").alias("n"))


def summary(logs: DataFrame) -> DataFrame:
    """One row: totals, failures, durations and period, in one aggregation."""
    return logs.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("status") >= 400).alias("failed"),
        F.round(F.avg(F.coalesce("duration_ms", F.lit(0.0)))).cast("long").alias("average_ms"),
        F.round(F.coalesce(F.max("duration_ms"), F.lit(0.0)), 6).alias("maximum_ms"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def counts(logs: DataFrame, *by: str) -> DataFrame:
    return logs.groupBy(*by).agg(F.count("*").alias("n"))


def agents(logs: DataFrame) -> DataFrame:
    """Per agent: completed and failed runs and their average duration."""
    return logs.groupBy(F.coalesce("agent", F.lit("unknown")).alias("agent")).agg(F.count_if(F.col("level") != "error").alias("completed"), F.count_if(F.col("level") == "error").alias("failed"), F.round(F.avg("duration_ms"), 4).alias("average_ms"))


def recent_errors(logs: DataFrame, n: int = 20) -> DataFrame:
    """The newest n records that are errors or failed requests."""
    rank = F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id")))
    newest = logs.where((F.col("level") == "error") | (F.col("status") >= 500)).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    return newest.withColumn("rank", rank.cast("long"))


def retries(logs: DataFrame, key: str, base_ms: int) -> DataFrame:
    """Per key: how often it was retried, and the next delay (doubling)."""
    n = F.count_if(F.col("level") == "error")
    return logs.groupBy(key).agg(n.alias("retries")).withColumn("next_delay_ms", (F.lit(base_ms) * F.pow(F.lit(2.0), F.least("retries", F.lit(20)))).cast("long"))


def access_stats(logs: DataFrame) -> DataFrame:
    return counts(logs, "status")
