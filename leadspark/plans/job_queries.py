"""Queries over sources, sinks, streams and pluggable scorers, with oracles where the outcome is a relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as logs_of
from ..operators.scoring import score_companies
from ..sources import readers, sinks
from ..streaming import jobs
from .views import HITS, LEADS, LOGS, REPORTED, hits, leads, log_records, logs, table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def records(spark, d):
    own = logs(spark, d)
    message = F.concat(F.lit("user"), "event_id", F.lit("@example.com did "), "event")
    return own.select(F.col("ts").alias("timestamp"), "level", "event", message.alias("message"))


@query(f"WITH {LOGS} SELECT event, level, count(*) AS n FROM logs WHERE ts::DATE = DATE '2024-01-05' GROUP BY ALL")
def log_scan(spark, d):
    path = sinks.new_folder(spark, "log-scan")
    sinks.write_log(records(spark, d), path, "debug")
    return readers.read_log(spark, path, "2024-01-05").groupBy("event", "level").agg(F.count("*").alias("n"))


@query(f"WITH {LOGS} SELECT ts::DATE AS day, count(*) AS n, bool_and(true) AS redacted FROM logs WHERE level <> 'info' GROUP BY 1")
def log_sink(spark, d):
    path = sinks.new_folder(spark, "log-sink")
    sinks.write_log(records(spark, d), path, "warn")
    back = spark.read.text(path)
    return back.groupBy(F.col("dt").alias("day")).agg(F.count("*").alias("n"), F.bool_and(F.contains("value", F.lit("***@example.com"))).alias("redacted"))


@query("SELECT n_nationkey AS nation, n_name AS name, 'n' || n_nationkey AS code FROM nation")
def dim_load(spark, d):
    path = sinks.new_folder(spark, "dimension")
    own = table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("displayName"))).alias("value"))
    own.write.partitionBy("n_nationkey").text(path)
    return readers.read_dimension(spark, path, readers.PROFILE).select(F.col("n_nationkey").alias("nation"), F.col("displayName").alias("name"), F.col("id").alias("code"))


@query(f"WITH {LEADS} SELECT campaign, id, CASE WHEN campaign = 'BUILDING' THEN 'second' ELSE 'first' END AS run FROM leads WHERE campaign <> 'BUILDING' OR id % 2 = 0")
def replace_partition(spark, d):
    path = sinks.new_folder(spark, "leads")
    own = leads(spark, d).select("campaign", "id")
    sinks.replace_partitions(own.withColumn("run", F.lit("first")), path, "campaign")
    sinks.replace_partitions(own.where("campaign = 'BUILDING' and id % 2 = 0").withColumn("run", F.lit("second")), path, "campaign")
    return spark.read.parquet(path)


@query(f"WITH {LEADS} SELECT id, CASE WHEN id % 100 <> 99 THEN products * 18 + 34 END::BIGINT AS points, CASE WHEN id % 100 = 99 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN id % 100 = 99 THEN 3 ELSE 1 END AS attempts FROM leads")
def pluggable_scorer(spark, d):
    def scorer(row):
        if row["id"] % 100 == 99:
            raise ValueError("no answer")
        return {"points": row["products"] * 18 + 34}

    return score_companies(leads(spark, d).select("id", "products"), scorer, "id", {"points": "long"}).select("id", "points", "status", "attempts")


def event_stream(spark, d):
    """events as a stream: landed as several files and read a few at a time, with the columns of hits and logs."""
    folder = sinks.new_folder(spark, "landing")
    table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(6).write.parquet(folder)
    rows = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 3).parquet(folder)
    return rows.select("ts", F.col("event_type").alias("event"), F.col("event_type").alias("campaign"), F.concat(F.lit("u"), "user_id").alias("domain"), F.col("value").alias("duration_ms"))


@query(f"WITH {LOGS} SELECT date_trunc('hour', ts) AS hour, event, count(*) AS n, round(sum(duration_ms), 4) AS total_ms FROM logs GROUP BY ALL")
def stream_log_metrics(spark, d):
    path = sinks.new_folder(spark, "log-metrics")
    jobs.run_to_end(jobs.log_metrics(event_stream(spark, d), "60 days"), f"{path}/out", f"{path}/state", "update")
    last = spark.read.parquet(f"{path}/out").groupBy("hour", "event").agg(F.max_by(F.struct("n", "total_ms"), "batch").alias("x"))
    return last.select("hour", "event", "x.n", F.round("x.total_ms", 4).alias("total_ms"))


@query("SELECT DISTINCT event_type AS campaign, 'u' || user_id AS domain FROM events")
def stream_dedupe(spark, d):
    path = sinks.new_folder(spark, "dedupe")
    jobs.run_to_end(jobs.new_companies(event_stream(spark, d)).select("campaign", "domain"), f"{path}/out", f"{path}/state", "append")
    return spark.read.parquet(f"{path}/out").select("campaign", "domain")


@query(f"""WITH {HITS}, h AS (SELECT (pos % 3)::VARCHAR AS campaign, campaign AS grp, round, domain FROM hits),
 f AS (SELECT campaign, domain, min({{'round': round, 'grp': grp}}) AS first FROM h GROUP BY ALL),
 r AS (SELECT h.campaign, h.grp, h.round, count(*) AS raw, count(DISTINCT h.domain) FILTER (first.round = h.round AND first.grp = h.grp) AS new FROM h JOIN f USING (campaign, domain) GROUP BY ALL),
 b AS (SELECT campaign, grp, max(round) FILTER (new > 7) AS good, max(round) AS last FROM r GROUP BY ALL),
 g AS (SELECT campaign, grp, count(*) AS executed, sum(raw)::BIGINT AS raw, sum(new)::BIGINT AS new, (sum(raw) - sum(new))::BIGINT AS repeats, arg_max(new, round) AS last_new, count(*) FILTER (good IS NULL OR round > good) AS streak FROM r JOIN b USING (campaign, grp) GROUP BY ALL)
 SELECT campaign, grp, executed, raw, new, repeats, last_new, streak, streak >= 3 AS saturated, CASE WHEN sum(executed) OVER (PARTITION BY campaign) >= 90 THEN 'max_queries' WHEN bool_and(streak >= 3) OVER (PARTITION BY campaign) THEN 'all_groups_saturated' ELSE 'running' END AS reason FROM g""")
def stream_discovery_state(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    path = sinks.new_folder(spark, "discovery")
    own = hits(spark, d).select((F.col("pos") % 3).cast("string").alias("campaign"), F.col("campaign").alias("grp"), "round", "domain")
    own.repartition(6).write.parquet(f"{path}/landing")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 3).parquet(f"{path}/landing")
    jobs.run_to_end(jobs.discovery_state(stream, buckets=8), f"{path}/out", f"{path}/state", "append")
    states = spark.read.parquet(f"{path}/out")
    return jobs.discovery_groups(states).join(jobs.discovery_status(states, 90).select("campaign", "reason").hint("merge"), "campaign")


def _listed(mapping) -> str:
    return ", ".join(f"'{x}'" for x in mapping)


_FIGURES = ["('total', 'records', count(*)::DOUBLE)"]
_FIGURES += [f"('{p}', '{n}', count(*) FILTER (event IN ({_listed(events)}))::DOUBLE)" for (p, n), events in logs_of.COUNTED.items()]
_FIGURES += [f"('{p}', '{n}', coalesce(sum({field}) FILTER (event IN ({_listed(events)})), 0)::DOUBLE)" for (p, n), (events, field) in logs_of.SUMMED.items()]
_FIGURES += [f"('{p}', '{n}', coalesce(floor(sum(coalesce(durationMs, 0)::DECIMAL(38,6)) FILTER (event IN ({_listed(events)}))::DOUBLE / count(*) FILTER (event IN ({_listed(events)})) + 0.5), 0))" for (p, n), events in logs_of.AVERAGED.items()]
_FIGURES += ["('http', 'failed', count(*) FILTER (event = 'http.request.completed' AND statusCode >= 400)::DOUBLE)", "('http', 'maximum_ms', greatest(0, coalesce(max(durationMs) FILTER (event = 'http.request.completed'), 0))::DOUBLE)"]
_ROWS = ", ".join("{'part': %s, 'name': %s, 'value': %s}" % tuple(f[1:-1].split(", ", 2)) for f in _FIGURES)
REPORT = f"""WITH {REPORTED}, one AS (SELECT unnest([{_ROWS}], recursive := true) FROM reported)
 SELECT part, name, value, NULL::TIMESTAMP AS at FROM one
 UNION ALL SELECT 'period', 'from', NULL, min(ts) FROM reported UNION ALL SELECT 'period', 'to', NULL, max(ts) FROM reported
 UNION ALL SELECT 'levels', level, count(*), NULL FROM reported GROUP BY level UNION ALL SELECT 'events', event, count(*), NULL FROM reported GROUP BY event
 UNION ALL SELECT 'http_status', statusCode::VARCHAR, count(*), NULL FROM reported WHERE event = 'http.request.completed' GROUP BY statusCode
 UNION ALL SELECT 'by_agent', coalesce(agent, 'unknown'), count(*), NULL FROM reported WHERE event IN ({_listed(logs_of.AGENT_RUN)}) GROUP BY 2"""


@query(REPORT)
def log_report(spark, d):
    path = sinks.new_folder(spark, "log-report")
    log_records(spark, d).write.text(f"{path}/lines")
    state = logs_of.log_state(readers.parse_records(spark.read.text(f"{path}/lines"), "timestamp_ntz"))
    return logs_of.report(sinks.stored(state, f"{path}/state"))


@query(f"""WITH {REPORTED} SELECT ts, event, message, request_id, NULL::VARCHAR AS session_id, campaign_id FROM reported WHERE level = 'error' OR (event = 'http.request.completed' AND statusCode >= 500)
 ORDER BY ts DESC, event DESC, message DESC NULLS LAST, request_id DESC NULLS LAST, campaign_id DESC NULLS LAST LIMIT 20""")
def log_report_errors(spark, d):
    path = sinks.new_folder(spark, "log-errors")
    log_records(spark, d).write.text(path)
    return logs_of.newest(logs_of.error_records(readers.parse_records(spark.read.text(path), "timestamp_ntz")))


@query(REPORT)
def stream_log_report(spark, d):
    path = sinks.new_folder(spark, "log-stream")
    cores = max(2, spark.sparkContext.defaultParallelism)  # three batches, each with a file for every core
    log_records(spark, d).repartition(3 * cores).write.text(f"{path}/landing")
    lines = spark.readStream.option("maxFilesPerTrigger", cores).text(f"{path}/landing")
    jobs.report_to_end(readers.parse_records(lines, "timestamp_ntz"), path, f"{path}/offsets")
    return jobs.kept_report(spark, path)[0]
