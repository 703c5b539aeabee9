"""The product's entities laid over the test tables, each as a DataFrame and as SQL for the oracle.

The tables are general (orders, events, documents, pages); a view gives their
columns the part of a hit, a page, a lead or a log record, so that operators run
over whole tables of every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits: a campaign per event type, a round per day, a domain per user."""
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long")
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("campaign"), day.alias("round"), F.concat(F.lit("u"), F.col("user_id")).alias("domain"), "event_id", "ts")
    order = Window.partitionBy("campaign", "round").orderBy("ts", "event_id")
    return own.withColumn("pos", F.row_number().over(order).cast("long")).drop("ts")


HITS = """hits AS (SELECT event_type AS campaign, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS round, 'u' || user_id AS domain, event_id,
  row_number() OVER (PARTITION BY event_type, date_diff('day', DATE '2024-01-01', ts::DATE) ORDER BY ts, event_id) AS pos FROM events)"""


def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits over web pages: link, domain, title, snippet (all of the page's text)."""
    own = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"[ \t\n\r]+", " "))
    return own.select("page_id", F.col("url").alias("link"), urls.host(F.col("url")).alias("domain"), title.alias("title"), text.alias("snippet"), "html")


PAGE_HITS = r"""page_hits AS (SELECT page_id, url AS link, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS snippet, html FROM pages)"""


#: Ids of a source that are numbered together.
RUN = 4096


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company pages: a company per source, pages in the order of ids.

    Runs of ids are counted first, so that no task sorts all pages of a company.
    """
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("company"), "text", "lang", F.floor(F.col("doc_id") / RUN).alias("run"))
    before = F.sum("n").over(Window.partitionBy("company").orderBy("run")) - F.col("n")
    starts = own.groupBy("company", "run").agg(F.count("*").alias("n")).select(F.col("company").alias("c"), F.col("run").alias("r"), before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("company", "run").orderBy("doc_id")) - 1
    numbered = own.withColumn("page_index", inside).join(starts.hint("merge"), F.col("company").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    return numbered.select("doc_id", "company", "text", "lang", (F.col("start") + F.col("page_index")).cast("long").alias("page_index"))


DOCS = "docs AS (SELECT doc_id, source AS company, text, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_index FROM documents)"


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery rounds: a query group per event type, a round per day; hits of value 100 or more are new."""
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long")
    own = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp"), day.alias("round"))
    return own.agg(F.count("*").alias("raw"), F.count_if(F.col("value") >= 100).alias("new"))


ROUNDS = """rounds AS (SELECT event_type AS grp, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS round, count(*) AS raw,
  count(*) FILTER (value >= 100) AS new FROM events GROUP BY ALL)"""


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads: customers, with urgent orders as product evidence and large orders as scale evidence."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("products"),
        F.count_if(F.col("o_totalprice") >= 300000).alias("scales"),
        F.count("*").alias("orders"),
    )
    own = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("k"), "left").na.fill(0, ["products", "scales", "orders"])
    percent = F.floor((F.col("c_acctbal") + 1000) / 110).cast("long")
    return own.select(
        F.col("c_custkey").alias("id"),
        F.lower("c_name").alias("domain"),
        F.col("c_mktsegment").alias("campaign"),
        F.col("c_nationkey").cast("long").alias("nation"),
        "products",
        "scales",
        "orders",
        F.least(F.lit(98), 34 + 18 * F.col("products")).cast("long").alias("fit"),
        F.least(F.lit(95), 28 + 13 * F.col("scales")).cast("long").alias("scale"),
        ((50 + F.floor(F.least(F.greatest(percent, F.lit(0)), F.lit(100)) / 2)) / F.lit(100.0)).alias("confidence"),
        F.when(F.col("c_custkey") % 7 == 0, "Retailer").when(F.col("c_custkey") % 5 == 0, "Unknown").otherwise("Distributor").alias("role"),
    )


LEADS = """leads AS (SELECT c_custkey AS id, lower(c_name) AS domain, c_mktsegment AS campaign, c_nationkey::BIGINT AS nation,
  coalesce(products, 0)::BIGINT AS products, coalesce(scales, 0)::BIGINT AS scales, coalesce(orders, 0)::BIGINT AS orders,
  least(98, 34 + 18 * coalesce(products, 0))::BIGINT AS fit, least(95, 28 + 13 * coalesce(scales, 0))::BIGINT AS scale,
  (50 + floor(least(greatest(floor((c_acctbal + 1000) / 110), 0), 100) / 2)) / 100.0::DOUBLE AS confidence,
  CASE WHEN c_custkey % 7 = 0 THEN 'Retailer' WHEN c_custkey % 5 = 0 THEN 'Unknown' ELSE 'Distributor' END AS role
  FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) FILTER (o_orderpriority = '1-URGENT') AS products,
    count(*) FILTER (o_totalprice >= 300000) AS scales, count(*) AS orders FROM orders GROUP BY 1) ON c_custkey = k)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records: an event type each, value as duration, status from the properties."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("event"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warn").otherwise("info").alias("level"),
        F.col("value").alias("duration_ms"),
        (200 + 100 * F.floor(k / 25)).cast("long").alias("status"),
        F.concat(F.lit("agent"), F.col("user_id") % 4).alias("agent"),
    )


LOGS = """logs AS (SELECT event_id, ts, event_type AS event, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS level,
  value AS duration_ms, (200 + 100 * floor(CAST(json_extract(props, '$.k') AS INTEGER) / 25))::BIGINT AS status, 'agent' || (user_id % 4) AS agent FROM events)"""


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines(value) of a log: requests, searches, crawls and agent runs from events, campaigns and sessions from orders; a broken line for every order in review."""
    k, value, kind = F.from_json("props", "k int")["k"], F.col("value"), F.col("event_type")
    event = (
        F.when(kind == "view", "http.request.completed")
        .when(kind == "signup", F.when(k < 50, "agent.trace.recorded").otherwise("orchestrator.agent.completed"))
        .when(kind == "click", F.when(k < 30, "search.serper.cache_hit").when(k < 90, "search.serper.completed").otherwise("crawler.inflight_reused"))
        .when(kind == "purchase", F.when(k < 70, "crawler.completed").when(k < 85, "crawler.cache_hit").otherwise("pipeline.candidate.retry_scheduled"))
        .when(k < 25, "agent.run.failed")
        .when(k < 40, "orchestrator.agent.failed")
        .when(k < 55, "search.serper.network_failed")
        .when(k < 70, "search.serper.http_failed")
        .when(k < 85, "crawler.page_skipped")
        .otherwise("orchestrator.execution.failed")
    )
    text = lambda c: F.when(k == 7, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))  # noqa: E731  a number as a text counts as none
    data = F.format_string('{"statusCode":%d,"durationMs":%s,"hitCount":%d,"pageCount":%d,"contactCandidateCount":%d}', (200 + 100 * F.floor(k / 25)).cast("long"), text(value), k, k, (F.col("user_id") % 5))
    wrap = lambda *c: F.to_json(F.struct(*c))
    field = lambda c, name: c.cast("string").alias(name)
    level = F.when(kind == "error", "error").when(kind == "click", "warn").otherwise("info")
    agent = F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("agent"), F.col("user_id") % 5))
    whole = lambda start, data: F.concat(F.substring(start, F.lit(1), F.length(start) - 1), F.lit(',"data":'), data, F.lit("}"))
    error = F.when(k % 2 == 0, F.struct(F.concat(F.lit("cause "), k).alias("message")))
    own = table(spark, sf_dir, "events").select(whole(wrap(field(F.col("ts"), "timestamp"), level.alias("level"), event.alias("event"), agent.alias("agent"), F.concat(F.lit("user "), F.col("user_id")).alias("message"), field(F.col("event_id"), "requestId"), error.alias("error")), data).alias("value"))
    state, urgency = F.col("o_orderstatus"), F.left("o_orderpriority", F.lit(1))
    done = F.when(state == "F", "pipeline.campaign.completed").when(state == "P", "discovery.candidate.retry_scheduled").when(urgency <= "2", "orchestrator.session.created").when(urgency == "3", "orchestrator.chat.completed").when(urgency == "4", "orchestrator.strategy.approved").otherwise("orchestrator.execution.completed")
    n = lambda divisor: F.floor(F.col("o_totalprice") / divisor).cast("long")
    counts = F.struct(n(10000).alias("leadCount"), n(20000).alias("qualified"), n(40000).alias("needsReview"), n(80000).alias("rejected"), (F.col("o_custkey") % 3).alias("analysisFailures"))
    lines = table(spark, sf_dir, "orders").select(state.alias("state"), wrap(field(F.col("o_orderdate"), "timestamp"), F.lit("info").alias("level"), done.alias("event"), field(F.col("o_custkey"), "campaignId"), counts.alias("data")).alias("value"))
    broken = lines.where("state = 'P'").select(F.substring("value", F.lit(1), F.length("value") - 30).alias("value"))
    return own.unionAll(lines.select("value")).unionAll(broken)


REPORTED = """reported AS (SELECT ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS level,
  CASE event_type WHEN 'view' THEN 'http.request.completed' WHEN 'signup' THEN CASE WHEN k < 50 THEN 'agent.trace.recorded' ELSE 'orchestrator.agent.completed' END
    WHEN 'click' THEN CASE WHEN k < 30 THEN 'search.serper.cache_hit' WHEN k < 90 THEN 'search.serper.completed' ELSE 'crawler.inflight_reused' END
    WHEN 'purchase' THEN CASE WHEN k < 70 THEN 'crawler.completed' WHEN k < 85 THEN 'crawler.cache_hit' ELSE 'pipeline.candidate.retry_scheduled' END
    ELSE CASE WHEN k < 25 THEN 'agent.run.failed' WHEN k < 40 THEN 'orchestrator.agent.failed' WHEN k < 55 THEN 'search.serper.network_failed' WHEN k < 70 THEN 'search.serper.http_failed' WHEN k < 85 THEN 'crawler.page_skipped' ELSE 'orchestrator.execution.failed' END END AS event,
  CASE WHEN user_id % 5 > 0 THEN 'agent' || (user_id % 5) END AS agent, CASE WHEN k % 2 = 0 THEN 'cause ' || k ELSE 'user ' || user_id END AS message, event_id::VARCHAR AS request_id, NULL::VARCHAR AS campaign_id,
  (200 + 100 * floor(k / 25))::BIGINT AS statusCode, CASE WHEN k <> 7 THEN value::DECIMAL(38,6) END AS durationMs, k::DECIMAL(38,6) AS hitCount, k::DECIMAL(38,6) AS pageCount, (user_id % 5)::DECIMAL(38,6) AS contactCandidateCount,
  0::DECIMAL(38,6) AS leadCount, 0::DECIMAL(38,6) AS qualified, 0::DECIMAL(38,6) AS needsReview, 0::DECIMAL(38,6) AS rejected, 0::DECIMAL(38,6) AS analysisFailures
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
 UNION ALL SELECT o_orderdate, 'info', CASE o_orderstatus WHEN 'F' THEN 'pipeline.campaign.completed' WHEN 'P' THEN 'discovery.candidate.retry_scheduled'
    ELSE CASE WHEN left(o_orderpriority, 1) <= '2' THEN 'orchestrator.session.created' WHEN left(o_orderpriority, 1) = '3' THEN 'orchestrator.chat.completed' WHEN left(o_orderpriority, 1) = '4' THEN 'orchestrator.strategy.approved' ELSE 'orchestrator.execution.completed' END END,
  NULL, NULL, NULL, o_custkey::VARCHAR, 0, NULL, 0, 0, 0, floor(o_totalprice / 10000), floor(o_totalprice / 20000), floor(o_totalprice / 40000), floor(o_totalprice / 80000), o_custkey % 3 FROM orders)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages with an estimate of their tokens."""
    from ..functions.text import token_estimate

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", token_estimate(F.col("text")).alias("tokens"))


MESSAGES = r"""messages AS (SELECT conv_id, turn, role, text, ceil(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 3.5::DOUBLE
  + (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / 1.5::DOUBLE)::BIGINT AS tokens FROM conversations)"""


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy versions: a market per customer, a version per order."""
    state = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "reviewed").otherwise("draft")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("market"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created"), state.alias("status"), F.col("o_totalprice").alias("weight"))


POLICIES = """policies AS (SELECT o_custkey AS market, o_orderkey AS version, o_orderdate AS created,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'reviewed' ELSE 'draft' END AS status, o_totalprice AS weight FROM orders)"""
