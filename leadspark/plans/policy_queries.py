"""Queries over policies and nested JSON, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested
from ..operators import policies as P, rules
from ..sources import sinks
from .views import table

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


def _list(c):
    """A list of plain words as JSON."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))


def content(orders, keys, market):
    """(*keys, json): a policy for each group of orders, its lists made of what the orders hold; names are in no order."""
    own = orders.groupBy(*keys).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("languages"), F.array_sort(F.collect_set("c_mktsegment")).alias("roles"), F.array_sort(F.collect_set("o_orderstatus")).alias("patterns"))
    search = F.concat(F.lit('{"queryPatterns":'), _list(F.col("patterns")), F.lit(', "languages":'), _list(F.col("languages")), F.lit(',"translationRestrictions":[],"buyerRoleTerms":'), _list(F.col("roles")), F.lit("}"))
    company = F.lit('{"identitySignals":[],"legalSuffixSemantics":[],"buyerSignals":[],"importAndScaleSignals":[],"falsePositivePatterns":[],"exclusions":[]}')
    contact = F.concat(F.lit('{"preferredContactTerms":[],"defaultLanguage":"'), F.get("languages", F.lit(0)), F.lit('","validationNotes":[],"etiquette":[]}'))
    json = F.concat(F.lit('{"searchLocalization": '), search, F.lit(',"schemaVersion":1,"marketId":"'), market, F.lit('","contactAndOutreach":'), contact, F.lit(',"companyAnalysis":'), company, F.lit("}"))
    return own.select(*keys, json.alias("json"))


def _canonical(market):
    """The canonical form of content() in SQL, over lists languages, roles and patterns."""
    listed = lambda c: f"'[' || array_to_string(list_transform(list_sort({c}), lambda x: '\"' || x || '\"'), ',') || ']'"
    return (
        """'{"companyAnalysis":{"buyerSignals":[],"exclusions":[],"falsePositivePatterns":[],"identitySignals":[],"importAndScaleSignals":[],"legalSuffixSemantics":[]},"contactAndOutreach":{"defaultLanguage":"' || list_sort(languages)[1]"""
        + f""" || '","etiquette":[],"preferredContactTerms":[],"validationNotes":[]}},"marketId":"' || {market} || '","schemaVersion":1,"searchLocalization":{{"buyerRoleTerms":' || {listed('roles')} || ',"languages":' || {listed('languages')} || ',"queryPatterns":' || {listed('patterns')} || ',"translationRestrictions":[]}}}}'"""
    )


ORDERED = "o AS (SELECT orders.*, c_nationkey, c_mktsegment, c_acctbal, year(o_orderdate)::VARCHAR AS version FROM orders JOIN customer ON c_custkey = o_custkey)"
LISTS = "list(DISTINCT o_orderpriority) AS languages, list(DISTINCT c_mktsegment) AS roles, list(DISTINCT o_orderstatus) AS patterns"


def ordered(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment", "c_acctbal")
    return table(spark, d, "orders").join(c, "o_custkey").withColumn("version", F.year("o_orderdate").cast("string"))


# A market is a customer, a version a year. Versions hold the finished orders of their year, and where these are few of a large account, the market of the customer's nation;
# manifests name the last year of any order and record what all its orders make.
_OF = "CASE WHEN c_acctbal > 5000 AND count(*) < 3 THEN 'n-' || c_nationkey ELSE 'c-' || o_custkey END"


@query(f"""WITH {ORDERED}, f AS (SELECT 'c-' || o_custkey AS market, version, {_OF} AS own, {LISTS} FROM o WHERE o_orderstatus = 'F' GROUP BY o_custkey, version, c_nationkey, c_acctbal),
 l AS (SELECT *, max(version) OVER (PARTITION BY o_custkey) AS last FROM o), m AS (SELECT 'c-' || o_custkey AS market, version, {LISTS} FROM l WHERE version = last GROUP BY o_custkey, version),
 h AS (SELECT market, version, sha256({_canonical('market')}) AS hash FROM m), g AS (SELECT market, version, own, sha256({_canonical('own')}) AS hash FROM f)
 SELECT h.market, h.version, unnest(list_filter([CASE WHEN g.market IS NULL THEN 'missing' END, CASE WHEN own <> h.market THEN 'market' END, CASE WHEN g.hash <> h.hash THEN 'hash' END], lambda x: x IS NOT NULL)) AS problem FROM h LEFT JOIN g USING (market, version)""")
def hash_mismatch(spark, d):
    own = ordered(spark, d)
    done = own.where("o_orderstatus = 'F'")
    keys = ["o_custkey", "version", "of"]
    few = done.groupBy("o_custkey", "version").agg(F.count("*").alias("n"))
    of = F.when((F.col("c_acctbal") > 5000) & (F.col("n") < 3), F.concat(F.lit("n-"), "c_nationkey")).otherwise(F.concat(F.lit("c-"), "o_custkey"))
    files = content(done.join(few, ["o_custkey", "version"]).withColumn("of", of), keys, F.col("of"))
    versions = files.select(F.concat(F.lit("c-"), "o_custkey").alias("market"), "version", "json")
    last = own.groupBy("o_custkey").agg(F.max("version").alias("version"))
    recorded = content(own.join(last, ["o_custkey", "version"]).withColumn("of", F.concat(F.lit("c-"), "o_custkey")), keys, F.col("of"))
    manifests = recorded.select(F.col("of").alias("market"), "version", nested.content_hash(F.col("json")).alias("hash"))
    return P.policy_problems(manifests, versions)


# Files: a market is a nation, a version a year in which it has large urgent orders; the manifest names the year of its largest order.
@query(f"""WITH {ORDERED}, f AS (SELECT 'nation-' || c_nationkey AS market, version, {LISTS} FROM o GROUP BY ALL HAVING count(*) FILTER (o_orderpriority = '1-URGENT' AND o_totalprice > 400000) > 0),
 m AS (SELECT 'nation-' || c_nationkey AS market, arg_max(version, o_totalprice) AS version FROM o GROUP BY c_nationkey)
 SELECT m.market, m.version, CASE WHEN f.market IS NOT NULL THEN sha256({_canonical('f.market')}) END AS hash, f.market IS NOT NULL AS held FROM m LEFT JOIN f ON f.market = m.market AND f.version = m.version""")
def active_policies(spark, d):
    own = ordered(spark, d).withColumn("market", F.concat(F.lit("nation-"), "c_nationkey"))
    large = own.where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select("market", "version").distinct()
    versions = content(own.join(large, ["market", "version"], "left_semi"), ["market", "version"], F.col("market"))
    manifests = own.groupBy("market").agg(F.max_by("version", "o_totalprice").alias("version"), F.lit("h").alias("hash"))
    root = sinks.new_folder(spark, "policies")
    P.write_policies(versions, manifests, root)
    return P.active_policies(spark, root).select("market", "version", nested.content_hash(F.col("json")).alias("hash"), F.col("json").isNotNull().alias("held"))


# Policies as they might arrive: what a customer's orders and account hold decides which rules are broken.
@query("""WITH o AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'P') AS pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
 SELECT c_custkey, '$.schemaVersion' AS path, 'const' AS rule, NULL AS detail FROM o WHERE n > 12
 UNION ALL SELECT c_custkey, '$.marketId', 'pattern', NULL FROM o WHERE c_nationkey > 20
 UNION ALL SELECT c_custkey, '$', 'additionalProperties', 'notes,source' FROM o WHERE c_mktsegment = 'MACHINERY'
 UNION ALL SELECT c_custkey, '$.searchLocalization.languages[*]', 'type', NULL FROM o WHERE pending > 0
 UNION ALL SELECT c_custkey, '$.contactAndOutreach.defaultLanguage', 'type', CASE WHEN n = 0 THEN 'null' ELSE 'number' END FROM o WHERE c_acctbal < 0 OR n = 0
 UNION ALL SELECT c_custkey, '$.contactAndOutreach.etiquette', 'required', NULL FROM o WHERE n < 4
 UNION ALL SELECT c_custkey, '$.marketId', 'market of its folder', NULL FROM o WHERE c_nationkey > 20""")
def policy_violations(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    own = table(spark, d, "customer").join(n, "c_custkey", "left").na.fill(0, ["n", "pending"])
    text = lambda c: F.lit(c)
    languages = F.when(F.col("pending") > 0, F.concat(text('["en",'), F.col("pending").cast("string"), text("]"))).otherwise('["en"]')
    default = F.when(F.col("n") == 0, "null").when(F.col("c_acctbal") < 0, F.col("n").cast("string")).otherwise('"en"')
    json = F.concat(
        text('{"schemaVersion":'), F.when(F.col("n") > 12, "2").otherwise("1"),
        text(',"marketId":"'), F.when(F.col("c_nationkey") > 20, "Nation").otherwise("nation"), text("-"), F.col("c_nationkey").cast("string"), text('"'),
        F.when(F.col("c_mktsegment") == "MACHINERY", ',"source":"m","notes":[]').otherwise(""),
        text(',"searchLocalization":{"languages":'), languages, text(',"buyerRoleTerms":[],"queryPatterns":[],"translationRestrictions":[]}'),
        text(',"companyAnalysis":{"identitySignals":[],"legalSuffixSemantics":[],"buyerSignals":[],"importAndScaleSignals":[],"falsePositivePatterns":[],"exclusions":[]}'),
        text(',"contactAndOutreach":{"preferredContactTerms":[],"validationNotes":[],"defaultLanguage":'), default, F.when(F.col("n") < 4, "").otherwise(',"etiquette":[]'), text("}}"),
    )
    rows = own.select("c_custkey", json.alias("json"), F.concat(F.lit("nation-"), "c_nationkey").alias("market"))
    return rules.entity_violations(rows, "c_custkey", "json", rules.POLICY, rules.same_market(F.col("market")))


@query("""SELECT c_custkey, '{"z":{"name":"Customer#***' || right(c_name, 4) || '","balance":' || c_nationkey || ',"Api_Key":"[REDACTED]"},"mails":["' || lower(left(c_mktsegment, 1)) || '***@example.com",null,true],"cookies":"[REDACTED]","a":{"b":{"c":{"d":{"e":{"f":{"g":"[MAX_DEPTH]"}}}}}}}' AS redacted FROM customer""")
def redact_nested(spark, d):
    c = table(spark, d, "customer")
    json = F.concat(F.lit('{"z": {"name":"'), "c_name", F.lit('","balance":'), F.col("c_nationkey").cast("string"), F.lit(',"Api_Key":["'), "c_mktsegment", F.lit('"]},"mails":["'), F.lower("c_mktsegment"), F.lit('@example.com",null,true],"cookies":{"x":1},"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}}}'))
    # A small file of customers is much work: it is dealt out to all cores.
    dealt = c.select("c_custkey", json.alias("json")).repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    return dealt.select("c_custkey", nested.redact_json(F.col("json")).alias("redacted"))
