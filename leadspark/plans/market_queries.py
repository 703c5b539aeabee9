"""Queries over domains, addresses, exclusion filters, histories and submissions, each over whole tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import contacts, urls
from ..operators import leads as L
from ..operators import quality
from ..operators import rounds as R
from .views import HITS, hits, table

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


_PUBLIC = ", ".join(f"'{x}'" for x in urls.PUBLIC_SUFFIXES)
_REGISTRABLE = f"""CASE WHEN len(string_split({{0}}, '.')) <= 2 THEN {{0}} WHEN array_to_string(string_split({{0}}, '.')[-2:], '.') IN ({_PUBLIC})
 THEN array_to_string(string_split({{0}}, '.')[-3:], '.') ELSE array_to_string(string_split({{0}}, '.')[-2:], '.') END"""
_ENDS = ("co.uk", "com.sa", "ae", "gov.ae", "com", "com.au", "de", "net.sa")
_END_SQL = "CASE c_nationkey % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ENDS)) + " END"


@query(f"""WITH h AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'www.' WHEN 1 THEN 'a.b.' ELSE '' END || 'shop' || c_custkey || '.' || {_END_SQL} AS host FROM customer)
 SELECT c_custkey, host, {_REGISTRABLE.format("host")} AS registrable FROM h""")
def registrable_domain(spark, d):
    ends = F.array(*map(F.lit, _ENDS))
    front = F.when(F.col("c_custkey") % 3 == 0, "www.").when(F.col("c_custkey") % 3 == 1, "a.b.").otherwise("")
    host = F.concat(front, F.lit("shop"), F.col("c_custkey").cast("string"), F.lit("."), F.get(ends, (F.col("c_nationkey") % 8).cast("int")))
    return table(spark, d, "customer").select("c_custkey", host.alias("host")).withColumn("registrable", urls.registrable(F.col("host")))


_EMAIL = contacts.EMAIL.replace("(?i)", "")


@query(rf"""WITH e AS (SELECT DISTINCT source AS company, lower(unnest(regexp_extract_all(text, '(?i){_EMAIL}'))) AS email FROM documents),
 x AS (SELECT company, email, regexp_extract(email, '@(.*)$', 1) AS domain FROM e), y AS (SELECT *, {_REGISTRABLE.format("domain")} AS site FROM x),
 c AS (SELECT company, min(site) AS own FROM y GROUP BY company)
 SELECT company, email, domain, site = own AS same_domain FROM y JOIN c USING (company)""")
def email_same_domain(spark, d):
    own = table(spark, d, "documents").select(F.col("source").alias("company"), F.explode(F.regexp_extract_all("text", F.lit(contacts.EMAIL), F.lit(0))).alias("email"))
    own = own.where("company is not null").select("company", F.lower("email").alias("email")).distinct()
    own = own.withColumn("domain", contacts.email_domain(F.col("email"))).withColumn("site", urls.registrable(F.col("domain")))
    first = own.groupBy("company").agg(F.min("site").alias("own"))
    return own.join(first.hint("merge"), "company").select("company", "email", "domain", contacts.same_domain(F.col("domain"), F.col("own")).alias("same_domain"))


_HOST = r"regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)"
_MADE = {1: "'ftp://' || h", 2: "'https://user:pw@' || h || '/x'", 3: "'http://?q=' || page_id", 4: "'http://10.' || (page_id % 256) || '.0.1/'", 5: "'http://[::ffff:192.168.0.' || (page_id % 256) || ']/'", 6: "'http://[2001:db8::' || (page_id % 10) || ']:80/'", 7: "'http://' || (page_id % 224 * 16777216 + page_id) || '/a'", 8: "'http://[2a00:1450::' || (page_id % 10) || ']/'"}
_REASONS = {1: "'scheme'", 2: "'userinfo'", 3: "'host'", 4: "'address'", 5: "'address'", 6: "'address'", 7: "CASE WHEN page_id % 224 IN (0, 10, 127) THEN 'address' END", 8: "NULL"}


def _case(key: str, parts: dict[int, str], last: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {v}" for k, v in parts.items()) + f" ELSE {last} END"


@query(f"""WITH p AS (SELECT page_id, url, {_HOST} AS h FROM pages)
 SELECT page_id, {_case("page_id % 9", _MADE, "url")} AS url, {_case("page_id % 9", _REASONS, "NULL")} AS reason FROM p""")
def url_safety(spark, d):
    own = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1).alias("h"))
    return own.select("page_id", F.expr(_case("page_id % 9", _MADE, "url")).alias("url")).withColumn("reason", urls.unsafe_reason(F.col("url")))


_BUDGET = f"""c AS (SELECT campaign, domain, count(*) - 1 AS n FROM hits GROUP BY ALL),
 b AS (SELECT campaign, domain, n, 'Brand "' || domain || '"\\ Co' AS brand, (length(domain) % 3) * 0.05 + 0.85 AS conf FROM c),
 t AS (SELECT campaign, '-site:' || domain AS token, false AS brand, row_number() OVER (PARTITION BY campaign ORDER BY n DESC, domain) AS pos FROM c
  UNION ALL SELECT campaign, '-"Brand ' || domain || ' Co"', true, 12 + row_number() OVER (PARTITION BY campaign ORDER BY n DESC, conf DESC, brand) FROM b),
 r AS (SELECT campaign, token, brand, row_number() OVER (PARTITION BY campaign ORDER BY pos, brand) AS pos FROM t WHERE (NOT brand AND pos <= 12) OR brand)"""


@query(f"""WITH RECURSIVE {HITS}, {_BUDGET},
 f(campaign, pos, used, brands, filters) AS (SELECT DISTINCT campaign, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM c
 UNION ALL SELECT campaign, pos, used + CASE WHEN fits THEN length(token) + 1 ELSE 0 END, brands + CASE WHEN fits AND brand THEN 1 ELSE 0 END, CASE WHEN fits THEN list_append(filters, token) ELSE filters END
  FROM (SELECT f.campaign, r.pos, used, brands, filters, token, brand, used + length(token) + 1 <= 1000 AND len(filters) < 20 AND (NOT brand OR brands < 8) AS fits FROM f JOIN r ON r.campaign = f.campaign AND r.pos = f.pos + 1))
 SELECT campaign, array_to_string(arg_max(filters, pos), ' ') AS filters, max(used)::BIGINT AS used, max(brands)::BIGINT AS brands FROM f GROUP BY campaign""")
def exclusion_filters(spark, d):
    seen = hits(spark, d).groupBy("campaign", "domain").agg((F.count("*") - 1).alias("n"))
    brand = F.concat(F.lit('Brand "'), "domain", F.lit('"\\ Co'))
    brands = seen.select("campaign", "domain", "n", brand.alias("brand"), ((F.length("domain") % 3) * 0.05 + 0.85).alias("confidence"))
    return R.exclusion_filters(seen, brands, "campaign").select("campaign", F.array_join("filters", " ").alias("filters"), F.col("used").cast("long").alias("used"), F.size(F.filter("filters", lambda x: x.startswith('-"'))).cast("long").alias("brands"))


@query("""WITH r AS (SELECT trim(CASE WHEN o_orderkey % 2 = 0 THEN upper(n_name) ELSE '  ' || n_name END) AS country, o_orderkey AS run, o_orderdate AS finished, o_custkey % 7 AS planned, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS queries, o_orderpriority AS domain,
  CASE o_custkey % 3 WHEN 0 THEN 'manual' ELSE 'serper' END AS mode FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 x AS (SELECT r.*, n_nationkey AS id, row_number() OVER (PARTITION BY n_nationkey ORDER BY finished DESC, run DESC) AS rn FROM r JOIN nation ON lower(n_name) = lower(country) WHERE mode = 'serper' AND n_nationkey % 5 <> 4)
 SELECT id AS country, count(*) AS runs, max(finished) AS last_run, sum(coalesce(queries, planned))::BIGINT AS queries, count(DISTINCT domain) AS domains, string_agg(run::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 5) AS recent FROM x GROUP BY id""")
def target_history(spark, d):
    nation = table(spark, d, "nation")
    places = table(spark, d, "customer").join(nation.hint("merge"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    own = table(spark, d, "orders").join(places.hint("merge"), "o_custkey")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.upper("n_name")).otherwise(F.concat(F.lit("  "), "n_name"))
    own = own.select(name.alias("country"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("finished"), (F.col("o_custkey") % 7).alias("planned"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3).alias("queries"), F.col("o_orderpriority").alias("domain"), F.when(F.col("o_custkey") % 3 == 0, "manual").otherwise("serper").alias("mode"))
    return L.target_history(own, nation.where("n_nationkey % 5 <> 4").select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("id")))


_CLAIMS = """sl AS (SELECT o_orderkey AS lead, o_custkey AS company, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'importer' END AS role, CASE WHEN o_orderkey % 5 = 0 THEN 'yes' END AS imports,
  o_orderkey % 4 AS fit, o_orderkey % 7 AS scale, (o_orderkey % 10) / 10.0 AS confidence, o_orderstatus <> 'F' AS qualified, o_custkey % 3 AS risks, CASE WHEN o_orderkey % 6 < 4 THEN o_orderkey % 6 END AS recommended FROM orders),
 sf AS (SELECT l_orderkey AS lead, l_linenumber AS ref, ['identity', 'product', 'business_role', 'scale', 'risk'][1 + l_partkey % 5] AS kind FROM lineitem),
 su AS (SELECT l_orderkey AS lead, l_linenumber AS ref FROM lineitem WHERE l_quantity < 30),
 sc AS (SELECT c_custkey AS company, k AS ref FROM customer, range(1, 4) t(k)),
 sx AS (SELECT l_orderkey AS lead, l_linenumber AS ref FROM lineitem WHERE l_returnflag <> 'R')"""


@query(f"""WITH {_CLAIMS}, k AS (SELECT lead, bool_or(kind = 'identity') AS named FROM sf GROUP BY lead),
 u AS (SELECT lead, bool_or(kind = 'product') AS p, bool_or(kind = 'business_role') AS r, bool_or(kind = 'scale') AS s FROM sf SEMI JOIN su USING (lead, ref) GROUP BY lead),
 x AS (SELECT sx.lead, bool_or(sc.ref IS NULL) AS stranger, bool_or(sc.ref IS NOT NULL AND sx.ref = sl.recommended) AS ok FROM sx JOIN sl USING (lead) LEFT JOIN sc ON sc.company = sl.company AND sc.ref = sx.ref GROUP BY sx.lead),
 a AS (SELECT sl.*, coalesce(named, false) AS named, coalesce(p, false) AS p, coalesce(r, false) AS r, coalesce(s, false) AS s, coalesce(stranger, false) AS stranger, coalesce(ok, false) AS ok FROM sl LEFT JOIN k USING (lead) LEFT JOIN u USING (lead) LEFT JOIN x USING (lead))
 SELECT lead, rule FROM (SELECT lead, unnest(list_filter([CASE WHEN name IS NOT NULL AND NOT named THEN 'identity_fact' END, CASE WHEN role IS NOT NULL AND NOT r THEN 'role_fact' END, CASE WHEN imports IS NOT NULL AND NOT s THEN 'import_fact' END,
  CASE WHEN fit > 0 AND NOT p THEN 'fit_fact' END, CASE WHEN scale > 0 AND NOT s THEN 'scale_fact' END, CASE WHEN stranger THEN 'unknown_contact' END, CASE WHEN (confidence < 0.8 OR NOT qualified) AND risks = 0 THEN 'risk_required' END,
  CASE WHEN recommended IS NOT NULL AND NOT ok THEN 'recommended_contact' END], lambda x: x IS NOT NULL)) AS rule FROM a)""")
def submission_consistency(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    key = F.col("o_orderkey")
    leads = o.select(key.alias("lead"), F.col("o_custkey").alias("company"), F.when(key % 2 == 0, F.col("o_orderpriority")).alias("name"), F.when(key % 3 == 0, "importer").alias("role"), F.when(key % 5 == 0, "yes").alias("imports"), (key % 4).alias("fit"), (key % 7).alias("scale"), ((key % 10) / 10.0).alias("confidence"), (F.col("o_orderstatus") != "F").alias("qualified"), (F.col("o_custkey") % 3).alias("risks"), F.when(key % 6 < 4, key % 6).alias("recommended"))
    kinds = F.array(*map(F.lit, ("identity", "product", "business_role", "scale", "risk")))
    facts = line.select(F.col("l_orderkey").alias("lead"), F.col("l_linenumber").alias("ref"), F.get(kinds, (F.col("l_partkey") % 5).cast("int")).alias("kind"))
    pick = lambda c: line.where(c).select(F.col("l_orderkey").alias("lead"), F.col("l_linenumber").alias("ref"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("company"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ref"))
    return quality.consistency_violations(leads, facts, pick("l_quantity < 30"), known, pick("l_returnflag <> 'R'"))
