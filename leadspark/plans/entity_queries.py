"""Queries over hits, evidence, leads, rounds, tables and logs, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import contacts, text, urls
from ..operators import budget, evidence, funnel, leads as L, logs as G, pages as P, quality, rounds as R, tables as T
from .market_queries import _REGISTRABLE
from .text_queries import CONTACTS, LEXICON, NORM, _HITS, email_contacts
from .views import DOCS, HITS, LEADS, LOGS, MESSAGES, PAGE_HITS, POLICIES, ROUNDS, docs, hits, leads, logs, messages, page_hits, policies, rounds, table

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


# ---- funnel

EXCLUDED_USERS = "domain IN ('u1', 'u2', 'u3', 'u5', 'u8')"
ROUTED = f"""{HITS}, x AS (SELECT *, {EXCLUDED_USERS} AS is_x, event_id % 10 = 0 AS weak FROM hits),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY campaign, domain, is_x ORDER BY round, pos) AS rn FROM x),
 routed AS (SELECT campaign, round, pos, domain, CASE WHEN is_x THEN 'excluded' WHEN rn > 1 THEN 'duplicate' WHEN weak THEN 'snippet_rejected' ELSE 'new' END AS stage FROM ranked)"""


def routed(spark, d):
    return funnel.route(hits(spark, d), F.col("domain").isin("u1", "u2", "u3", "u5", "u8"), F.col("event_id") % 10 == 0, ["round", "pos"])


@query(f"""WITH {ROUTED} SELECT campaign, round, count(*) AS raw, count(*) FILTER (stage = 'excluded') AS excluded, count(*) FILTER (stage = 'duplicate') AS duplicate,
 count(*) FILTER (stage = 'snippet_rejected') AS snippet_rejected, count(*) FILTER (stage = 'new') AS new,
 coalesce(string_agg(domain, ',' ORDER BY domain) FILTER (stage = 'new'), '') AS new_domains FROM routed GROUP BY ALL""")
def round_counters(spark, d):
    return funnel.round_counters(routed(spark, d))


@query(f"WITH {ROUTED} SELECT campaign, round, pos, domain, stage FROM routed WHERE stage <> 'new'")
def funnel_reasons(spark, d):
    return routed(spark, d).where("stage <> 'new'").select("campaign", "round", "pos", "domain", "stage")


@query(f"""WITH {PAGE_HITS}, o AS (SELECT 'q' || (page_id % 5) AS query, page_id // 50 + 1 AS page, page_id, link, title, snippet, domain,
   row_number() OVER (PARTITION BY page_id % 5, page_id // 50 ORDER BY page_id) - 1 AS idx FROM page_hits),
 r AS (SELECT query, link, {{'page': page, 'idx': idx}} AS seq, CASE WHEN page_id % 3 = 0 THEN page_id ELSE (page - 1) * 10 + idx + 1 END AS position, title, snippet,
   CASE WHEN len(string_split(domain, '.')) <= 2 THEN domain ELSE array_to_string(string_split(domain, '.')[-2:], '.') END AS domain FROM o),
 g AS (SELECT query, link, min(seq) AS first, arg_max({{'p': position, 't': title, 'd': domain}}, seq) AS last FROM r GROUP BY query, link),
 k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY first) AS hit_pos FROM g)
 SELECT query, hit_pos, link, last.p::BIGINT AS position, last.t AS title, last.d AS domain FROM k WHERE hit_pos <= 100""")
def serp_flatten(spark, d):
    own = page_hits(spark, d).withColumn("query", F.concat(F.lit("q"), F.col("page_id") % 5)).withColumn("page", F.floor(F.col("page_id") / 50) + 1)
    hit = F.struct("page_id", F.struct(F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("int")).alias("position"), "title", "link", "snippet").alias("o"))
    body = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["o"]).alias("organic")))
    responses = own.groupBy("query", "page").agg(body.alias("body"))
    return funnel.flatten_responses(responses).select("query", "hit_pos", "link", "position", "title", "domain")


EXTRA = ["spam-farm.example.com", "example.net"]
_LISTED = ", ".join(f"('{x}')" for x in dict.fromkeys([*funnel.EXCLUDED_DOMAINS, *EXTRA]))


@query(f"WITH {PAGE_HITS}, e(suffix) AS (VALUES {_LISTED}) SELECT page_id, suffix FROM page_hits JOIN e ON domain = suffix OR ends_with(domain, '.' || suffix)")
def suffix_join(spark, d):
    return funnel.suffix_join(page_hits(spark, d), funnel.exclusion_list(spark, EXTRA), "page_id")


@query(rf"""WITH {PAGE_HITS}, e(suffix) AS (VALUES {_LISTED}) SELECT page_id, domain, EXISTS (SELECT 1 FROM e WHERE domain = suffix OR ends_with(domain, '.' || suffix))
 OR regexp_matches(domain, '{funnel.PLATFORM}') OR regexp_matches(link, '{funnel.FILE_LINK}') OR regexp_matches(title || ' ' || snippet, '{funnel.DIRECTORY.replace("(?iu)", "(?i)")}')
 OR regexp_matches(title || ' ' || snippet, '{funnel.OTHER_CONTENT.replace("(?iu)", "(?i)")}') AS excluded FROM page_hits""")
def hit_exclusion(spark, d):
    return funnel.mark_excluded(page_hits(spark, d), funnel.exclusion_list(spark, EXTRA), "page_id").select("page_id", "domain", "excluded")


PRODUCT, BUYER, AVOID = LEXICON[:3], LEXICON[3:5], LEXICON[5:]


def _sql_hits(terms):
    return " + ".join(f"(contains(low, '{t}'))::INT" if " " in t or len(t) >= 8 else f"(contains(padded, ' {t} '))::INT" for t in terms)


LOW = r"p AS (SELECT k, low, ' ' || regexp_replace(low, '[^\p{L}\p{N}]', ' ', 'g') || ' ' AS padded, body FROM (SELECT k, body, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS low FROM t))"


@query(f"WITH t AS (SELECT doc_id AS k, text AS body FROM documents), {LOW} SELECT k AS doc_id, ({_sql_hits(PRODUCT)}) = 0 AND ({_sql_hits(BUYER)}) = 0 AND (doc_id % 2 = 0 OR ({_sql_hits(AVOID)}) > 0) AS skipped FROM p".replace("doc_id % 2", "k % 2"))
def snippet_gate(spark, d):
    s = F.col("text")
    skip = funnel.gate(text.term_hits(s, PRODUCT), text.term_hits(s, BUYER), text.term_hits(s, AVOID), F.col("doc_id") % 2 != 0)
    return table(spark, d, "documents").select("doc_id", skip.alias("skipped"))


@query(rf"""WITH g AS (SELECT source || '-' || (doc_id // 40) AS k, text, doc_id FROM documents), t AS (SELECT k, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM g GROUP BY k), {LOW}
 SELECT k AS company, length(regexp_replace(body, '\s', '', 'g')) >= 400 AND ({_sql_hits(PRODUCT[1:])}) = 0 AND ({_sql_hits(BUYER)}) = 0 AS skipped FROM p""")
def page_gate(spark, d):
    company = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 40))
    own = table(spark, d, "documents").select(company.alias("company"), F.col("doc_id").alias("page_index"), "text")
    return funnel.page_gate(own, PRODUCT[1:], BUYER, [], False)


@query(r"""WITH t AS (SELECT p_brand AS kind, p_partkey AS source_pos, p_name || ' (' || p_type || '), ' || p_name AS s FROM part),
 ph AS (SELECT kind, source_pos, list_concat(list_concat([trim(regexp_extract(s, '\(([^)]+)\)', 1))], list_filter([trim(regexp_replace(x, '\([^)]*\)', '', 'g')) FOR x IN string_split(s, ',')], lambda p: length(p) BETWEEN 3 AND 80)), [s]) AS a FROM t),
 e AS (SELECT kind, {'s': source_pos, 'p': unnest(range(len(a)))} AS pos, unnest(a) AS term FROM ph),
 k AS (SELECT *, row_number() OVER (PARTITION BY kind, lower(term) ORDER BY pos) AS rn FROM e WHERE length(term) >= 2)
 SELECT kind, string_agg(term, '|' ORDER BY pos) AS terms FROM k WHERE rn = 1 GROUP BY kind""")
def lexicon_compile(spark, d):
    parts = table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("source_pos"), F.concat("p_name", F.lit(" ("), "p_type", F.lit("), "), "p_name").alias("text"))
    return funnel.compile_lexicon(parts).select("kind", F.array_join("terms", "|").alias("terms"))


# A profile for each language of the documents; words and suffixes are such as the tables hold.
PROFILES = [
    ("en", ".org", "+1", ["New York", "clown", "idiot"], ["licensed", "the"], ["with", "für"]),
    ("de", ".net", "+49", ["worthless", "einst", "der"], ["licensed under", "und"], ["GmbH", "für"]),
    ("fr", ".com", "+1", ["idiot", "désir", "une"], ["licensed", "pour"], ["avec", "SARL"]),
    ("es", ".example.com", "+1", ["", "clown", "señal", "los"], ["del", "license"], ["S.A.", "con"]),
]
PROFILE = "country string, domain_suffix string, calling_code string, cities array<string>, names array<string>, business_suffixes array<string>"
_WORDS = ", ".join(f"('{c}', '{kind}', {pos}, '{w}', '{'' if w.isascii() else 'x'}')" for c, _, _, *lists in PROFILES for kind, words in zip(("city", "address", "business_suffix"), lists, strict=True) for pos, w in enumerate(words) if w)
_CODES = ", ".join(str(p[:3]) for p in PROFILES)
# Companies are the pages of a source among 400 ids, in the country of their first page, at the host of the web page numbered like it.
SCORED = rf"""g AS (SELECT source || '-' || (doc_id // 400) AS company, doc_id AS page_index, 'doc:' || doc_id AS url, text, lang FROM documents WHERE source IS NOT NULL),
 f AS (SELECT company, arg_min(lang, page_index) AS country, min(page_index) AS page_id FROM g GROUP BY company),
 c AS (SELECT company, country, regexp_replace(lower(regexp_extract(p.url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain, p.url AS homepage FROM f LEFT JOIN pages p USING (page_id)),
 t(country, kind, pos, value, free) AS (VALUES {_WORDS}), z(country, domain_suffix, calling_code) AS (VALUES {_CODES}),
 m AS (SELECT company, country, kind, pos, value, page_index, url, CASE WHEN free = 'x' THEN contains(lower(text), lower(value)) ELSE regexp_matches(lower(text), '(?:^|[^a-z0-9])' || replace(lower(value), '.', '\.') || '(?:$|[^a-z0-9])') END AS inside,
   CASE WHEN free = 'x' THEN contains(lower(url), lower(value)) ELSE regexp_matches(lower(url), '(?:^|[^a-z0-9])' || replace(lower(value), '.', '\.') || '(?:$|[^a-z0-9])') END AS beside
   FROM g JOIN (SELECT company, country FROM f) USING (company) JOIN t USING (country)),
 k AS (SELECT company, kind, pos, value, arg_min(url, page_index) FILTER (inside) AS source_url FROM m WHERE inside OR beside GROUP BY ALL),
 w AS (SELECT company, kind, arg_min(value, pos) AS value, arg_min(coalesce(source_url, '-'), pos) AS source_url FROM k GROUP BY ALL),
 p AS (SELECT company, page_index, unnest(regexp_extract_all(text, '{contacts.PHONE}')) AS value, url FROM g),
 q AS (SELECT company, arg_min(p.url, page_index) AS source_url FROM p JOIN f USING (company) JOIN z USING (country) WHERE starts_with(regexp_replace(value, '\s+', '', 'g'), calling_code) GROUP BY company),
 s AS (SELECT company, 1 AS place, 'domain' AS kind, domain_suffix AS value, homepage AS source_url, 25 AS weight FROM c JOIN z USING (country) WHERE ends_with(domain, domain_suffix)
   UNION ALL SELECT company, 2, 'phone', calling_code, source_url, 25 FROM q JOIN f USING (company) JOIN z USING (country)
   UNION ALL SELECT company, CASE kind WHEN 'city' THEN 3 WHEN 'address' THEN 4 ELSE 5 END, kind, value, source_url, CASE kind WHEN 'city' THEN 20 WHEN 'address' THEN 25 ELSE 15 END FROM w),
 score AS (SELECT company, country, least(100, coalesce(sum(weight), 0))::BIGINT AS score, coalesce(string_agg(kind || '=' || value || '@' || source_url, '|' ORDER BY place), '') AS signals FROM c LEFT JOIN s USING (company) GROUP BY company, country)"""


def scored(spark, d):
    own = table(spark, d, "documents").where("source is not null").select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 400)).alias("company"), F.col("doc_id").alias("page_index"), F.concat(F.lit("doc:"), "doc_id").alias("url"), "text", "lang")
    sites = table(spark, d, "pages").select(F.col("page_id").alias("first"), urls.host(F.col("url")).alias("domain"), F.col("url").alias("homepage"))
    first = own.groupBy("company").agg(F.min_by("lang", "page_index").alias("country"), F.min("page_index").alias("first"))
    companies = first.join(sites, "first", "left").drop("first")
    phones = own.select("company", "page_index", "url", F.posexplode(F.regexp_extract_all("text", F.lit(contacts.PHONE), F.lit(0))).alias("i", "value"))
    phones = phones.select("company", F.struct("page_index", "i").alias("pos"), "value", F.col("url").alias("source_url"))
    return funnel.country_score(companies, own.select("company", "page_index", "url", "text"), phones, spark.createDataFrame(PROFILES, PROFILE))


@query(f"WITH {SCORED} SELECT company, country, score, score >= 35 AS matched, signals FROM score")
def country_score(spark, d):
    told = F.transform("signals", lambda s: F.concat(s["kind"], F.lit("="), s["value"], F.lit("@"), F.coalesce(s["source_url"], F.lit("-"))))
    return scored(spark, d).withColumn("signals", F.array_join(told, "|"))


@query(f"WITH {SCORED} SELECT country, CASE WHEN score < 50 THEN 'country_rejected' ELSE 'kept' END AS status, count(*) AS n, min(score) AS lowest, max(score) AS highest FROM score GROUP BY ALL")
def country_gate(spark, d):
    own = scored(spark, d).withColumn("status", F.when(F.col("score") < 50, "country_rejected").otherwise("kept"))
    return own.groupBy("country", "status").agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


@query("""SELECT o_orderkey, o_custkey AS market FROM orders JOIN (SELECT o_custkey AS m, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON m = o_custkey WHERE o_orderstatus <> 'F' AND o_orderkey < v""")
def approved_only(spark, d):
    own = policies(spark, d)
    approved = own.where("status = 'approved'").groupBy("market").agg(F.max("version").alias("v"))
    return own.where("status <> 'approved'").join(approved, "market").where("version < v").select(F.col("version").alias("o_orderkey"), "market")


@query(f"WITH {LEADS} SELECT campaign, count(*) AS incomplete FROM leads WHERE orders < 3 OR products = 0 GROUP BY campaign")
def incomplete_campaigns(spark, d):
    return leads(spark, d).where("orders < 3 or products = 0").groupBy("campaign").agg(F.count("*").alias("incomplete"))


@query(f"WITH {DOCS}, k AS (SELECT doc_id, company, page_index, trim(text) AS t, min(page_index) OVER (PARTITION BY company, sha256(trim(text))) AS first FROM docs) SELECT doc_id, CASE WHEN first < page_index THEN first END AS duplicate_of, first >= page_index AND t <> '' AS indexed FROM k")
def dup_pages(spark, d):
    return P.duplicate_pages(docs(spark, d), "company", "page_index", "text").select("doc_id", "duplicate_of", "indexed")


@query(f"WITH {PAGE_HITS}, k AS (SELECT page_id, domain, link, row_number() OVER (PARTITION BY domain, link ORDER BY page_id) AS rn FROM page_hits) SELECT page_id, domain, link FROM k WHERE rn = 1")
def page_snapshots(spark, d):
    return P.page_snapshots(page_hits(spark, d).select("page_id", "domain", "link"), ["domain", "link"], ["page_id"])


# ---- joins


@query(f"WITH {HITS} SELECT campaign, round, pos, domain FROM hits h WHERE round >= 15 AND NOT EXISTS (SELECT 1 FROM hits s WHERE s.round < 15 AND s.campaign = h.campaign AND lower(s.domain) = lower(h.domain))")
def seen_anti(spark, d):
    own = hits(spark, d)
    seen = own.where("round < 15").select("campaign", F.lower("domain").alias("k")).distinct()
    return own.where("round >= 15").withColumn("k", F.lower("domain")).join(seen, ["campaign", "k"], "left_anti").select("campaign", "round", "pos", "domain")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT (l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20)) AND NOT (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))")
def resume_anti(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    done = table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("l_partkey"))
    gone = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return own.join(done, "l_partkey", "left_anti").join(gone, "l_suppkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""WITH {CONTACTS}, v AS (SELECT value, min(doc_id) AS checked_in FROM contacts GROUP BY value) SELECT doc_id, c.value, checked_in, false AS verified FROM contacts c LEFT JOIN v ON c.value = v.value AND checked_in % 2 = 0""")
def contact_validation_join(spark, d):
    own = email_contacts(spark, d)
    checks = quality.first_match(own.select("value", F.col("doc_id").alias("checked_in")), "value", ["checked_in"]).where("checked_in % 2 = 0")
    return own.select("doc_id", "value").join(checks.hint("merge"), "value", "left").withColumn("verified", F.lit(False))


CHUNKS = f"{DOCS}, chunks AS (SELECT company, 'p' || page_index || '-s' || (a // 840) AS ref, page_index, a // 840 AS idx, substr(text, a + 1, 960) AS text FROM (SELECT company, page_index, text, unnest(range(0, greatest(length(text), 1), 840)) AS a FROM docs))"


def chunks(spark, d):
    own = evidence.chunk_fixed(docs(spark, d).select("company", "page_index", "text"), 960, 120)
    return own.select("company", "ref", "page_index", F.floor(F.col("at") / 840).alias("idx"), F.col("chunk").alias("text"))


FACTS = "facts AS (SELECT source AS company, doc_id AS pos, 'f' || doc_id AS id, 'p' || (doc_id % 60) || '-s' || (doc_id % 3) AS ref FROM documents)"


def facts(spark, d):
    ref = F.concat(F.lit("p"), F.col("doc_id") % 60, F.lit("-s"), F.col("doc_id") % 3)
    return table(spark, d, "documents").select(F.col("source").alias("company"), F.col("doc_id").alias("pos"), F.concat(F.lit("f"), "doc_id").alias("id"), ref.alias("ref"))


@query(f"WITH {CHUNKS}, {FACTS} SELECT f.id, f.ref, md5(c.text) AS quote_md5, c.text IS NOT NULL AS found FROM facts f LEFT JOIN chunks c USING (company, ref)")
def evidence_restore(spark, d):
    return evidence.restore_evidence(facts(spark, d), chunks(spark, d)).select("id", "ref", F.md5("quote").alias("quote_md5"), "found")


@query(f"""WITH {FACTS}, l AS (SELECT company, ref, arg_max(id, pos) AS id FROM facts GROUP BY ALL), r AS (SELECT company, ref, min(pos) AS pos FROM facts WHERE pos % 2 = 0 GROUP BY ALL)
 SELECT company, string_agg(id, ',' ORDER BY pos, id) AS ids FROM r JOIN l USING (company, ref) GROUP BY company""")
def evidence_ids(spark, d):
    own = facts(spark, d)
    return evidence.evidence_ids(own, own.where("pos % 2 = 0")).select("company", F.array_join("ids", ",").alias("ids"))


@query("SELECT s_suppkey, n_name AS country FROM supplier LEFT JOIN nation ON lower(trim(' ' || n_name || ' ')) = lower('nation_' || s_nationkey)")
def alias_lookup(spark, d):
    aliases = table(spark, d, "nation").select(F.lower(F.trim(F.concat(F.lit(" "), "n_name", F.lit(" ")))).alias("alias"), F.col("n_name").alias("country"))
    own = table(spark, d, "supplier").select("s_suppkey", F.lower(F.concat(F.lit("nation_"), "s_nationkey")).alias("alias"))
    return own.join(F.broadcast(aliases), "alias", "left").select("s_suppkey", "country")


@query(f"WITH {HITS} SELECT campaign, round, pos, domain FROM hits h WHERE EXISTS (SELECT 1 FROM customer WHERE 'u' || c_custkey = domain AND c_mktsegment = 'BUILDING')")
def round_candidates(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("u"), "c_custkey").alias("domain"))
    return hits(spark, d).join(known, "domain", "left_semi").select("campaign", "round", "pos", "domain")


@query("""SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS candidate FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey AND a.c_acctbal > 0 LEFT JOIN customer b ON lower(b.c_name) = 'customer#' || lpad((o_orderkey % 1500)::VARCHAR, 9, '0')""")
def progress_match(spark, d):
    c = table(spark, d, "customer")
    by_id = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("a"))
    by_name = c.select(F.lower("c_name").alias("dom"), F.col("c_name").alias("b"))
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("customer#"), F.lpad((F.col("o_orderkey") % 1500).cast("string"), 9, "0")).alias("dom"))
    return own.join(by_id, "o_custkey", "left").join(by_name, "dom", "left").select("o_orderkey", F.coalesce("a", "b").alias("candidate"))


TERMS = ["the", "of the", "in the", "idiot", "der", "de la", "the and"]


@query(rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM w)
 SELECT doc_id, term, count(*) AS times FROM g WHERE term IN ({', '.join(f"'{t}'" for t in TERMS)}) GROUP BY ALL""")
def lexicon_join(spark, d):
    lexicon = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return evidence.lexicon_join(table(spark, d, "documents"), lexicon, "doc_id")


@query(f"""WITH {CHUNKS}, q AS (SELECT company, trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g')) AS quote FROM docs)
 SELECT company, ref FROM (SELECT company, ref, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM chunks) c WHERE EXISTS (SELECT 1 FROM q WHERE q.company = c.company AND length(quote) >= 16 AND (contains(f, quote) OR contains(quote, f) OR contains(f, substr(quote, 1, 48))))""")
def prior_quote_semi(spark, d):
    quotes = table(spark, d, "documents").select(F.col("source").alias("company"), F.substring("text", 1, 60).alias("quote"))
    return evidence.prior_quotes(quotes, chunks(spark, d), "company").select("company", "ref")


@query(f"WITH {CHUNKS}, k AS (SELECT company || '/' || page_index AS page, idx FROM chunks), w AS (SELECT * FROM k WHERE idx % 5 = 2) SELECT k.page, k.idx::BIGINT AS idx, w.idx::BIGINT AS center FROM k JOIN w ON k.page = w.page AND abs(k.idx - w.idx) <= 1")
def chunk_neighbors(spark, d):
    own = chunks(spark, d).select(F.concat_ws("/", "company", "page_index").alias("page"), "idx")
    return evidence.neighbours(own, own.where("idx % 5 = 2"), 1).select("page", F.col("idx").cast("long").alias("idx"), F.col("center").cast("long").alias("center"))


@query(rf"""WITH d AS (SELECT source || '-' || (doc_id // 20) AS key, doc_id AS url, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
 q AS (SELECT key, url, trim(regexp_replace(substr(text, 1, 30), '\s+', ' ', 'g')) AS quote, text FROM d), e AS (SELECT key, unnest(regexp_extract_all(text, '(?i){contacts.EMAIL.replace("(?i)", "")}')) AS value FROM d)
 SELECT DISTINCT key, 'cache' AS mode FROM d WHERE key NOT IN (SELECT key FROM q WHERE NOT contains(text, quote)) AND key NOT IN (SELECT key FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.key = x.key AND y.value = lower(x.value)))""")
def cache_reuse(spark, d):
    """Cached quotes have their white space collapsed, cached addresses are in lower case; pages and contacts are as they are now."""
    own = table(spark, d, "documents").where("source is not null and text is not null").select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 20)).alias("key"), F.col("doc_id").alias("url"), "text")
    quotes = own.select("key", "url", F.trim(F.regexp_replace(F.substring("text", 1, 30), r"\s+", " ")).alias("quote"))
    current = own.select("key", F.explode(F.regexp_extract_all("text", F.lit(contacts.EMAIL), F.lit(0))).alias("value"))
    return T.reusable(own.select("key").distinct(), quotes, own, current.select("key", F.lower("value").alias("value")), current)


@query(f"""WITH {LEADS} SELECT id AS session, n_name AS country, orders, CASE WHEN orders = 0 THEN 'planned' WHEN orders < 10 THEN 'running' ELSE 'completed' END AS state FROM leads LEFT JOIN nation ON n_nationkey = nation""")
def campaign_status(spark, d):
    state = F.when(F.col("orders") == 0, "planned").when(F.col("orders") < 10, "running").otherwise("completed")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("country"))
    return leads(spark, d).join(F.broadcast(nations), "nation", "left").select(F.col("id").alias("session"), "country", "orders", state.alias("state"))


@query(f"""WITH {CONTACTS}, k AS (SELECT source, value, row_number() OVER (PARTITION BY source ORDER BY doc_id, value) AS r FROM contacts) SELECT source, value, r AS contact_ref, r <= 2 AS recommended FROM k""")
def recommended_contact(spark, d):
    order = F.row_number().over(Window.partitionBy("source").orderBy("doc_id", "value"))
    own = email_contacts(spark, d).withColumn("contact_ref", order.cast("long")).select("source", "value", "contact_ref")
    chosen = own.where("contact_ref <= 2").select("source", "contact_ref", F.lit(True).alias("recommended"))
    return own.join(chosen.hint("merge"), ["source", "contact_ref"], "left").withColumn("recommended", F.coalesce("recommended", F.lit(False)))


@query(f"WITH {POLICIES}, k AS (SELECT *, row_number() OVER (PARTITION BY market, status ORDER BY created DESC, version DESC) AS rn FROM policies) SELECT market, status, version, weight FROM k WHERE rn = 1")
def policy_lookup(spark, d):
    return T.latest_n(policies(spark, d), ["market", "status"], [F.desc("created"), F.desc("version")], 1).select("market", "status", "version", "weight")


@query("""WITH e AS (SELECT user_id AS key, ts, event_id FROM events WHERE event_type = 'signup'), l AS (SELECT user_id AS key, ts, event_id FROM events WHERE event_type <> 'signup')
 SELECT l.event_id, l.key, CASE WHEN l.ts < e.ts + INTERVAL 7 DAY THEN e.event_id END AS entry FROM l ASOF LEFT JOIN e ON l.key = e.key AND l.ts >= e.ts""")
def asof_cache(spark, d):
    own = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id", "event_type")
    lookups = own.where("event_type <> 'signup'").select("key", "ts", "event_id")
    return T.as_of(lookups, own.where("event_type = 'signup'").select("key", "ts", F.col("event_id").alias("id")), "key", "ts", "id", 7).select("event_id", "key", "entry")


@query("SELECT c_name AS brand, c_nationkey::BIGINT AS nation FROM (SELECT 'b' || (c_custkey % 900) AS c_name, c_nationkey FROM customer) WHERE c_name IN (SELECT 'b' || (c_custkey % 900) FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) = 1)")
def unique_brand(spark, d):
    own = table(spark, d, "customer").select(F.concat(F.lit("b"), F.col("c_custkey") % 900).alias("brand"), F.col("c_nationkey").cast("long").alias("domain"))
    return R.unique_brands(own).select("brand", F.col("domain").alias("nation"))


@query(f"""WITH {POLICIES}, a AS (SELECT market, 'h' || max(version) AS hash FROM policies WHERE status = 'approved' GROUP BY market)
 SELECT p.version AS id, p.market, CASE WHEN a.hash IS NOT NULL AND 'h' || p.version <> a.hash AND status <> 'reviewed' THEN a.hash ELSE 'h' || p.version END AS hash,
 CASE WHEN a.hash IS NOT NULL AND 'h' || p.version <> a.hash AND status <> 'reviewed' THEN 2 ELSE 1 END AS version FROM policies p LEFT JOIN a USING (market)""")
def propagate_policy(spark, d):
    own = policies(spark, d)
    strategies = own.select("market", F.col("version").alias("id"), F.when(F.col("status") == "reviewed", "completed").otherwise("open").alias("status"), F.concat(F.lit("h"), "version").alias("hash"), F.lit(1).alias("version"), F.lit("q").alias("queries"))
    approved = own.where("status = 'approved'").groupBy("market").agg(F.concat(F.lit("h"), F.max("version")).alias("hash"))
    return T.propagate(strategies, approved, "market").select("id", "market", "hash", "version")


@query("""SELECT t || ' ' || r || ' ' || c AS query, 'en' AS language FROM (SELECT p_name AS t, p_partkey AS tp FROM part), (SELECT r_name AS r, r_regionkey AS rp FROM region), (SELECT n_name AS c, n_nationkey AS cp FROM nation) ORDER BY tp, rp, cp LIMIT 200""")
def query_matrix(spark, d):
    terms, roles, cities = (table(spark, d, t).select(F.col(k).alias("pos"), F.col(v).alias("value")) for t, k, v in (("part", "p_partkey", "p_name"), ("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name")))
    return funnel.query_matrix(terms, roles, cities, 200).select("query", "language")


# ---- aggregates and windows


@query(f"""WITH {CONTACTS}, v AS (SELECT doc_id, value, regexp_extract(value, '@(.*)$', 1) AS dom, source, CASE WHEN regexp_matches(value, 'sales|trade|commercial|export|wholesale') THEN 'sales' ELSE 'other' END AS who FROM contacts),
 y AS (SELECT *, {_REGISTRABLE.format("dom")} AS site FROM v), s AS (SELECT source, min(site) AS own FROM y GROUP BY source), k AS (SELECT dom FROM v GROUP BY dom HAVING count(DISTINCT source) > 1)
 SELECT doc_id, value, round(least(1.0, 0.25::DOUBLE + CASE WHEN dom IN (FROM k) THEN 0.25 ELSE 0.0 END::DOUBLE + CASE WHEN coalesce(site = own, false) THEN 0.35 ELSE 0.0 END::DOUBLE + CASE WHEN who = 'sales' THEN 0.15 ELSE 0.0 END::DOUBLE), 6) AS confidence FROM y LEFT JOIN s ON s.source IS NOT DISTINCT FROM y.source""")
def contact_confidence(spark, d):
    """A company's domain is the first of its addresses; a domain that several companies use counts as one that takes mail."""
    own = email_contacts(spark, d).withColumn("dom", contacts.email_domain(F.col("value")))
    mx = own.groupBy("dom").agg((F.countDistinct("source") > 1).alias("present"))
    site = own.groupBy(F.col("source").alias("of")).agg(F.min(urls.registrable(F.col("dom"))).alias("own"))
    rows = own.join(mx.hint("merge"), "dom", "left").join(site.hint("merge"), F.col("source").eqNullSafe(F.col("of")), "left")
    c = contacts.email_confidence(F.col("dom").isNotNull(), F.col("present"), contacts.same_domain(F.col("dom"), F.col("own")), contacts.role(F.col("value"), F.lit("")))
    return rows.select("doc_id", "value", F.round(c, 6).alias("confidence"))


@query(f"""WITH {CONTACTS}, v AS (SELECT doc_id, value, split_part(value, '@', 1) AS loc, source FROM contacts)
 SELECT doc_id, value, (CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 0 END + 5 + CASE WHEN regexp_matches(value, 'sales|trade|commercial|export|wholesale') THEN 6 WHEN regexp_matches(value, 'help|support|service') THEN 0 WHEN regexp_matches(value, 'info|contact|office|general') THEN 3 ELSE 0 END
 + CASE WHEN regexp_matches(loc, 'sales|trade|commercial|export|procurement') THEN 4 ELSE 0 END + 2)::DOUBLE AS score FROM v""")
def contact_rank(spark, d):
    who = contacts.role(F.col("value"), F.lit(""))
    s = contacts.rank(F.col("value"), F.lit("email"), F.lit(0.5), F.col("doc_id") % 2 == 0, F.lit(False), F.lit(False), who)
    return email_contacts(spark, d).select("doc_id", "value", s.alias("score"))


FACT_TERMS = [("product", 0, "idiot"), ("product", 1, "worthless"), ("scale", 0, "licensed"), ("scale", 1, "clown")]


@query(f"""WITH {DOCS}, t(kind, pos, term) AS (VALUES {', '.join(map(str, FACT_TERMS))}), f AS (SELECT company, page_index, kind, pos, term FROM docs JOIN t ON contains(lower(text), term))
 SELECT company, 'ev-' || company || '-' || row_number() OVER (PARTITION BY company ORDER BY page_index, kind, pos) AS id, kind, term, page_index FROM f""")
def evidence_facts(spark, d):
    return evidence.facts_from_pages(docs(spark, d), spark.createDataFrame(FACT_TERMS, "kind string, pos int, term string"))


@query(f"""WITH {LEADS} SELECT id, fit, scale, CASE WHEN role = 'Unknown' THEN 0.58 ELSE round(least(0.97, 0.76 + products * 0.04), 6) END::DOUBLE AS confidence,
 role NOT IN ('Retailer', 'Service', 'Unknown') AND fit >= 60 AND scale >= 50 AS qualified, CASE WHEN products > 2 THEN 'High' WHEN scales > 0 THEN 'Medium' ELSE 'Unknown' END AS import_capability FROM leads""")
def company_scoring(spark, d):
    own = leads(spark, d).select("id", "products", "scales", "role", (F.col("products") > 2).alias("high"))
    return L.score(own).select("id", "fit", "scale", F.round("confidence", 6).alias("confidence"), "qualified", "import_capability")


@query("""WITH t AS (SELECT p_partkey, lower(p_type || ' ' || p_name || CASE WHEN p_size > 40 THEN ' Repair shop and' WHEN p_brand LIKE '%1' THEN ' Importer,' ELSE '' END || CASE WHEN p_retailprice > 950 THEN ' Distributor' WHEN p_type = 'PROMO' THEN ' wholesalers' WHEN p_size < 10 THEN ' manufacturer' ELSE '' END) AS s FROM part)
 SELECT p_partkey, CASE WHEN contains(s, 'repair shop') OR contains(s, 'retail') THEN 'Retailer' WHEN contains(s, 'distributor') THEN 'Distributor' WHEN contains(s, 'importer') THEN 'Importer' WHEN contains(s, 'wholesaler') THEN 'Wholesaler' WHEN contains(s, 'manufacturer') THEN 'Manufacturer' ELSE 'Unknown' END AS role FROM t""")
def business_role(spark, d):
    more = F.when(F.col("p_size") > 40, " Repair shop and").when(F.col("p_brand").endswith("1"), " Importer,").otherwise("")
    kind = F.when(F.col("p_retailprice") > 950, " Distributor").when(F.col("p_type") == "PROMO", " wholesalers").when(F.col("p_size") < 10, " manufacturer").otherwise("")
    return table(spark, d, "part").select("p_partkey", L.business_role(F.concat("p_type", F.lit(" "), "p_name", more, kind)).alias("role"))


QUALIFIED = "role NOT IN ('Retailer', 'Unknown') AND fit >= 60 AND scale >= 50"
STATUS = f"CASE WHEN confidence < 0.8 THEN 'needs_review' WHEN {QUALIFIED} THEN 'qualified' ELSE 'rejected' END"


def judged(spark, d):
    own = leads(spark, d).withColumn("qualified", ~F.col("role").isin("Retailer", "Unknown") & (F.col("fit") >= 60) & (F.col("scale") >= 50))
    return own.withColumn("status", L.status(F.col("confidence"), F.col("qualified")))


@query(f"WITH {LEADS} SELECT id, CASE WHEN id % 50 = 0 THEN 'approved' ELSE {STATUS} END AS status FROM leads")
def lead_status(spark, d):
    own = judged(spark, d).select("id", "status")
    decided = own.where("id % 50 = 0").select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("rejected").alias("decision")), F.struct(F.lit(2).alias("seq"), F.lit("approved").alias("decision")))).alias("x")).select("id", "x.*")
    return L.with_overrides(own, decided)


@query(f"WITH {LEADS}, q AS (SELECT *, {QUALIFIED} AS qualified FROM leads) SELECT campaign, id, domain, fit, scale, qualified, row_number() OVER (PARTITION BY campaign ORDER BY qualified DESC, fit + scale DESC, domain) AS rank FROM q")
def lead_ranking(spark, d):
    return L.rank_leads(judged(spark, d), ["campaign"]).select("campaign", "id", "domain", "fit", "scale", "qualified", "rank")


@query(f"""WITH {LEADS}, q AS (SELECT *, {QUALIFIED} AS qualified FROM leads), r AS (SELECT campaign, id, row_number() OVER (PARTITION BY campaign ORDER BY qualified DESC, confidence DESC, fit DESC, scale DESC, id) AS rank,
 greatest(0, count(*) OVER (PARTITION BY campaign) - 30) AS omitted FROM q) SELECT campaign, id, rank, omitted FROM r WHERE rank <= 30""")
def compact_report(spark, d):
    return L.compact(judged(spark, d), "campaign", 30).select("campaign", "id", "rank", "omitted")


@query(f"WITH {LEADS}, s AS (SELECT campaign, {STATUS} AS status FROM leads) SELECT campaign, count(*) FILTER (status = 'qualified') AS qualified, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'approved') AS approved FROM s GROUP BY campaign")
def status_pivot(spark, d):
    return L.status_counts(judged(spark, d), "campaign")


@query(f"""WITH {LEADS}, s AS (SELECT *, {QUALIFIED} AS q, {STATUS} AS status FROM leads), r AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY q DESC, fit + scale DESC, domain) AS rn FROM s)
 SELECT campaign, count(*) AS leads, count(*) FILTER (status = 'qualified') AS qualified, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'rejected') AS rejected,
 round(avg(fit), 6) AS avg_fit, string_agg(domain, ',' ORDER BY rn) FILTER (rn <= 5) AS recommended,
 array_to_string(list_filter([CASE WHEN count(*) FILTER (status = 'needs_review') > 0 THEN 'unreviewed' END, CASE WHEN count(*) FILTER (status = 'qualified') = 0 THEN 'none_qualified' END, CASE WHEN bool_or(orders = 0) THEN 'coverage' END], lambda x: x IS NOT NULL), ',') AS risks FROM r GROUP BY campaign""")
def campaign_report(spark, d):
    return L.campaign_report(judged(spark, d), "campaign")


@query(f"WITH {LEADS} SELECT id, CASE WHEN id % 9 = 0 THEN '''=' || domain ELSE domain END AS domain, {STATUS} AS status, fit, scale, confidence FROM leads")
def export_leads(spark, d):
    own = judged(spark, d).withColumn("domain", F.when(F.col("id") % 9 == 0, F.concat(F.lit("="), "domain")).otherwise(F.col("domain")))
    return L.export_rows(own, ["id", "domain", "status", "fit", "scale", "confidence"])


@query("SELECT l_orderkey AS lead, 'ev-' || l_linenumber AS evidence_id, l_returnflag AS kind, round(l_discount * 10, 6) AS confidence FROM lineitem")
def export_evidence(spark, d):
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("lead"), F.concat(F.lit("ev-"), "l_linenumber").alias("evidence_id"), F.col("l_returnflag").alias("kind"), F.round(F.col("l_discount") * 10, 6).alias("confidence"))
    return L.export_rows(own, ["lead", "evidence_id", "kind", "confidence"])


@query(f"WITH {LEADS} SELECT campaign, 1 AS schema_version, count(*) AS leads, sum(orders)::BIGINT AS evidence FROM leads GROUP BY campaign")
def export_campaign_header(spark, d):
    return leads(spark, d).groupBy("campaign").agg(F.lit(1).alias("schema_version"), F.count("*").alias("leads"), F.sum("orders").alias("evidence"))


@query(f"""WITH {LEADS}, g AS (SELECT campaign, count(*) AS leads, max(fit) AS best_fit, min(domain) AS first_domain FROM leads GROUP BY campaign)
 SELECT campaign, 'leads' AS field, leads::VARCHAR AS value FROM g UNION ALL SELECT campaign, 'best_fit', best_fit::VARCHAR FROM g UNION ALL SELECT campaign, 'first_domain', first_domain FROM g""")
def export_summary_unpivot(spark, d):
    own = leads(spark, d).groupBy("campaign").agg(F.count("*").alias("leads"), F.max("fit").alias("best_fit"), F.min("domain").alias("first_domain"))
    return L.summary_fields(own, "campaign", ["leads", "best_fit", "first_domain"])


@query(f"WITH {CONTACTS} SELECT DISTINCT source AS company, 'email' AS type, CASE WHEN regexp_matches(value, '^[=+@-]') THEN '''' || value ELSE value END AS value FROM contacts")
def export_contacts(spark, d):
    own = email_contacts(spark, d).select(F.col("source").alias("company"), F.lit("email").alias("type"), "value").distinct()
    return L.export_rows(own, ["company", "type", "value"])


SLOT_TERMS = [("identity", "the"), ("identity", "is"), ("productFit", "of"), ("productFit", "and"), ("productFit", "in"), ("businessRole", "la"), ("businessRole", "der")]
QUOTAS = {"identity": 10, "productFit": 20, "businessRole": 12}


@query(rf"""WITH {CHUNKS}, s(slot, term) AS (VALUES {', '.join(map(str, SLOT_TERMS))}),
 u AS (SELECT *, ['/', '/about', '/products', '/contact', '/x'][page_index % 5 + 1] AS path FROM chunks),
 w AS (SELECT company, ref, unnest(list_distinct(string_split_regex(lower(text || ' T https://a.example' || path), '[^\p{{L}}\p{{N}}]+'))) AS term FROM u),
 n AS (SELECT company, slot, ref, count(*) AS n FROM w JOIN s USING (term) GROUP BY company, slot, ref),
 o AS (SELECT u.company, k.slot, u.ref, page_index, coalesce(n, 0) + CASE WHEN page_index = 0 THEN 1 ELSE 0 END + CASE WHEN page_index % 9 = 4 AND idx = 0 THEN 12 ELSE 0 END
   + CASE path WHEN '/' THEN CASE k.slot WHEN 'identity' THEN 5 ELSE 0 END WHEN '/about' THEN CASE k.slot WHEN 'identity' THEN 4 ELSE 1 END WHEN '/products' THEN CASE k.slot WHEN 'identity' THEN 1 ELSE 4 END
     WHEN '/contact' THEN CASE k.slot WHEN 'identity' THEN 3 ELSE 0 END ELSE 0 END AS score
   FROM u CROSS JOIN (SELECT DISTINCT slot FROM s) k LEFT JOIN n ON n.company = u.company AND n.slot = k.slot AND n.ref = u.ref),
 r AS (SELECT *, row_number() OVER (PARTITION BY company, slot ORDER BY score DESC, page_index, ref) AS rank FROM o WHERE score > 0)
 SELECT company, slot, ref, page_index, score, rank FROM r WHERE rank <= CASE slot WHEN 'identity' THEN 10 WHEN 'productFit' THEN 20 ELSE 12 END""")
def evidence_topk(spark, d):
    paths = F.array(*map(F.lit, ["/", "/about", "/products", "/contact", "/x"]))
    url = F.concat(F.lit("https://a.example"), F.get(paths, (F.col("page_index") % 5).cast("int")))
    own = chunks(spark, d).withColumn("url", url).withColumn("title", F.lit("T"))
    return evidence.rank_evidence(own, spark.createDataFrame(SLOT_TERMS, "slot string, term string"), own.where("page_index % 9 = 4 and idx = 0"), QUOTAS)


SEARCHED = r"""w AS (SELECT doc_id, company, page_index, len(list_intersect(list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}]+')), ['the', 'of', 'is', 'la', 'de'])) AS score FROM docs),
 r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY score DESC, page_index) AS rank, count(*) OVER (PARTITION BY company) AS total FROM w WHERE score > 0)"""


@query(f"WITH {DOCS}, {SEARCHED} SELECT company, doc_id, score::BIGINT AS score, rank, total, CASE WHEN total > 10 THEN 10 END::BIGINT AS next_cursor FROM r WHERE rank <= 10")
def evidence_search(spark, d):
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    score = F.size(F.array_intersect(words, F.array(*map(F.lit, ["the", "of", "is", "la", "de"])))).cast("long")
    own = docs(spark, d).select("company", "doc_id", "page_index", score.alias("score")).where("score > 0")
    return evidence.search_page(own, ["company"], [F.desc("score"), F.col("page_index")], 0, 10).drop("page_index")


@query(f"WITH {DOCS}, r AS (SELECT company, doc_id, row_number() OVER (PARTITION BY company ORDER BY page_index) AS rank, count(*) OVER (PARTITION BY company) AS total FROM docs) SELECT company, doc_id, rank, total, CASE WHEN total > 16 THEN 16 END::BIGINT AS next_cursor FROM r WHERE rank BETWEEN 9 AND 16")
def evidence_page(spark, d):
    return evidence.search_page(docs(spark, d).select("company", "doc_id", "page_index"), ["company"], [F.col("page_index")], 8, 8).drop("page_index")


@query(f"WITH {POLICIES}, r AS (SELECT market, version, row_number() OVER (PARTITION BY market ORDER BY created DESC, version DESC) AS rank FROM policies) SELECT market, version, rank FROM r WHERE rank <= 10")
def latest_n_per_key(spark, d):
    return T.latest_n(policies(spark, d), ["market"], [F.desc("created"), F.desc("version")], 10).select("market", "version", "rank")


@query(f"""WITH {POLICIES}, a AS (SELECT market, version, created AS valid_from, lead(created) OVER (PARTITION BY market ORDER BY created, version) AS valid_to FROM policies WHERE status = 'approved')
 SELECT market, version, valid_from, valid_to, CASE WHEN valid_to IS NULL THEN 'approved' ELSE 'superseded' END AS state FROM a""")
def policy_scd(spark, d):
    return T.validity(policies(spark, d), "market", "created", "version").select("market", "version", "valid_from", "valid_to", "state")


@query(f"WITH {MESSAGES}, r AS (SELECT conv_id, turn, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent FROM messages) SELECT conv_id, turn, tokens, spent::BIGINT AS spent FROM r WHERE spent <= 300")
def history_window(spark, d):
    return budget.newest_within(messages(spark, d), "conv_id", "turn", 300).select("conv_id", "turn", "tokens", "spent")


@query(f"""WITH RECURSIVE {MESSAGES}, s AS (SELECT conv_id, turn, tokens, turn = 0 AS required, turn % 2 = 1 AS may_cut FROM messages),
 f(conv_id, pos, action, used, total) AS (SELECT conv_id, -1::BIGINT, '', 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT conv_id FROM s)
 UNION ALL SELECT s.conv_id, s.turn, CASE WHEN tokens <= 300 - total THEN 'included' WHEN may_cut AND 300 - total > 32 THEN 'truncated' WHEN required THEN 'failed' ELSE 'dropped' END,
   CASE WHEN tokens <= 300 - total THEN tokens WHEN may_cut AND 300 - total > 32 THEN ((300 - total) * 9 // 10) ELSE 0 END,
   total + CASE WHEN tokens <= 300 - total THEN tokens WHEN may_cut AND 300 - total > 32 THEN ((300 - total) * 9 // 10) ELSE 0 END
 FROM f JOIN s ON s.conv_id = f.conv_id AND s.turn = f.pos + 1)
 SELECT conv_id, pos, action, used FROM f WHERE pos >= 0""")
def context_budget(spark, d):
    own = messages(spark, d).select("conv_id", F.col("turn").alias("pos"), "tokens", (F.col("turn") == 0).alias("required"), (F.col("turn") % 2 == 1).alias("may_cut"))
    return budget.fit_sections(own, "conv_id", 300)


@query(f"WITH {MESSAGES} SELECT conv_id, count(*) AS messages, sum(CASE WHEN role = 'assistant' THEN tokens ELSE 0 END)::BIGINT AS output, sum(CASE WHEN role <> 'assistant' THEN tokens ELSE 0 END)::BIGINT AS input FROM messages GROUP BY conv_id")
def usage_totals(spark, d):
    return budget.usage(messages(spark, d), "conv_id")


@query(f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY campaign, lower(domain) ORDER BY round, pos) AS rn FROM hits) SELECT campaign, domain, round, pos FROM r WHERE rn = 1")
def first_per_domain(spark, d):
    return funnel.first_per_domain(hits(spark, d)).select("campaign", "domain", "round", "pos")


@query(f"WITH {HITS} SELECT campaign, round, count(*) FILTER (round = first) AS new_hits, count(DISTINCT domain) FILTER (round = first) AS new_domains FROM (SELECT *, min(round) OVER (PARTITION BY campaign, domain) AS first FROM hits) GROUP BY ALL")
def new_domains(spark, d):
    own = hits(spark, d).withColumn("first", F.min("round").over(Window.partitionBy("campaign", "domain")))
    is_new = F.col("round") == F.col("first")
    return own.groupBy("campaign", "round").agg(F.count_if(is_new).alias("new_hits"), F.countDistinct(F.when(is_new, F.col("domain"))).alias("new_domains"))


@query(f"WITH {HITS} SELECT campaign, domain, count(*) - 1 AS repeats FROM hits WHERE NOT ({EXCLUDED_USERS}) GROUP BY campaign, domain")
def domain_repeats(spark, d):
    own = hits(spark, d).where(~F.col("domain").isin("u1", "u2", "u3", "u5", "u8"))
    return own.groupBy("campaign", "domain").agg((F.count("*") - 1).alias("repeats"))


STREAK = f"""{ROUNDS}, l AS (SELECT *, new <= 7 AS low, sum(CASE WHEN new <= 7 THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY round) AS island FROM rounds),
 streaks AS (SELECT grp, round, raw, new, low, CASE WHEN low THEN sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY grp, island ORDER BY round) ELSE 0 END::BIGINT AS streak FROM l)"""


@query(f"WITH {STREAK} SELECT grp, round, low, streak, streak >= 3 AS saturated FROM streaks")
def low_yield_streak(spark, d):
    return R.low_yield_streak(rounds(spark, d), F.col("new") <= R.LOW_NEW).select("grp", "round", "low", "streak", "saturated")


@query(f"WITH {ROUNDS} SELECT grp, count(*) AS executed, sum(new)::BIGINT AS new_total, arg_max(new, round) AS last_new, round(arg_max(new::DOUBLE / nullif(raw, 0), round), 6) AS last_rate FROM rounds GROUP BY grp")
def group_progress(spark, d):
    return R.group_progress(rounds(spark, d))


@query(f"""WITH {STREAK}, g AS (SELECT grp, count(*) AS executed, bool_or(streak >= 3) AS saturated FROM streaks GROUP BY grp)
 SELECT length(grp) % 2 AS campaign, sum(executed)::BIGINT AS executed, CASE WHEN sum(executed) >= 100 THEN 'max_queries' WHEN bool_and(saturated) THEN 'all_groups_saturated' ELSE 'plan_exhausted' END AS reason FROM g GROUP BY 1""")
def stop_reason(spark, d):
    own = R.low_yield_streak(rounds(spark, d), F.col("new") <= R.LOW_NEW).groupBy("grp").agg(F.count("*").alias("executed"), F.bool_or("saturated").alias("saturated"))
    own = own.withColumn("campaign", (F.length("grp") % 2).cast("long"))
    return R.stop_reason(own, "campaign", "executed", "saturated", 100)


@query()
def saturation_replay(spark, d):
    own = hits(spark, d).select((F.col("pos") % 3).cast("string").alias("campaign"), F.col("campaign").alias("grp"), "round", "domain")
    return R.replay_saturation(own)


BRANDS = rf"""brands AS (SELECT {NORM.format('v')} AS brand, domain, arg_max(trim(v), pos) AS value, arg_max(conf, pos) AS confidence FROM
 (SELECT p_partkey AS pos, p_name || ' ' || p_brand AS v, 'd' || (p_partkey % 40) AS domain, 0.8 + (p_partkey % 4) * 0.05 AS conf, p_partkey % 3 AS s FROM part)
 WHERE conf >= 0.85 AND s < 2 AND len(list_filter(string_split({NORM.format('v')}, ' '), lambda x: x NOT IN ('small', 'red', 'ring', 'widget') AND length(x) >= 4)) > 0 GROUP BY 1, 2)"""


@query(f"WITH {BRANDS} SELECT brand, domain, value, round(confidence, 6)::DOUBLE AS confidence FROM brands")
def brand_fingerprints(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", "p_brand").alias("value"), F.concat(F.lit("d"), F.col("p_partkey") % 40).alias("domain"), F.lit("identity").alias("kind"), F.round(0.8 + (F.col("p_partkey") % 4) * 0.05, 2).alias("confidence"), F.when(F.col("p_partkey") % 3 < 2, "qualified").otherwise("rejected").alias("status"))
    return R.brand_fingerprints(own, ["small red", "ring widget"]).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH RECURSIVE {HITS}, c AS (SELECT campaign, domain, count(*) - 1 AS n FROM hits GROUP BY ALL), r AS (SELECT campaign, '-site:' || domain || '.example-company.com' AS token, row_number() OVER (PARTITION BY campaign ORDER BY n DESC, domain) AS pos FROM c),
 f(campaign, pos, used, filters) AS (SELECT campaign, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM (SELECT DISTINCT campaign FROM c)
 UNION ALL SELECT f.campaign, r.pos, CASE WHEN used + length(token) + 1 <= 300 AND len(filters) < 20 THEN used + length(token) + 1 ELSE used END, CASE WHEN used + length(token) + 1 <= 300 AND len(filters) < 20 THEN list_append(filters, token) ELSE filters END
 FROM f JOIN r ON r.campaign = f.campaign AND r.pos = f.pos + 1 WHERE r.pos <= 12)
 SELECT campaign, array_to_string(arg_max(filters, pos), ' ') AS filters, max(used)::BIGINT AS used FROM f GROUP BY campaign""")
def filter_budget(spark, d):
    own = hits(spark, d).groupBy("campaign", "domain").agg((F.count("*") - 1).alias("n"))
    own = T.latest_n(own, ["campaign"], [F.desc("n"), F.col("domain")], R.MAX_DOMAINS)
    tokens = own.select("campaign", F.col("rank").alias("pos"), F.concat(F.lit("-site:"), "domain", F.lit(".example-company.com")).alias("token"), F.lit(False).alias("brand"))
    return R.fill_budget(tokens, "campaign", 300).select("campaign", F.array_join("filters", " ").alias("filters"), F.col("used").cast("long").alias("used"))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS run, o_orderdate AS finished, o_custkey % 7 AS planned, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS queries, o_orderpriority AS domain FROM orders),
 x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY finished DESC, run DESC) AS rn FROM r)
 SELECT k AS country, count(*) AS runs, max(finished) AS last_run, sum(coalesce(queries, planned))::BIGINT AS queries, count(DISTINCT domain) AS domains, string_agg(run::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 5) AS recent FROM x GROUP BY k""")
def country_history(spark, d):
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("country"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("finished"), (F.col("o_custkey") % 7).alias("planned"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3).alias("queries"), F.col("o_orderpriority").alias("domain"))
    return L.history(own, "country")


@query("WITH r AS (SELECT substr(CASE WHEN contains(props, ':') THEN split_part(event_type || '：' || props, '：', 1) ELSE event_type END, 1, 40) AS reason FROM events) SELECT reason, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, reason LIMIT 6")
def skip_reasons(spark, d):
    reason = F.substring(F.substring_index(F.concat_ws("：", "event_type", "props"), "：", 1), 1, 40)
    return table(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(6)


@query(f"WITH {ROUTED} SELECT campaign, count(*) FILTER (stage <> 'new') AS skipped, count(*) FILTER (stage = 'snippet_rejected') AS gated, round(100.0 * count(*) FILTER (stage = 'snippet_rejected') / nullif(count(*) FILTER (stage IN ('snippet_rejected', 'new')), 0))::BIGINT AS reject_percent FROM routed GROUP BY campaign")
def gate_effectiveness(spark, d):
    gated, judged_hits = F.count_if(F.col("stage") == "snippet_rejected"), F.count_if(F.col("stage").isin("snippet_rejected", "new"))
    return routed(spark, d).groupBy("campaign").agg(F.count_if(F.col("stage") != "new").alias("skipped"), gated.alias("gated"), F.round(100 * gated / F.nullif(judged_hits, F.lit(0))).cast("long").alias("reject_percent"))


@query(f"WITH {LOGS} SELECT event, count(*) AS n FROM logs WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY event")
def events_since(spark, d):
    return G.events_since(logs(spark, d), "2024-01-10")


@query(f"""WITH {LOGS} SELECT count(*) AS records, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (status >= 400) AS failed, round(avg(coalesce(duration_ms, 0)))::BIGINT AS average_ms,
 round(max(duration_ms), 6) AS maximum_ms, min(ts) AS first_ts, max(ts) AS last_ts FROM logs""")
def log_summary(spark, d):
    return G.summary(logs(spark, d))


@query(f"WITH {LOGS} SELECT level, count(*) AS n FROM logs GROUP BY level")
def log_levels(spark, d):
    return G.counts(logs(spark, d), "level")


@query(f"WITH {LOGS} SELECT status, count(*) AS n FROM logs GROUP BY status")
def http_status_hist(spark, d):
    return G.access_stats(logs(spark, d))


@query(f"WITH {LOGS} SELECT agent, count(*) FILTER (level <> 'error') AS completed, count(*) FILTER (level = 'error') AS failed, round(avg(duration_ms), 4) AS average_ms FROM logs GROUP BY agent")
def agent_counts(spark, d):
    return G.agents(logs(spark, d))


@query(f"WITH {LOGS}, r AS (SELECT event_id, ts, event, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM logs WHERE level = 'error' OR status >= 500) SELECT * FROM r WHERE rank <= 20")
def recent_errors(spark, d):
    return G.recent_errors(logs(spark, d)).select("event_id", "ts", "event", "rank")


@query(f"WITH {LOGS}, r AS (SELECT agent, count(*) FILTER (level = 'error') AS retries FROM logs GROUP BY agent) SELECT agent, retries, (500 * pow(2, least(retries, 20)))::BIGINT AS next_delay_ms FROM r")
def retry_counts(spark, d):
    return G.retries(logs(spark, d), "agent", 500)


@query(f"WITH {DOCS} SELECT company, count(*) AS pages, sum(length(text))::BIGINT AS chars, count(*) FILTER (first < page_index) AS duplicates FROM (SELECT *, min(page_index) OVER (PARTITION BY company, sha256(trim(text))) AS first FROM docs) GROUP BY company")
def company_manifest(spark, d):
    own = P.duplicate_pages(docs(spark, d), "company", "page_index", "text")
    return own.groupBy("company").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.count("duplicate_of").alias("duplicates"))


@query("SELECT o_custkey, string_agg(p, ',' ORDER BY pos) AS priorities FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2) GROUP BY 1")
def distinct_products(spark, d):
    own = evidence.distinct_in_order(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")
    return own.select("o_custkey", F.array_join("values", ",").alias("priorities"))


_PIECES = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))


@query(f"""WITH {CONTACTS}, p AS (SELECT company, sha256(concat_ws(',', {_PIECES})) AS page_fingerprint FROM (SELECT source AS company, sha256('{{"doc_id":' || doc_id || ',"lang":"' || lang || '","text_sha":"' || sha256(text) || '"}}') AS h FROM documents) GROUP BY company),
 c AS (SELECT company, sha256(concat_ws(',', {_PIECES})) AS candidate_fingerprint FROM (SELECT DISTINCT source AS company, sha256('{{"value":"' || value || '"}}') AS h FROM contacts) GROUP BY company),
 g AS (SELECT source AS company, 'strategy-' || min(lang) AS strategy FROM documents GROUP BY source)
 SELECT p.company, page_fingerprint, candidate_fingerprint, sha256(concat_ws('|', page_fingerprint, coalesce(candidate_fingerprint, ''), strategy)) AS decision_fingerprint FROM p LEFT JOIN c ON c.company IS NOT DISTINCT FROM p.company JOIN g ON g.company IS NOT DISTINCT FROM p.company""")
def fingerprints(spark, d):
    own = table(spark, d, "documents").select(F.col("source").alias("company"), "doc_id", "lang", F.sha2("text", 256).alias("text_sha"))
    found = email_contacts(spark, d).select(F.col("source").alias("company"), "value").distinct()
    strategies = own.groupBy("company").agg(F.concat(F.lit("strategy-"), F.min("lang")).alias("strategy"))
    return evidence.company_fingerprints(own, ["doc_id", "lang", "text_sha"], found, ["value"], strategies, "company")


@query(f"""WITH {PAGE_HITS}, l AS (SELECT domain, link AS url, max(50 + page_id % 7)::BIGINT AS priority FROM page_hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, url) AS rank FROM l) SELECT domain, url, priority, rank FROM r WHERE rank <= 3""")
def site_page_topk(spark, d):
    own = page_hits(spark, d).select("domain", F.col("link").alias("url"), (50 + F.col("page_id") % 7).cast("long").alias("priority"))
    return P.select_site_pages(own, 3)


@query()
def site_page_select(spark, d):
    """A site's pages link to the three after them; the link's priority is the rank of the page's title and its length."""
    own = page_hits(spark, d).select("domain", "page_id", F.col("link").alias("url"), (urls.link_rank(F.col("title")) + F.length("html") % 40).alias("priority"))
    order = Window.partitionBy("domain").orderBy("page_id")
    before = F.array(*[F.lag("url", i).over(order) for i in (1, 2, 3)])
    sources = own.withColumn("before", before).select("domain", "url", "priority", F.explode(F.when(F.get("before", F.lit(0)).isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.filter("before", lambda x: x.isNotNull()))).alias("src"))
    return P.crawl_frontier(sources, own, 20)


# ---- sets and tables


@query("SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'event', event_id FROM events")
def append_rounds(spark, d):
    a = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return a.unionByName(table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id")))


@query("SELECT domain, arg_max(v, seq) AS value FROM (SELECT lower(c_name) AS domain, 'old' AS v, 0 AS seq FROM customer UNION ALL SELECT lower(c_name), 'new', 1 FROM customer WHERE c_custkey % 4 = 0) GROUP BY domain")
def queue_merge(spark, d):
    c = table(spark, d, "customer")
    old = c.select(F.lower("c_name").alias("domain"), F.lit("old").alias("value"), F.lit(0).alias("seq"))
    new = c.where("c_custkey % 4 = 0").select(F.lower("c_name").alias("domain"), F.lit("new").alias("value"), F.lit(1).alias("seq"))
    return T.upsert(old, new, ["domain"], "seq", ["value"], [])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def failures_except(spark, d):
    requeued = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").join(requeued, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT 'u' || user_id AS domain FROM events UNION SELECT 'u' || c_custkey FROM customer")
def seen_union(spark, d):
    a = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("domain"))
    return a.union(table(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("domain"))).distinct()


@query("SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS payload, arg_min(o_orderdate, o_orderkey) AS created FROM orders GROUP BY o_custkey")
def upsert_latest(spark, d):
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("payload"), F.col("o_orderdate").alias("created"))
    return T.upsert(own.where("seq % 2 = 0"), own.where("seq % 2 = 1"), ["id"], "seq", ["status", "payload"], ["created"])


@query("SELECT o_orderkey, o_orderdate AS completed_at, '{\"status\":\"' || o_orderstatus || '\",\"leads\":' || (o_custkey % 10) || '}' AS result, o_custkey % 10 AS leads FROM orders")
def campaign_scan(spark, d):
    body = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 10).alias("leads")))
    own = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("completed_at"), body.alias("result"))
    return own.withColumn("leads", F.from_json("result", "status string, leads bigint")["leads"])


@query("SELECT page_id, url, 'manual' AS search_mode FROM pages WHERE starts_with(url, 'https') UNION ALL SELECT page_id, url, 'search' FROM pages WHERE NOT starts_with(url, 'https')")
def manual_candidates(spark, d):
    own = table(spark, d, "pages").select("page_id", "url")
    return own.where(F.col("url").startswith("https")).withColumn("search_mode", F.lit("manual")).unionByName(own.where(~F.col("url").startswith("https")).withColumn("search_mode", F.lit("search")))


# ---- quality


@query("""SELECT p_partkey, unnest(list_filter([CASE WHEN NOT regexp_matches(p_brand, '^Brand#[0-9]$') THEN 'brand_code' END, CASE WHEN NOT (p_size BETWEEN 1 AND 40) THEN 'size_range' END, CASE WHEN NOT (p_type IN ('ECONOMY', 'STANDARD', 'PROMO')) THEN 'type_member' END, CASE WHEN NOT (p_retailprice < 1000) THEN 'price' END], lambda x: x IS NOT NULL)) AS rule FROM part""")
def rule_violations(spark, d):
    rules = {"brand_code": F.col("p_brand").rlike("^Brand#[0-9]$"), "size_range": F.col("p_size").between(1, 40), "type_member": F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO"), "price": F.col("p_retailprice") < 1000}
    return quality.rule_violations(table(spark, d, "part"), ["p_partkey"], rules)


SUBMISSIONS = f"""{CHUNKS}, sl AS (SELECT 's' || doc_id AS lead, source AS company, (doc_id % 120)::BIGINT AS fit, (doc_id % 90)::BIGINT AS scale, (doc_id % 11) / 10.0::DOUBLE AS confidence, doc_id % 2 = 0 AS reviewed, doc_id FROM documents),
 sf AS (SELECT 's' || doc_id AS lead, source AS company, CASE WHEN doc_id % 7 = 1 THEN 'f0' ELSE 'f' || k END AS id, 'p' || (doc_id % 55) || '-s' || k AS ref FROM documents, range(2) t(k) WHERE doc_id % 7 <> 6),
 sr AS (SELECT 's' || doc_id AS lead, source AS company, 'p' || (doc_id % 55) || '-s' || CASE WHEN doc_id % 7 = 2 THEN 2 ELSE 0 END AS ref, CASE doc_id % 3 WHEN 0 THEN 'scale' WHEN 1 THEN 'product' ELSE 'role' END AS use FROM documents),
 violations AS (SELECT lead, unnest(list_filter([CASE WHEN NOT (fit BETWEEN 0 AND 100 AND scale BETWEEN 0 AND 100) THEN 'score_range' END, CASE WHEN NOT (confidence BETWEEN 0 AND 1) THEN 'confidence_range' END, CASE WHEN NOT (confidence >= 0.8 OR reviewed) THEN 'review_required' END], lambda x: x IS NOT NULL)) AS rule FROM sl
 UNION ALL SELECT lead, 'unknown_chunk' FROM sf WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.company = sf.company AND c.ref = sf.ref)
 UNION ALL SELECT lead, 'duplicate_id' FROM (SELECT lead, id FROM sf GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT DISTINCT lead, 'missing_fact' FROM sr WHERE NOT EXISTS (SELECT 1 FROM sf WHERE sf.lead = sr.lead AND sf.ref = sr.ref)
 UNION ALL SELECT lead, 'no_evidence' FROM sl WHERE lead NOT IN (SELECT lead FROM sf))"""


def submissions(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.concat(F.lit("s"), "doc_id").alias("lead"), F.col("source").alias("company"))
    n = F.col("doc_id")
    ls = own.select("lead", "company", (n % 120).alias("fit"), (n % 90).alias("scale"), ((n % 11) / 10.0).alias("confidence"), (n % 2 == 0).alias("reviewed"))
    fs = own.where("doc_id % 7 <> 6").select("lead", "company", "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    page = F.concat(F.lit("p"), n % 55, F.lit("-s"))
    fs = fs.select("lead", "company", F.when(n % 7 == 1, "f0").otherwise(F.concat(F.lit("f"), "k")).alias("id"), F.concat(page, "k").alias("ref"))
    rs = own.select("lead", "company", F.concat(page, F.when(n % 7 == 2, 2).otherwise(0)).alias("ref"), F.when(n % 3 == 0, "scale").when(n % 3 == 1, "product").otherwise("role").alias("use"))
    return ls, fs, rs, chunks(spark, d)


@query(f"WITH {SUBMISSIONS} SELECT lead, rule, count(*) AS n FROM violations GROUP BY ALL")
def submission_violations(spark, d):
    return quality.submission_violations(*submissions(spark, d)).groupBy("lead", "rule").agg(F.count("*").alias("n"))


# DuckDB's \s lacks the vertical tab.
_PHONE = contacts.PHONE.replace(r"\s", r"\s\x0B")
V1 = rf"""d AS (SELECT doc_id AS lead, source, min(doc_id) OVER (PARTITION BY text) AS first, text, lang, n_chars, string_split(text, chr(10)) AS lines, len(regexp_extract_all(text, '(?i){contacts.EMAIL.replace("(?i)", "")}')) AS mails, len(regexp_extract_all(text, '{_PHONE}')) AS phones FROM documents WHERE text IS NOT NULL),
 f AS (SELECT lead, 'f' || (length(lines[k + 1]) % 10) AS id, 's' || (length(lines[k + 1]) // 100) AS ref FROM d, range(3) t(k) WHERE k < len(lines)),
 m AS (SELECT lead, 'c' || k AS ref, k < mails AS known, k < phones AS chosen FROM (SELECT lead, mails, phones, unnest(range(greatest(mails, phones))) AS k FROM d)),
 violations AS (SELECT lead, 'pages_unread' AS rule FROM d WHERE NOT coalesce(n_chars <= 20000, false) UNION ALL SELECT lead, 'company_id' FROM d LEFT JOIN (SELECT doc_id, source AS claimed FROM documents) ON doc_id = first WHERE claimed IS DISTINCT FROM source
  UNION ALL SELECT lead, 'review_required' FROM d WHERE NOT coalesce((n_chars % 100) / 100.0::DOUBLE >= 0.8 AND lang = 'en', false) AND NOT contains(text, 'the')
  UNION ALL SELECT lead, 'unknown_contact' FROM m WHERE chosen AND NOT known UNION ALL SELECT lead, 'duplicate_id' FROM (SELECT lead, id FROM f GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT lead, 'unknown_chunk' FROM f JOIN d USING (lead) WHERE NOT coalesce(substr(ref, 2)::BIGINT <= n_chars // 960, false) UNION ALL SELECT lead, 'unknown_id' FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lead = d.lead AND id = 'f' || (n_chars % 10))
  UNION ALL SELECT lead, 'recommended_contact' FROM d WHERE phones > 0 AND mails < phones)"""


@query(f"WITH {V1} SELECT lead, rule, count(*) AS n FROM violations GROUP BY ALL")
def submission_v1_violations(spark, d):
    """A document is a submission: its first lines are facts, its addresses the known contacts, as many as it has phones are chosen and the last of them recommended; copies claim the source of their first."""
    docs_ = table(spark, d, "documents").where("text is not null")
    first = F.min("doc_id").over(Window.partitionBy("text"))
    count = lambda pattern: F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    own = docs_.select(F.col("doc_id").alias("lead"), "source", first.alias("first"), "text", "lang", "n_chars", count(contacts.EMAIL).alias("mails"), count(contacts.PHONE).alias("phones"))
    claimed = table(spark, d, "documents").select(F.col("doc_id").alias("first"), F.col("source").alias("claimed"))
    known = own.join(claimed.hint("merge"), "first", "left")
    recommended = F.when(F.col("phones") > 0, F.concat(F.lit("c"), F.col("phones") - 1)).otherwise("none")
    subs = known.select("lead", F.col("source").alias("company_id"), F.col("claimed").alias("candidate_id"), (F.col("n_chars") <= 20000).alias("all_read"), ((F.col("n_chars") % 100) / 100.0).alias("confidence"), (F.col("lang") == "en").alias("qualified"), F.contains("text", F.lit("the")).alias("reviewed"), recommended.alias("recommended"))
    refs = lambda n, c: own.where(F.col(n) > 0).select("lead", F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("k")).select("lead", F.concat(F.lit(c), "k").alias("ref"))
    lines = own.select("lead", F.explode(F.slice(F.split("text", "\n"), 1, 3)).alias("line"))
    fs = lines.select("lead", F.concat(F.lit("f"), F.length("line") % 10).alias("id"), F.concat(F.lit("s"), F.floor(F.length("line") / 100)).alias("ref"))
    cs = own.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 960))).alias("k")).select("lead", F.concat(F.lit("s"), "k").alias("ref"))
    uses = own.select("lead", F.concat(F.lit("f"), F.col("n_chars") % 10).alias("id"))
    return quality.submission_v1_violations(subs, refs("phones", "c"), refs("mails", "c"), fs, cs, uses).groupBy("lead", "rule").agg(F.count("*").alias("n"))


@query(f"""WITH {SUBMISSIONS} SELECT lead, ref, false AS repaired, '' AS kind FROM sf UNION ALL SELECT sr.lead, sr.ref, true, CASE use WHEN 'role' THEN 'business_role' ELSE use END FROM sr JOIN chunks c ON c.company = sr.company AND c.ref = sr.ref WHERE NOT EXISTS (SELECT 1 FROM sf WHERE sf.lead = sr.lead AND sf.ref = sr.ref)""")
def submission_repair(spark, d):
    _, fs, rs, cs = submissions(spark, d)
    own = fs.select("lead", "company", "ref", F.lit("").alias("kind"), F.lit("").alias("value"), F.lit(0.9).alias("confidence"))
    return quality.repair_submissions(own, rs, cs).select("lead", "ref", "repaired", "kind")


HINTS = [("score_range", "Scores lie between 0 and 100."), ("review_required", "Review before submitting."), ("unknown_chunk", "Read the chunk first."), ("missing_fact", "Add the fact."), ("no_evidence", "Add evidence.")]


@query(f"WITH {SUBMISSIONS}, h(rule, hint) AS (VALUES {', '.join(map(str, HINTS))}) SELECT DISTINCT lead, hint FROM violations JOIN h USING (rule)")
def violation_hints(spark, d):
    hints = spark.createDataFrame(HINTS, "rule string, hint string")
    return quality.violation_hints(quality.submission_violations(*submissions(spark, d)), hints)


@query(f"WITH {SUBMISSIONS} SELECT lead, id, ref, md5(substr(c.text, 1, 200)) AS quote_md5 FROM sf JOIN chunks c USING (company, ref) WHERE lead NOT IN (SELECT lead FROM violations)")
def submission_normalize(spark, d):
    ls, fs, rs, cs = submissions(spark, d)
    bad = quality.submission_violations(ls, fs, rs, cs).select("lead").distinct()
    return evidence.restore_evidence(fs.join(bad, "lead", "left_anti"), cs).where("found").select("lead", "id", "ref", F.md5(F.substring("quote", 1, 200)).alias("quote_md5"))


@query("""WITH o AS (SELECT o_custkey, arg_max(CASE WHEN o_totalprice > 250000 THEN o_orderpriority ELSE '' END, o_orderkey) AS segment, arg_max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE '' END, o_orderkey) AS name FROM orders GROUP BY o_custkey),
 p AS (SELECT o_custkey, nullif(segment, '') AS segment, nullif(name, '') AS name FROM o WHERE segment <> '' OR name <> '')
 SELECT c_custkey, coalesce(name, c_name) AS c_name, coalesce(segment, c_mktsegment) AS c_mktsegment, CASE WHEN o_custkey IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN o_custkey IS NULL THEN 'h' || c_nationkey END AS approved_hash FROM customer LEFT JOIN p ON o_custkey = c_custkey""")
def patch_merge(spark, d):
    """A customer's last order patches it: a large one its segment, a pending one its name."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(1).alias("version"), F.concat(F.lit("h"), "c_nationkey").alias("approved_hash"))
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_totalprice", "o_orderstatus", "o_orderpriority"), "o_orderkey").alias("o"))
    patch = last.select("c_custkey", F.when(F.col("o.o_orderstatus") == "P", F.col("o.o_orderpriority")).alias("c_name"), F.when(F.col("o.o_totalprice") > 250000, F.col("o.o_orderpriority")).alias("c_mktsegment")).where("c_name is not null or c_mktsegment is not null")
    return quality.merge_patch(c, patch, "c_custkey", ["c_name", "c_mktsegment"])


@query("""WITH t AS (SELECT l_orderkey, year(min(l_shipdate)) AS version, min(l_returnflag) AS state FROM lineitem GROUP BY 1)
 SELECT o_orderkey, unnest(list_filter([CASE WHEN l_orderkey IS NULL OR version <> year(o_orderdate) THEN 'version' END, CASE WHEN l_orderkey IS NULL OR state <> CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'P' THEN 'A' ELSE 'N' END THEN 'state' END], lambda x: x IS NOT NULL)) AS field FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""")
def plan_mismatch(spark, d):
    """The plan is the order (its year and state), the trace is what was shipped."""
    state = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "P", "A").otherwise("N")
    plan = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("version"), state.alias("state"))
    trace = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.year(F.min("l_shipdate")).alias("version"), F.min("l_returnflag").alias("state"))
    return quality.mismatches(plan, trace, "o_orderkey", ["version", "state"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'keep' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'redo' ELSE 'continue' END AS action FROM orders""")
def resume_plan(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "search").when(F.col("o_orderpriority") == "2-HIGH", "crawl").otherwise("analysis").alias("phase"))
    return R.resume_plan(own).select("o_orderkey", "action")
