"""Queries over texts, URLs, contacts and records, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses, contacts, records, text, urls
from ..operators import quality
from ..operators.pages import BOILERPLATE
from .views import DOCS, LOGS, MESSAGES, PAGE_HITS, docs, logs, messages, page_hits, table

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


NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(rf"SELECT doc_id, md5({NORM.format('text')}) AS normalized, len(list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents")
def text_normalize(spark, d):
    n = text.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(n).alias("normalized"), F.size(F.filter(F.split(n, " "), lambda x: x != "")).cast("long").alias("n_tokens"))


@query(r"""SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2)))::BIGINT AS n_words,
  md5(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2))), ' ')) AS words FROM documents""")
def token_set(spark, d):
    words = text.token_set(F.array("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(F.array_sort(words), " ")).alias("words"))


@query("""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
 k AS (SELECT doc_id, trim(term) AS term, pos, row_number() OVER (PARTITION BY doc_id, lower(trim(term)) ORDER BY pos) AS rn FROM t WHERE length(trim(term)) >= 2)
 SELECT doc_id, count(*) AS n_terms, md5(string_agg(term, ' ' ORDER BY pos)) AS terms FROM k WHERE rn = 1 GROUP BY doc_id""")
def dedupe_terms(spark, d):
    # A text is moved once, whole, and its terms not at all; rows that repeat an id are one document.
    own = table(spark, d, "documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    terms = F.flatten(F.transform("texts", lambda t: F.transform(F.split(t, " "), lambda x, i: F.struct(i.alias("pos"), x.alias("term")))))
    # explode() of one list, since a condition on a column goes down into the plan and makes it twice.
    kept = own.select("doc_id", F.explode(F.array(text.distinct_terms(terms))).alias("kept")).where(F.size("kept") > 0)
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_terms"), F.md5(F.array_join(F.transform("kept", lambda t: t["term"]), " ")).alias("terms"))


@query(r"""WITH t AS (SELECT p_partkey, trim(p_name || ' (' || p_type || '), ' || p_brand || '; x') AS s FROM part),
 a AS (SELECT p_partkey, list_concat(list_concat(
   CASE WHEN trim(regexp_extract(s, '\(([^)]+)\)', 1)) <> '' THEN [trim(regexp_extract(s, '\(([^)]+)\)', 1))] ELSE [] END,
   list_filter([trim(regexp_replace(x, '\([^)]*\)', '', 'g')) FOR x IN string_split_regex(s, '[,;]')], lambda p: length(p) BETWEEN 3 AND 80)),
   CASE WHEN length(s) BETWEEN 1 AND 80 THEN [s] ELSE [] END) AS ph FROM t)
 SELECT p_partkey, unnest(range(len(ph)))::BIGINT AS pos, unnest(ph) AS phrase FROM a""")
def phrase_extract(spark, d):
    s = F.concat("p_name", F.lit(" ("), "p_type", F.lit("), "), "p_brand", F.lit("; x"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(text.phrases(s)).alias("pos", "phrase")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "phrase")


LEXICON = ["the", "of the", "idiot", "worthless", "thereation", "und", "para de", "licensed under"]
_HITS = " + ".join(f"(contains(low, '{t}'))::INT" if " " in t or len(t) >= 8 else f"(contains(padded, ' {t} '))::INT" for t in LEXICON)


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS low FROM documents),
 p AS (SELECT doc_id, low, ' ' || regexp_replace(low, '[^\p{{L}}\p{{N}}]', ' ', 'g') || ' ' AS padded FROM t)
 SELECT doc_id, ({_HITS})::BIGINT AS hits FROM p""")
def term_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", text.term_hits(F.col("text"), LEXICON).cast("long").alias("hits"))


@query(f"WITH {MESSAGES} SELECT conv_id, turn, tokens FROM messages")
def token_estimate(spark, d):
    return messages(spark, d).select("conv_id", "turn", "tokens")


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS full_hash,
 substr(sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}'), 1, 24) AS short_hash FROM part""")
def stable_hash(spark, d):
    fields = (F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("none"), F.col("p_size").alias("size"))
    return table(spark, d, "part").select("p_partkey", text.stable_hash(*fields).alias("full_hash"), text.stable_hash(*fields, length=24).alias("short_hash"))


@query(f"""WITH {PAGE_HITS} SELECT page_id, sha256('{{"provider":"web","q":"' || domain || '","language":"en","gl":"ae","location":"Dubai","num":100}}') AS search_key,
 'crawl:' || sha256('{{"version":2,"domain":"' || domain || '","maxPages":20,"cleaning":true}}') AS crawl_key FROM page_hits""")
def cache_key(spark, d):
    search = [F.lit("web").alias("provider"), F.col("domain").alias("q"), F.lit("en").alias("language"), F.lit("ae").alias("gl"), F.lit("Dubai").alias("location"), F.lit(100).alias("num")]
    crawl = [F.lit(2).alias("version"), F.col("domain"), F.lit(20).alias("maxPages"), F.lit(True).alias("cleaning")]
    return page_hits(spark, d).select("page_id", text.stable_hash(*search).alias("search_key"), F.concat(F.lit("crawl:"), text.stable_hash(*crawl)).alias("crawl_key"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS base FROM pages),
 p AS (SELECT page_id, CASE WHEN contains(base, '?') THEN substr(base, 1, strpos(base, '?') - 1) ELSE base END AS path,
   array_to_string(list_filter(string_split(regexp_extract(base, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|fbclid[^=]*|gclid[^=]*|ref[^=]*)(=|$)')), '&') AS q FROM t)
 SELECT page_id, (CASE WHEN regexp_matches(path, '^[a-zA-Z]+://[^/]+/$') THEN path ELSE regexp_replace(path, '/+$', '') END) || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM p""")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


_PUBLIC = ", ".join(f"'{x}'" for x in urls.PUBLIC_SUFFIXES)


@query(rf"""WITH {PAGE_HITS} SELECT page_id, domain, CASE WHEN len(string_split(domain, '.')) <= 2 THEN domain WHEN array_to_string(string_split(domain, '.')[-2:], '.') IN ({_PUBLIC}) THEN array_to_string(string_split(domain, '.')[-3:], '.')
 ELSE array_to_string(string_split(domain, '.')[-2:], '.') END AS registrable FROM page_hits""")
def url_domain(spark, d):
    return page_hits(spark, d).select("page_id", "domain", urls.registrable(F.col("domain")).alias("registrable"))


IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
_RANGES = ", ".join("({}, {})".format(*addresses.range_bounds(r)) for r in addresses.PRIVATE_RANGES if ":" not in r)


@query(rf"""WITH i AS (SELECT doc_id, unnest(regexp_extract_all(text, '{IP}')) AS ip FROM documents),
 n AS (SELECT doc_id, ip, string_split(ip, '.')[1]::BIGINT * 16777216 + string_split(ip, '.')[2]::BIGINT * 65536 + string_split(ip, '.')[3]::BIGINT * 256 + string_split(ip, '.')[4]::BIGINT AS num FROM i),
 r(lo, hi) AS (VALUES {_RANGES})
 SELECT doc_id, ip, EXISTS (SELECT 1 FROM r WHERE num BETWEEN lo AND hi) AS private FROM n""")
def private_ip_filter(spark, d):
    from ..operators.pages import private_addresses

    found = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(IP), F.lit(0))).alias("ip"))
    return private_addresses(found, "ip")


_RANK = ", ".join(f"CASE WHEN regexp_matches(x, '(?i){p}') THEN {r} ELSE 50 END" for p, r in urls.LINK_RANKS)


@query(f"SELECT doc_id, (SELECT greatest({_RANK}) FROM (SELECT text || CASE doc_id % 4 WHEN 0 THEN ' contact' WHEN 1 THEN ' team' WHEN 2 THEN ' /products/' ELSE '' END AS x))::BIGINT AS priority FROM documents")
def link_priority(spark, d):
    tail = F.when(F.col("doc_id") % 4 == 0, " contact").when(F.col("doc_id") % 4 == 1, " team").when(F.col("doc_id") % 4 == 2, " /products/").otherwise("")
    return table(spark, d, "documents").select("doc_id", urls.link_rank(F.concat("text", tail)).cast("long").alias("priority"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|nav|noscript|svg|template)\b.*?</(script|style|nav|noscript|svg|template)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""")
def page_text_basic(spark, d):
    from ..operators.pages import basic_text

    return table(spark, d, "pages").select("page_id", basic_text(F.col("html")).alias("text"))


@query()
def page_text_full(spark, d):
    from ..operators.pages import main_texts

    return main_texts(table(spark, d, "pages"), "page_id").select("page_id", "title", "text")


_BOILER = "(?i)" + "|".join(BOILERPLATE)


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
 c AS (SELECT doc_id, pos, trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')) AS line FROM l),
 k AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) AS rn FROM c WHERE line <> '' AND NOT regexp_matches(line, '{_BOILER}'))
 SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM k WHERE rn = 1 OR length(line) < 20 GROUP BY doc_id""")
def line_clean(spark, d):
    from ..operators.pages import clean_lines

    kept = clean_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return kept.select("doc_id", "n_lines", F.md5("text").alias("text_md5"))


_EMAIL, _PHONE = contacts.EMAIL, contacts.PHONE


@query(rf"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\r]+', ' ', 'g')) AS line FROM documents)
 SELECT DISTINCT doc_id, substr(line, 1, 500) AS line FROM l WHERE regexp_matches(line, '{_EMAIL}') OR regexp_matches(line, '{_PHONE}')""")
def contact_lines(spark, d):
    from ..operators.pages import contact_lines as op

    return op(table(spark, d, "documents"), "doc_id")


@query(rf"WITH {PAGE_HITS} SELECT page_id, coalesce(nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), ''), domain) AS title FROM page_hits")
def page_title(spark, d):
    return page_hits(spark, d).select("page_id", F.coalesce(F.nullif(text.collapse(F.col("title")), F.lit("")), "domain").alias("title"))


_RANKX = ", ".join(f"CASE WHEN regexp_matches(hint, '(?i){p}') THEN {r} ELSE 50 END" for p, r in urls.LINK_RANKS)


@query(rf"""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href,
   unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS label FROM (SELECT page_id, url, replace(html, 'href="/t', 'href="/products/t') AS html FROM pages)),
 b AS (SELECT page_id, root || regexp_replace(href, '[^/]/+$', '') AS url, href, href || ' ' || trim(label) AS hint FROM a WHERE starts_with(href, '/'))
 SELECT page_id, url, max(greatest({_RANKX}))::BIGINT AS priority FROM b WHERE regexp_matches(hint, '{urls.PAGE_HINT}') AND NOT regexp_matches(href, '{urls.BINARY_PATH}') GROUP BY page_id, url""")
def related_links(spark, d):
    from ..operators.pages import related_links as op

    html = F.replace("html", F.lit('href="/t'), F.lit('href="/products/t'))
    return op(table(spark, d, "pages").select("page_id", "url", html.alias("html")), "page_id")


@query(rf"""WITH e AS (SELECT source AS domain, doc_id, 'email' AS type, lower(unnest(regexp_extract_all(text, '{_EMAIL}'))) AS value, text FROM documents),
 p AS (SELECT source AS domain, doc_id, 'phone' AS type, trim(unnest(regexp_extract_all(text, '{_PHONE}'))) AS value, text FROM documents),
 w AS (SELECT domain, doc_id, CASE WHEN type = 'phone' AND contains(lower(substr(text, greatest(1, strpos(text, value) - 80), least(80, strpos(text, value) - 1) + length(value) + 80)), 'whatsapp') THEN 'whatsapp' ELSE type END AS type, value FROM (FROM e UNION ALL FROM p))
 SELECT domain, type, value, max(doc_id) AS last_page, min(doc_id) AS first_page FROM w GROUP BY domain, type, value""")
def contact_extract(spark, d):
    from ..operators.pages import extract_contacts

    pages = table(spark, d, "documents").select(F.col("source").alias("domain"), F.col("doc_id").alias("page"), "text")
    return extract_contacts(pages)


CONTACTS = rf"""contacts AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_EMAIL}'))) AS value, source FROM documents)"""


def email_contacts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(contacts.EMAIL), F.lit(0))).alias("value"), "source").withColumn("value", F.lower("value"))


_ROLE = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{pattern}') THEN '{name}'" for name, pattern in contacts.ROLES) + " ELSE 'unknown' END"


@query(f"WITH t AS (SELECT doc_id, lower(CASE doc_id % 5 WHEN 0 THEN 'sales@' WHEN 1 THEN 'help@' WHEN 2 THEN 'info@' ELSE 'a@' END || source || ' ' || text) AS v FROM documents) SELECT doc_id, {_ROLE.format('v')} AS role FROM t")
def contact_role(spark, d):
    value = F.concat(F.when(F.col("doc_id") % 5 == 0, "sales@").when(F.col("doc_id") % 5 == 1, "help@").when(F.col("doc_id") % 5 == 2, "info@").otherwise("a@"), "source")
    return table(spark, d, "documents").select("doc_id", contacts.role(value, F.col("text")).alias("role"))


@query(rf"""WITH t AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' trading co' ELSE '' END AS v FROM part)
 SELECT p_partkey, length(v) <= 80 AND len(string_split({NORM.format('v')}, ' ')) <= 8 AND NOT regexp_matches(v, '[\n\r.!?]') AND length({NORM.format('v')}) >= 3
 AND len(list_filter(string_split({NORM.format('v')}, ' '), lambda x: x NOT IN ('co', 'trading', 'small', 'red', 'ring', 'widget') AND length(x) >= 4)) > 0 AS distinctive FROM t""")
def brand_distinct(spark, d):
    from ..operators.rounds import is_distinctive_brand

    v = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " trading co").otherwise(""))
    return table(spark, d, "part").select("p_partkey", is_distinctive_brand(v, ["small red", "ring widget"]).alias("distinctive"))


@query(rf"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'g' || c_custkey ELSE coalesce(nullif({NORM.format("''")}, ''), 'unknown') || '::' || coalesce(nullif({NORM.format('c_mktsegment')}, ''), 'legacy') || '::legacy-' || (c_custkey // 3) END AS group_id FROM customer""")
def query_group_id(spark, d):
    from ..operators.rounds import query_group

    given = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" g"), F.col("c_custkey"), F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", query_group(given, F.lit(""), F.col("c_mktsegment"), F.col("c_custkey")).alias("group_id"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\b(?:sk|pk|key|token)[-_][A-Za-z0-9._-]{10,}\b', '[REDACTED_TOKEN]', 'g'), '(?i)\b([A-Z0-9._%+-])[^@\s]*@([A-Z0-9.-]+\.[A-Z]{2,})\b', '\1***@\2', 'g')) AS redacted FROM documents""")
def redact_email_token(spark, d):
    own = table(spark, d, "documents")
    return own.select("doc_id", F.md5(records.redact_words(F.col("text"))).alias("redacted"))


@query()
def redact_phone(spark, d):
    return table(spark, d, "documents").select("doc_id", records.redact(F.col("text")).alias("redacted"))


@query("""SELECT event_id, '[REDACTED]' AS api_key, event_type AS event, CASE WHEN event_id % 2 = 0 THEN '[REDACTED]' END AS password FROM events""")
def redact_map(spark, d):
    m = F.create_map(F.lit("api_key"), F.lit("k"), F.lit("event"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "password").otherwise("note"), F.lit("x"))
    out = records.redact_map(m)
    return table(spark, d, "events").select("event_id", out["api_key"].alias("api_key"), out["event"].alias("event"), F.try_element_at(out, F.lit("password")).alias("password"))


@query("""SELECT c_custkey, CASE WHEN regexp_matches(v, '^[=+\\-@]') THEN '''' || v ELSE v END AS cell FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END || c_name AS v FROM customer)""")
def csv_safe(spark, d):
    mark = F.element_at(F.array(*[F.lit(x) for x in "=+-@"], F.lit("")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", text.csv_safe(F.concat(mark, "c_name")).alias("cell"))


_MESSAGE = "CASE event_id % 6 WHEN 0 THEN 'HTTP 503 from host' WHEN 1 THEN 'request timed out' WHEN 2 THEN 'run terminated' WHEN 3 THEN 'bad schema' WHEN 4 THEN 'fetch failed' ELSE event_type END"


def _message():
    parts = ["HTTP 503 from host", "request timed out", "run terminated", "bad schema", "fetch failed"]
    return F.coalesce(F.get(F.array(*map(F.lit, parts)), (F.col("event_id") % 6).cast("int")), F.col("event_type"))


_TRANSIENT = records.TRANSIENT


@query(f"SELECT event_id, regexp_matches({_MESSAGE}, '{_TRANSIENT}') AS transient FROM events")
def error_transient(spark, d):
    return table(spark, d, "events").select("event_id", records.is_transient(_message()).alias("transient"))


@query(f"""SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'validation' WHEN user_id % 7 = 0 THEN 'timeout' WHEN value > 200 THEN 'budget_exhausted'
 WHEN regexp_matches({_MESSAGE}, '(?i)terminated') THEN 'terminated' WHEN regexp_matches({_MESSAGE}, '{_TRANSIENT}') THEN 'transient' ELSE 'unknown' END AS kind FROM events""")
def failure_kind(spark, d):
    name = F.when(F.col("user_id") % 11 == 0, "CompanyAnalysisValidationError").when(F.col("user_id") % 7 == 0, "OperationTimeoutError")
    return table(spark, d, "events").select("event_id", records.failure_kind(name, F.when(F.col("value") > 200, "budget_exhausted"), _message()).alias("kind"))


@query(f"""WITH {LOGS}, r AS (SELECT event_id, status, CASE WHEN event = 'view' THEN 'GET' ELSE 'POST' END AS m, CASE event_id % 4 WHEN 0 THEN '/api/health' WHEN 1 THEN '/api/leads' WHEN 2 THEN '/static/app.js' ELSE '/api/orchestrator/sessions/s1/activity' END AS p FROM logs)
 SELECT event_id, starts_with(p, '/api/') AND (status >= 400 OR NOT (m = 'GET' AND (p = '/api/health' OR regexp_matches(p, '^/api/orchestrator/sessions/[^/]+/activity$')))) AS kept FROM r""")
def access_log_filter(spark, d):
    paths = F.array(*map(F.lit, ["/api/health", "/api/leads", "/static/app.js", "/api/orchestrator/sessions/s1/activity"]))
    method = F.when(F.col("event") == "view", "GET").otherwise("POST")
    return logs(spark, d).select("event_id", records.keeps_access(method, F.get(paths, (F.col("event_id") % 4).cast("int")), F.lit(None).cast("string"), F.col("status")).alias("kept"))


@query(f"""WITH {DOCS}, q AS (SELECT company, doc_id AS quote_id, substr(text, 41, 60) AS quote FROM docs WHERE length(text) >= 120)
 SELECT quote_id, d.doc_id AS page, (strpos(d.text, quote) - 1)::BIGINT AS at FROM q JOIN docs d ON d.company = q.company AND contains(d.text, quote)""")
def quote_locate(spark, d):
    from ..operators.evidence import locate_quotes

    own = docs(spark, d)
    quotes = own.where(F.length("text") >= 120).select("company", F.col("doc_id").alias("quote_id"), F.substring("text", 41, 60).alias("quote"))
    return locate_quotes(quotes, own.select("company", F.col("doc_id").alias("page"), "text"), "company")


def _folded(c: str) -> str:
    return rf"""trim(regexp_replace(replace(translate({c}, '‘’“”–—', '''''""--'), '…', '...'), '\s+', ' ', 'g'))"""


@query(rf"""WITH {DOCS}, r AS (SELECT company, doc_id, replace(replace(replace(substr(text, 41, 60), ' ', '  '), '-', '—'), '''', '’') AS quote FROM docs WHERE length(text) >= 120),
 q AS (SELECT company, quote, min(doc_id) AS quote_id, count(*) AS quotes, {_folded("quote")} AS needle FROM r GROUP BY company, quote),
 p AS (SELECT company, text, min(doc_id) AS page, count(*) AS pages, {_folded("text")} AS folded FROM docs GROUP BY company, text),
 m AS (SELECT *, contains(text, quote) AS exact,
  replace(replace(replace(replace(regexp_replace(needle, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g'), ' ', '\s+'), '-', '[-–—]'), '''', '[''‘’]'), '"', '["“”]') AS pattern FROM q JOIN p USING (company) WHERE needle <> '' AND contains(folded, needle)),
 f AS (SELECT *, CASE WHEN exact THEN quote ELSE regexp_extract(text, pattern) END AS found FROM m WHERE exact OR length(needle) >= 12)
 SELECT company, quote_id, page, quotes, pages, found, (strpos(text, found) - 1)::BIGINT AS "at", exact FROM f""")
def quote_locate_fuzzy(spark, d):
    from ..operators.evidence import locate_quotes_loosely

    own = table(spark, d, "documents").withColumnRenamed("source", "company")
    quote = F.substring("text", 41, 60)
    for plain, other in ((" ", "  "), ("-", "—"), ("'", "’")):
        quote = F.replace(quote, F.lit(plain), F.lit(other))
    quotes = own.where(F.length("text") >= 120).select("company", F.col("doc_id").alias("quote_id"), quote.alias("quote"))
    return locate_quotes_loosely(quotes, own.select("company", F.col("doc_id").alias("page"), "text"), "company")


@query()
def chunk_pages(spark, d):
    from ..operators.evidence import chunk_pages as op

    return op(docs(spark, d).select("company", "page_index", "text"))


@query(f"""WITH {DOCS}, c AS (SELECT company, page_index, text, unnest(range(0, greatest(length(text), 1), 840)) AS pos FROM docs)
 SELECT 'p' || page_index || '-s' || (pos // 840) AS ref, company, page_index, pos::BIGINT AS "at", md5(substr(text, pos + 1, 960)) AS chunk_md5 FROM c""")
def chunk_fixed(spark, d):
    from ..operators.evidence import chunk_fixed as op

    return op(docs(spark, d).select("company", "page_index", "text"), 960, 120).select("ref", "company", "page_index", "at", F.md5("chunk").alias("chunk_md5"))


_PLAN = ", ".join(map(str, quality.NUMBERING))
_PREFIXES = ", ".join(map(str, quality.number_prefixes().items()))
_LANDS = {"en": "US", "de": "DE", "fr": "FR", "es": "ES"}


@query(rf"""WITH p AS (SELECT doc_id, lang, trim(unnest(regexp_extract_all(text, '{_PHONE}'))) AS value FROM documents),
 n AS (SELECT row_number() OVER () AS r, doc_id, value, CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LANDS.items())} END AS iso, regexp_matches(value, '^(\+|00)') AS abroad, regexp_replace(value, '\D', '', 'g') AS d FROM p),
 m(iso, code, trunk, lo, hi) AS (VALUES {_PLAN}), x(prefix, iso) AS (VALUES {_PREFIXES}),
 k AS (SELECT r, arg_max(x.iso, length(prefix)) AS land FROM n JOIN x ON abroad AND starts_with(regexp_replace(d, '^00', ''), prefix) GROUP BY r),
 c AS (SELECT n.*, CASE WHEN abroad THEN land ELSE iso END AS country FROM n LEFT JOIN k USING (r)),
 s AS (SELECT c.*, code, lo, hi, CASE WHEN abroad THEN substr(regexp_replace(d, '^00', ''), length(code) + 1) WHEN trunk <> '' AND starts_with(d, trunk) THEN substr(d, length(trunk) + 1) ELSE d END AS own FROM c LEFT JOIN m ON m.iso = c.country),
 v AS (SELECT *, CASE WHEN abroad AND country IS NULL THEN false ELSE length(own) BETWEEN lo AND hi END AS valid FROM s)
 SELECT doc_id, value, iso, country, valid, CASE WHEN valid THEN '+' || code || own END AS e164, coalesce(valid AND country = iso, false) AS in_country FROM v""")
def phone_validate(spark, d):
    lands = F.create_map(*[F.lit(x) for pair in _LANDS.items() for x in pair])
    found = table(spark, d, "documents").select("doc_id", F.try_element_at(lands, F.col("lang")).alias("iso"), F.explode(F.regexp_extract_all("text", F.lit(contacts.PHONE), F.lit(0))).alias("value"))
    return quality.validate_phones(found.withColumn("value", F.trim("value")))


@query(r"""WITH t AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
 SELECT doc_id, coalesce(list_filter(s, lambda x: contains(lower(x), 'idiot'))[1], substr(text, 1, 260)) AS sentence FROM t""")
def sentence_pick(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sentence_with(F.col("text"), "idiot").alias("sentence"))


@query(rf"""WITH {PAGE_HITS}, t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'About ' || title WHEN 1 THEN title || ' | Home' ELSE 'Home' END AS title, title || ' supplies goods' AS text FROM page_hits),
 c AS (SELECT page_id, title, text, trim(regexp_replace(regexp_replace(title, '(?i)^(about|company profile|welcome to)\s+', ''), '\s+[|–-].*$', '')) AS clean,
   trim(regexp_extract(text, '(?i)^(.{{2,80}}?)(?:\s+is\b|\s+supplies\b|\s+distributes\b)', 1)) AS opening FROM t)
 SELECT page_id, CASE WHEN (clean = '' OR regexp_matches(trim(title), '(?i)^(company profile|home|about us)$')) AND opening <> '' THEN opening ELSE clean END AS name FROM c""")
def canonical_name(spark, d):
    own = page_hits(spark, d)
    title = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("About "), "title")).when(F.col("page_id") % 3 == 1, F.concat("title", F.lit(" | Home"))).otherwise("Home")
    own = own.select("page_id", title.alias("title"), F.concat("title", F.lit(" supplies goods")).alias("text"), "domain")
    return own.select("page_id", text.canonical_name(F.col("title"), F.col("text"), F.col("domain")).alias("name"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, (epoch_ms(o_orderdate + INTERVAL 7 DAY) - epoch_ms(o_orderdate))::BIGINT AS ttl_ms, date_diff('millisecond', o_orderdate, TIMESTAMP '2000-01-01') AS age_ms FROM orders")
def duration_ms(spark, d):
    start = F.col("o_orderdate").cast("timestamp")
    ms = F.unix_millis
    return table(spark, d, "orders").select("o_orderkey", F.date_format(start, "yyyy-MM-dd").alias("day"), (ms(start + F.expr("INTERVAL 7 DAYS")) - ms(start)).alias("ttl_ms"), (ms(F.lit("2000-01-01").cast("timestamp")) - ms(start)).alias("age_ms"))


@query("""SELECT p_partkey, '{"name":"' || p_name || '","keywords":["' || p_brand || '"]}' AS search, '{"name":"' || p_name || '","size":' || p_size || '}' AS company FROM part WHERE p_size % 2 = 1""")
def policy_projection(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 1, "approved").otherwise("draft").alias("status"), F.struct(F.col("p_name").alias("name"), F.array("p_brand").alias("keywords"), F.col("p_size").alias("size")).alias("policy"))
    from ..operators.tables import project_policy

    views = {"search": ["name", "keywords"], "company": ["name", "size"]}
    return project_policy(own, views).select("p_partkey", "search", "company")


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct(['seg-' || c_mktsegment, 'n' || c_nationkey, 'n' || (c_custkey % 25)])), ',') AS tags FROM customer")
def array_union_distinct(spark, d):
    tags = F.array_distinct(F.concat(F.array(F.concat(F.lit("seg-"), "c_mktsegment"), F.concat(F.lit("n"), "c_nationkey")), F.array(F.concat(F.lit("n"), (F.col("c_custkey") % 25).cast("string")))))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query(f"""WITH e AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_EMAIL}'))) AS value, lower(text) AS low FROM documents), n AS (SELECT doc_id, value, split_part(value, '@', 1) AS loc, substr(low, greatest(1, strpos(low, value) - 40), least(40, strpos(low, value) - 1) + length(value) + 40) AS near FROM e),
 l AS (SELECT *, CASE WHEN regexp_matches(loc || ' ' || near, 'sales|trade|commercial|export') THEN 'sales' WHEN regexp_matches(loc, 'help|support|service') THEN 'support' ELSE 'public' END AS label FROM n)
 SELECT doc_id, value, label, CASE label WHEN 'sales' THEN 0.96 WHEN 'support' THEN 0.58 ELSE 0.82 END::DOUBLE AS confidence FROM l""")
def contact_label(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"), F.explode(F.regexp_extract_all("text", F.lit(contacts.EMAIL), F.lit(0))).alias("value")).withColumn("value", F.lower("value"))
    at = F.instr("low", F.col("value"))
    near = F.substr("low", F.greatest(F.lit(1), at - 40), F.least(F.lit(40), at - 1) + F.length("value") + 40)
    return rows.select("doc_id", "value", contacts.public_label(F.col("value"), near).alias("c")).select("doc_id", "value", "c.label", "c.confidence")


@query(f"WITH {DOCS} SELECT doc_id, 'ev-' || row_number() OVER (PARTITION BY company ORDER BY page_index) AS evidence_id, 'c' || page_index AS contact_ref FROM docs")
def position_refs(spark, d):
    from ..operators.tables import number_rows

    rows = number_rows(docs(spark, d).select("doc_id", "company", "page_index"), ["company"], F.floor(F.col("page_index") / 1024), ["page_index"], "place")
    return rows.select("doc_id", F.concat(F.lit("ev-"), "place").alias("evidence_id"), F.concat(F.lit("c"), "page_index").alias("contact_ref"))
