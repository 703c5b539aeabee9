"""URL parts, canonical form, domains and link ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import addresses

#: Query parameters that only track visitors.
TRACKING = r"(?i)^(utm_[^=]*|fbclid[^=]*|gclid[^=]*|ref[^=]*)(=|$)"
# What a link's label says about its page, best first.
LINK_RANKS = (
    (r"contact|location|branch", 100),
    (r"about|company|profile|who-we-are|history", 95),
    (r"product|catalog(?:ue)?|brand", 90),
    (r"industr(?:y|ies)|market|solution|what-we-do", 80),
    (r"capabilit|service|distribution|export|import", 75),
    (r"team|management", 60),
)
# Words of a link that leads to a telling page.
PAGE_HINT = r"(?i)about|company|profile|history|product|catalog(?:ue)?|contact|who-we-are|what-we-do|solution|service|industr(?:y|ies)|capabilit|market|brand|location|branch|team|distribution|export|import"
# Endings of files that are no pages.
BINARY_ENDINGS = ("7z", "avi", "css", "doc", "docx", "gif", "gz", "ico", "jpeg", "jpg", "js", "mp3", "mp4", "pdf", "png", "ppt", "pptx", "rar", "svg", "tar", "webp", "xls", "xlsx", "zip")
BINARY_PATH = rf"(?i)\.({'|'.join(BINARY_ENDINGS)})$"


def host(url: Column) -> Column:
    """Lower-case host without www., or null where the URL has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


# Public suffixes of more than one label.
PUBLIC_SUFFIXES = (
    "ac.ae", "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.ae", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.bd", "com.bh", "com.br", "com.cn", "com.co", "com.cy", "com.eg", "com.es", "com.gr", "com.hk", "com.jo", "com.kw", "com.lb",
    "com.mx", "com.my", "com.ng", "com.om", "com.pe", "com.ph", "com.pk", "com.pl", "com.pt", "com.qa", "com.ro", "com.sa", "com.sg", "com.tr", "com.tw",
    "com.ua", "com.vn", "edu.au", "edu.sa", "gov.ae", "gov.au", "gov.in", "gov.sa", "gov.uk", "ltd.uk", "me.uk", "med.sa", "ne.jp", "net.ae", "net.au",
    "net.cn", "net.in", "net.pl", "net.sa", "or.jp", "or.kr", "org.ae", "org.au", "org.br", "org.cn", "org.in", "org.pl", "org.sa", "org.uk", "plc.uk",
    "pub.sa", "sch.ae", "sch.sa", "web.id",
)


# Suffixes of which any label below is public too, labels that are not for all that, and suffixes of three labels.
SUFFIX_RULES = (*PUBLIC_SUFFIXES, "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp", "k12.ca.us", "lib.ca.us", "pvt.k12.ma.us")


def registrable(domain: Column, rules: tuple[str, ...] = SUFFIX_RULES) -> Column:
    """A host's public suffix and the label before it; a host that is itself a suffix stays.

    Of the rules that fit (plain, *. for any label, ! for exceptions) an exception wins,
    else the longest; without one the last label is the suffix.
    """
    plain, wild, exempt = [r for r in rules if r[0] not in "*!"], [r[2:] for r in rules if r[0] == "*"], [r[1:] for r in rules if r[0] == "!"]
    longest = max([r.count(".") + 1 for r in rules], default=1)

    def cut(parts: Column) -> Column:
        last = lambda n: F.array_join(F.slice(parts, -F.least(F.lit(n), F.size(parts)), F.least(F.lit(n), F.size(parts))), ".")
        length = F.lit(1)
        for k in range(2, longest + 1):
            length = F.when((F.size(parts) >= k) & (last(k).isin(*plain, "") | last(k - 1).isin(*wild, "")), k).otherwise(length)
        for k in range(2, longest + 1):
            length = F.when((F.size(parts) >= k) & last(k).isin(*exempt, ""), k - 1).otherwise(length)
        return addresses.let(F.least(length + 1, F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))

    return addresses.let(F.split(domain, r"\."), cut)


def registrable_by(hosts: DataFrame, rules: DataFrame, host: str) -> DataFrame:
    """(host, site) of the distinct hosts, by rules(rule) of any number: an equi-join of all suffixes with the rules; the result is that of registrable()."""
    mark = F.substring("rule", 1, 1)
    own = rules.select(F.when(mark == "!", "!").when(mark == "*", "*").otherwise("").alias("kind"), F.regexp_replace("rule", r"^(\*\.|!)", "").alias("key")).where("key <> ''").distinct()
    once = hosts.select(F.col(host).alias("host")).where("host is not null").distinct()
    ends = once.select("host", F.posexplode(F.reverse(suffixes(F.col("host")))).alias("k", "key"))
    met = ends.hint("merge").join(own, "key").groupBy("host").agg(F.max(F.when(F.col("kind") == "!", F.col("k"))).alias("exempt"), F.max(F.when(F.col("kind") == "*", F.col("k") + 2).when(F.col("kind") == "", F.col("k") + 1)).alias("length"))
    parts = F.split("host", r"\.")
    size = F.least(F.coalesce("exempt", "length", F.lit(1)) + 1, F.size(parts))
    return once.join(met.hint("merge"), "host", "left").select("host", F.array_join(F.slice(parts, -size, size), ".").alias("site"))


def suffixes(domain: Column) -> Column:
    """A host and all its parent domains, so that a suffix test becomes an equi-join."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def canonical(url: Column) -> Column:
    """Without tracking parameters, fragment and trailing slash."""
    base = F.regexp_replace(url, "#.*$", "")
    path, query = F.substring_index(base, "?", 1), F.regexp_extract(base, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    root = path.rlike(r"^[a-zA-Z]+://[^/]+/$")
    path = F.when(root, path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.concat(path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def link_rank(label: Column) -> Column:
    """The best rank that the label gives; 50 where it gives none."""
    return F.greatest(*[F.when(label.rlike(f"(?i){p}"), F.lit(rank)).otherwise(F.lit(50)) for p, rank in LINK_RANKS])


def unsafe_reason(url: Column) -> Column:
    """Why a URL must not be fetched: scheme, userinfo, host or address; null where nothing is against it.

    Addresses count in every spelling that a URL parser takes: numbers of one to four
    parts in any base, shortened and mapped IPv6. Names are not resolved.
    """
    reason = lambda h: F.when(~h["scheme"].isin("http", "https"), "scheme").when(h["userinfo"], "userinfo").when(~h["valid"], "host").when(addresses.in_ranges(h["address"]), "address")
    return addresses.let(addresses.host_of(F.coalesce(url, F.lit(""))), reason)


def exclude_domain(domain: Column) -> Column:
    """The search operator that leaves a domain out."""
    return F.concat(F.lit("-site:"), domain)


def exclude_brand(brand: Column) -> Column:
    """The search operator that leaves a phrase out, quotes and backslashes blanked; null where nothing is left of it."""
    value = F.trim(F.regexp_replace(F.regexp_replace(brand, r'["\\\\]', " "), r"\s+", " "))
    return F.when(value != "", F.concat(F.lit('-"'), value, F.lit('"')))
