"""Links of HTML pages: anchors as a tokenizer of tags sees them, and references resolved against a base, in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import let

#: What holds no tags: comments, scripts and styles.
UNSEEN = r"(?is)<!--.*?(?:-->|$)|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|$)"
#: The attributes of a tag, quoted ones with anything in them.
ATTRIBUTES = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)"""
ANCHOR = rf"(?is)<a(?=[\s/]){ATTRIBUTES}>(.*?)(?=</a\s*>|<a[\s/>]|$)"
BASE = rf"(?is)<base(?=[\s/]){ATTRIBUTES}>"
HREF = r"""(?is)^(?:\s|/|[^\s=>"'/]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)|(?!href\s*=)[^\s=>"'/]+)*?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
# The character references that links and labels use.
REFERENCES = (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def site_of(url: Column) -> Column:
    """Lower-case host of an address without www., user and port; empty where it has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def decoded(text: Column) -> Column:
    """Text with its common character references taken back, ampersands last."""
    out = text
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def attribute_href(attributes: Column) -> Column:
    """The value of the first href of a tag, without quotes and outer white space; null where it has none."""
    bare = lambda x: F.when(x.rlike("^[\"']"), F.substr(x, F.lit(2), F.length(x) - 2)).when(x != "", x)
    return let(F.regexp_replace(F.regexp_replace(let(F.regexp_extract(attributes, HREF, 1), bare), r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), decoded)


def anchors(html: Column) -> Column:
    """array<struct<href, label>>: the anchors of a page in order; labels lose nested tags, and white space is collapsed."""
    zipped = lambda seen: F.arrays_zip(F.regexp_extract_all(seen, F.lit(ANCHOR), F.lit(1)).alias("attributes"), F.regexp_extract_all(seen, F.lit(ANCHOR), F.lit(2)).alias("inner"))
    pairs = let(F.regexp_replace(html, UNSEEN, ""), zipped)
    label = lambda x: F.trim(F.regexp_replace(let(F.regexp_replace(x, r"""(?s)<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", ""), decoded), r"[\s\x{00A0}]+", " "))
    named = F.transform(pairs, lambda p: F.struct(attribute_href(p["attributes"]).alias("href"), label(p["inner"]).alias("label")))
    return F.filter(named, lambda a: a["href"].isNotNull())


def base_of(html: Column, url: Column) -> Column:
    """What a page's references are relative to: its base element's href, itself resolved, or its own address."""
    first = attribute_href(F.regexp_extract(F.regexp_replace(html, UNSEEN, ""), BASE, 1))
    return F.coalesce(resolve(url, first), url)


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    empty = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x.rlike(r"(?i)^(\.|%2e)$"), done).when(x.rlike(r"(?i)^(\.|%2e){2}$"), up).otherwise(F.concat(done, F.array(x)))

    def folded(p: Column) -> Column:
        kept = F.array_join(F.aggregate(F.slice(F.split(p, "/", -1), F.lit(2), F.length(p) + 1), empty, step), "/")
        # A dot at the end leaves the slash before it.
        closed = lambda k: F.concat(F.lit("/"), k, F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}$") & (k != ""), "/").otherwise(""))
        return F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), let(kept, closed)).otherwise(p)

    return let(path, folded)


def resolve(base: Column, reference: Column) -> Column:
    """The address that a reference has on a page at `base`, by the rules of RFC 3986 (http and https); null for other schemes and bases.

    Backslashes count as slashes, as browsers have it. The fragment stays.
    """
    ref = F.regexp_replace(reference, r"\\", "/")
    at = F.struct(
        F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1).alias("root"),
        F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
        F.lower(F.regexp_extract(ref, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)).alias("scheme"),
        F.regexp_extract(ref, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]+)", 1).alias("outside"),
        F.regexp_extract(ref, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]+)?([^?#]*)", 1).alias("local"),
        F.regexp_extract(ref, r"([?#].*)$", 1).alias("tail"),
    )

    def joined(x: Column) -> Column:
        own = F.when(x["path"] == "", "/").otherwise(x["path"])
        scheme = F.when(x["scheme"] != "", x["scheme"]).otherwise(F.lower(F.regexp_extract(x["root"], "^([^:]*)", 1)))
        plain = x["local"] == ""
        root = F.when(x["outside"] != "", F.concat(scheme, F.lit(":"), x["outside"])).otherwise(x["root"])
        path = F.when(x["outside"] != "", F.when(plain, "/").otherwise(x["local"])).when(plain, own).when(F.startswith(x["local"], F.lit("/")), x["local"]).otherwise(F.concat(F.regexp_replace(own, r"[^/]*$", ""), x["local"]))
        query = F.when((x["outside"] == "") & plain & ~F.startswith(x["tail"], F.lit("?")), x["query"]).otherwise("")
        known = x["root"].rlike("(?i)^https?://") & ((x["scheme"] == "") | (x["scheme"].isin("http", "https") & (x["outside"] != ""))) & ~(F.startswith(x["local"], F.lit("//")) & (x["outside"] == ""))
        return F.when(known, F.concat(root, without_dots(path), query, x["tail"]))

    return F.when(reference.isNotNull(), let(at, joined))
