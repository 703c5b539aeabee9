"""Text semantics, fixed once: white space, case folding, terms, hashes, and sizes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the product defines it: ASCII white space plus the Unicode spaces.
WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Characters that compatibility normalization may change.
_FOLDED = r"[\x{00A0}\x{00A8}\x{00AA}\x{00AF}\x{00B2}-\x{00B5}\x{00B8}-\x{00BA}\x{00BC}-\x{00BE}\x{0132}\x{0133}\x{013F}\x{0140}\x{0149}\x{017F}\x{01C4}-\x{01CC}\x{01F1}-\x{01F3}\x{0250}-\x{10FFFF}]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility normalization; only texts that it can change leave the JVM."""
    return F.coalesce(_nfkc(F.when(c.rlike(_FOLDED), c)), c)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def normalize(c: Column, compatible: bool = True) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(nfkc(c) if compatible else c), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column, compatible: bool = True) -> Column:
    """Words of the normalized text."""
    return F.filter(F.split(normalize(c, compatible), " "), lambda x: x != "")


def token_set(values: Column) -> Column:
    """Distinct lower-case words of at least two characters of an array of texts."""
    words = F.flatten(F.transform(values, lambda v: F.split(F.lower(v), r"[^\p{L}\p{N}]+")))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def phrases(c: Column) -> Column:
    """Phrases worth matching: the first parenthesis, parts between commas of 3 to 80 characters, a short whole."""
    text = F.trim(c)
    inner = F.trim(F.regexp_extract(text, r"\(([^)]+)\)", 1))
    parts = F.transform(F.split(text, "[,;]"), lambda p: F.trim(F.regexp_replace(p, r"\([^)]*\)", "")))
    parts = F.filter(parts, lambda p: (F.length(p) >= 3) & (F.length(p) <= 80))
    whole = F.when((F.length(text) > 0) & (F.length(text) <= 80), F.array(text)).otherwise(F.array().cast("array<string>"))
    first = F.when(inner != "", F.array(inner)).otherwise(F.array().cast("array<string>"))
    return F.concat(first, parts, whole)


def contains_term(text: Column, term: str) -> Column:
    """Whether a term stands in a text: ASCII terms at letter and digit boundaries, others as they are; case is ignored."""
    if not term.strip():
        return F.lit(False)
    if not term.isascii():
        return F.contains(F.lower(text), F.lit(term.lower()))
    quoted = "".join("\\" + ch if ch in r".*+?^${}()|[]\\" else ch for ch in term)
    return text.rlike(f"(?i)(?:^|[^A-Za-z0-9]){quoted}(?=$|[^A-Za-z0-9])")


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text holds; terms with a space or of 8 or more characters match anywhere, shorter ones as words."""
    low = collapse(F.lower(text))
    padded = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]", " "), F.lit(" "))
    total = F.lit(0)
    for term in terms:
        t = " ".join(term.lower().split())
        whole = F.contains(low, F.lit(t)) if " " in t or len(t) >= 8 else F.contains(padded, F.lit(f" {t} "))
        total = total + whole.cast("int")
    return total


def token_estimate(c: Column) -> Column:
    """Model tokens of a text, estimated from its ASCII and other characters."""
    ascii_chars = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return F.ceil(ascii_chars / F.lit(3.5) + (F.length(c) - ascii_chars) / F.lit(1.5)).cast("long")


def stable_hash(*fields: Column, length: int = 64) -> Column:
    """Hash of a struct's JSON with fields in the given (sorted) order; null fields are left out."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}), 256), 1, length)


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet does not read as a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def sentence_with(text: Column, term: str) -> Column:
    """The first sentence that holds the term, or else the first 260 characters."""
    found = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), F.lit(term.lower())))
    return F.coalesce(F.get(found, F.lit(0)), F.substring(text, 1, 260))


def canonical_name(title: Column, text: Column, domain: Column) -> Column:
    """A company's name from its page title, or from its opening sentence when the title is generic."""
    title = F.coalesce(title, domain)
    clean = F.regexp_replace(F.regexp_replace(title, r"(?i)^(about|company profile|welcome to)\s+", ""), r"\s+[|–-].*$", "")
    clean = F.trim(clean)
    opening = F.trim(F.regexp_extract(text, r"(?i)^(.{2,80}?)(?:\s+is\b|\s+supplies\b|\s+distributes\b)", 1))
    generic = (clean == "") | F.trim(title).rlike(r"(?i)^(company profile|home|about us)$")
    return F.when(generic & (opening != ""), opening).otherwise(clean)


def distinct_terms(terms: Column) -> Column:
    """array<struct<pos, term>> of an array<struct<pos, term>>: trimmed terms of 2 or more characters, the first spelling of each kept, in their order."""
    own = F.filter(F.transform(terms, lambda t: F.struct(F.lower(F.trim(t["term"])).alias("low"), t["pos"].alias("pos"), F.trim(t["term"]).alias("term"))), lambda t: F.length(t["term"]) >= 2)
    bound = lambda c, use: F.get(F.transform(F.array(c), use), F.lit(0))  # noqa: E731  c is made once
    first = lambda s: F.filter(s, lambda t, i: (i == 0) | (F.get(s, i - 1)["low"] != t["low"]))
    kept = bound(F.sort_array(own), first)
    return F.sort_array(F.transform(kept, lambda t: F.struct(t["pos"].alias("pos"), t["term"].alias("term"))))
