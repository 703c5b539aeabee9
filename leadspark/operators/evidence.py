"""Evidence: quotes, chunks, terms, ranking, neighbours, facts and restoration."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grams
from ..sources.sinks import new_folder, stored
from .matching import ANYWHERE, WORD, match_terms
from .tables import number_rows

CHUNK, LEAST_CUT, OVERLAP = 960, 480, 120
#: Characters of pages whose chunks a task holds at a time (a longer page goes alone).
CUT_CHARS = 1 << 20
# What ends a sentence or a line.
MARKS = "\n.!?。！？"
# How many chunks each slot of a company's evidence holds.
SLOT_QUOTAS = {"identity": 10, "productFit": 20, "businessRole": 12, "scaleAndImport": 12, "countrySignals": 8, "exclusionsAndRisks": 10}


#: Rows and bytes up to which a table is broadcast.
SMALL, SMALL_BYTES = 100_000, 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has at most SMALL rows and its columns, as text, SMALL_BYTES; else to be joined by merging."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, held = df.limit(SMALL + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL and held <= SMALL_BYTES else df.hint("merge")


def dedupe_terms(terms: DataFrame, key: str) -> DataFrame:
    """terms(key, pos, term): trimmed terms of 2 or more characters, the first spelling of each kept."""
    own = terms.withColumn("term", F.trim("term")).where(F.length("term") >= 2)
    first = F.row_number().over(Window.partitionBy(key, F.lower("term")).orderBy("pos"))
    return own.withColumn("__rn", first).where("__rn = 1").drop("__rn")


def meet_strings(strings: DataFrame, texts: DataFrame, block: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, own): pairs(block, needle, id) of strings(block, needle) and texts(block, id, text, ...) of a block that share a key, and all texts in such pairs, written.

    Every text that holds a string is in a pair with it; a pair may be of strangers.
    Keys are those of functions.grams. A filter of the strings' keys goes over the
    texts, which are read once, and only keys that pass it are shuffled. Equal
    strings are sought once. The filter has at most 32 MB; beyond some eight million
    strings more keys pass it.
    """
    spark = texts.sparkSession
    folder = new_folder(spark, "strings")
    types = {f.name: f.dataType.simpleString() for f in [*texts.schema, *strings.schema]}
    seed = F.xxhash64(block).alias("seed")
    listed = strings.select(block, "needle").where(f"{block} is not null and needle is not null").distinct().select("*", seed)
    keyed = stored(listed.mapInArrow(grams.keyed_strings, f"`{block}` {types[block]}, needle string, size int, key long"), f"{folder}/keyed")
    counts = {r["size"]: r["n"] for r in keyed.groupBy("size").agg(F.count("*").alias("n")).collect()}
    bits = min(grams.MOST_BITS, max(16, (grams.KEY_BITS * sum(counts.values())).bit_length()))
    words = keyed.select("key").mapInArrow(grams.marked(bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    content = np.zeros(1 << (bits - 6), np.uint64)
    content[words["word"].to_numpy()] = words["value"].to_numpy().view(np.uint64)
    whole = texts.where(f"{block} is not null and id is not null")
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    shared = spark.sparkContext.broadcast(content.tobytes())
    own = stored(whole.select("*", seed).mapInArrow(grams.keyed_texts(sorted(counts), shared, bits), f"{held}, keys array<long>"), f"{folder}/texts")
    met = own.select(block, "id", F.explode("keys").alias("key"))
    return keyed.drop("size").hint("merge").join(met, [block, "key"]).select(block, "needle", "id").distinct(), own.drop("keys")


def find_strings(strings: DataFrame, texts: DataFrame, block: str) -> DataFrame:
    """(block, needle, id, at): texts(block, id, text) of the same block that hold a string of strings(block, needle), and where (from 0).

    Strings meet texts by meet_strings(), and what meets is compared in full.
    """
    pairs, own = meet_strings(strings, texts.select(block, "id", "text"), block)
    both = pairs.hint("merge").join(own, [block, "id"]).where(F.contains("text", F.col("needle")))
    return both.select(block, "needle", "id", (F.instr("text", F.col("needle")) - 1).cast("long").alias("at"))


def locate_quotes(quotes: DataFrame, pages: DataFrame, block: str) -> DataFrame:
    """(quote_id, page, at): pages of the same block that hold a quote word for word, and where (from 0)."""
    found = find_strings(quotes.select(block, F.col("quote").alias("needle")), pages.select(block, F.col("page").alias("id"), "text"), block)
    own = quotes.select(block, "quote_id", F.col("quote").alias("needle"))
    return own.join(found.hint("merge"), [block, "needle"]).select("quote_id", F.col("id").alias("page"), "at")


# White space, and what stands for typographic marks, when a quote is sought loosely.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
TYPOGRAPHIC, PLAIN = "\u2018\u2019\u201c\u201d\u2013\u2014", "''\"\"--"
ELLIPSIS = "\u2026"
LEAST_LOOSE = 12


def folded(c: Column) -> Column:
    """A text with runs of white space as one space, none at its ends, and plain quote marks, dashes and dots."""
    marks = F.replace(F.translate(c, TYPOGRAPHIC, PLAIN), F.lit(ELLIPSIS), F.lit("..."))
    plain = F.when(c.rlike(f"[{TYPOGRAPHIC}{ELLIPSIS}]"), marks).otherwise(c)  # most texts have none, and translate() is slow
    # The looks ahead pass over words and single spaces, for which the long class would be slow.
    return F.trim(F.regexp_replace(plain, f"(?=[^!-~])(?: (?=[^!-~])[{SPACES}]+|(?! )[{SPACES}]+)", " "))


def origin(text: str, at: int, length: int) -> tuple[int, int]:
    """Where a span of the folded text lies in the text itself, as (begin, end)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(points, [ord(x) for x in SPACES])
    width = np.where(points == ord(ELLIPSIS), 3, 1)
    width[space] = 0
    width[np.flatnonzero(space[1:] & ~space[:-1]) + 1] = 1  # a run of spaces counts where it begins, one at the start not at all
    ends = np.cumsum(width)
    return int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, at + length - 1, "right")) + 1


def _origins(text: pd.Series, at: pd.Series, length: pd.Series) -> pd.DataFrame:
    spans = [origin(t, int(a), int(n)) if t is not None else (None, None) for t, a, n in zip(text, at, length, strict=True)]
    return pd.DataFrame({"begin": pd.array([x for x, _ in spans], "Int32"), "end": pd.array([x for _, x in spans], "Int32")})


def locate_quotes_loosely(quotes: DataFrame, pages: DataFrame, block: str) -> DataFrame:
    """(block, quote_id, page, quotes, pages, found, at, exact): pages of the same block that hold a quote, and their own words for it.

    A quote is sought word for word first; else, if it has LEAST_LOOSE characters
    when folded(), with any white space, quote marks, dashes and dots. found is the
    first such span of the page's text and `at` its place (from 0). Equal quotes and
    equal texts of a block are sought once: quote_id and page are the least ids among
    equals, quotes and pages their numbers, so copies are not multiplied. Folded
    quotes meet folded texts by find_strings(). Nulls and blank quotes are not found;
    an empty table gives an empty result; ids that repeat count as often.
    """
    own = quotes.where(F.col(block).isNotNull() & F.col("quote").isNotNull()).groupBy(block, "quote").agg(F.min("quote_id").alias("quote_id"), F.count("*").alias("quotes"))
    own = own.withColumn("needle", folded(F.col("quote"))).where("needle <> ''")
    texts = pages.where(F.col(block).isNotNull() & F.col("text").isNotNull()).groupBy(block, F.sha2("text", 256).alias("digest"))
    texts = texts.agg(F.min("page").alias("page"), F.count("*").alias("pages"), F.first("text").alias("own"))
    texts = texts.select(block, F.col("digest").alias("id"), "page", "pages", "own", folded(F.col("own")).alias("text"))
    pairs, met = meet_strings(own.select(block, "needle"), texts, block)
    both = own.join(pairs.hint("merge"), [block, "needle"]).hint("merge").join(met, [block, "id"]).where(F.contains("text", F.col("needle")))
    both = both.withColumn("at", F.instr("text", F.col("needle")) - 1).drop("text").withColumnRenamed("own", "text")
    both = both.withColumn("exact", F.contains("text", F.col("quote"))).where(F.col("exact") | (F.length("needle") >= LEAST_LOOSE))
    origins = F.pandas_udf(_origins, "struct<begin: int, end: int>")
    both = both.withColumn("span", origins(F.when(~F.col("exact"), F.col("text")), "at", F.length("needle")))
    begin = F.when(F.col("exact"), F.instr("text", F.col("quote")) - 1).otherwise(F.col("span.begin")).cast("long")
    found = F.when(F.col("exact"), F.col("quote")).otherwise(F.substring("text", F.col("span.begin") + 1, F.col("span.end") - F.col("span.begin")))
    return both.select(block, "quote_id", "page", "quotes", "pages", found.alias("found"), begin.alias("at"), "exact")


def cut_points(text: str) -> list[tuple[int, int]]:
    """Ranges of a text's chunks: at most CHUNK long, cut after the last mark or else at the last space beyond LEAST_CUT, overlapping by OVERLAP."""
    out, at = [], 0
    while True:
        at += len(text[at:]) - len(text[at:].lstrip()) if at < len(text) and text[at].isspace() else 0
        if at >= len(text):
            return out
        limit = min(len(text), at + CHUNK)
        least = min(limit, at + LEAST_CUT)
        end = max(text.rfind(mark, least, limit) for mark in MARKS) + 1 or limit
        if end == limit < len(text):
            space = text.rfind(" ", least, limit + 1)
            end = space if space >= 0 else end
        out.append((at, at + len(text[at:end].rstrip())))
        if end >= len(text):
            return out
        at = max(end - OVERLAP, at + 1)


def chunk_pages(pages: DataFrame) -> DataFrame:
    """(ref, company, page_index, snippet_index, chunk) of pages(company, page_index, text). A cut depends on the one before, so each page is cut in Python; chunks leave it after CUT_CHARS characters of pages, so a task holds no more than that and one batch of texts."""

    def cut(batches):
        for batch in batches:
            keys, texts = [batch.column(c) for c in ("company", "page_index")], batch.column("text")
            rows, numbers, chunks, size = [], [], [], 0
            for r in range(batch.num_rows):
                text = texts[r].as_py() or ""
                for i, (a, b) in enumerate(cut_points(text)):
                    rows.append(r)
                    numbers.append(i)
                    chunks.append(text[a:b])
                size += len(text)
                if size >= CUT_CHARS or r == batch.num_rows - 1:
                    taken = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([*[k.take(taken) for k in keys], pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], ["company", "page_index", "i", "chunk"])
                    rows, numbers, chunks, size = [], [], [], 0

    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select("company", "page_index", "text").mapInArrow(cut, f"company {types['company']}, page_index {types['page_index']}, i int, chunk string")
    return rows.select(F.concat(F.lit("p"), "page_index", F.lit("-s"), "i").alias("ref"), "company", "page_index", F.col("i").cast("long").alias("snippet_index"), "chunk")


def chunk_fixed(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of fixed size and stride."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(step))
    rows = pages.select("company", "page_index", "text", F.explode(starts).alias("at"))
    ref = F.concat(F.lit("p"), "page_index", F.lit("-s"), F.floor(F.col("at") / step).cast("string"))
    return rows.select(ref.alias("ref"), "company", "page_index", F.col("at").cast("long").alias("at"), F.substring("text", F.col("at") + 1, F.lit(size)).alias("chunk"))


def page_boost(url: Column, title: Column, slot: Column) -> Column:
    """What a page's address and title add to a chunk's score in a slot."""
    # Words and points.
    path = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://[^/?#]*", ""), r"[?#].*$", ""))
    value = F.concat(path, F.lit(" "), F.lower(title))
    return (
        F.when(path.isin("", "/") & (slot == "identity"), 5)
        .when(value.rlike("about|profile|company|who-we-are|our-story"), F.when(slot.isin("identity", "scaleAndImport"), 4).otherwise(1))
        .when(value.rlike("product|catalog|solution|application|industr|service"), F.when(slot.isin("productFit", "businessRole"), 4).otherwise(1))
        .when(value.rlike("contact|location|find-us|reach-us"), F.when(slot.isin("identity", "countrySignals"), 3).otherwise(0))
        .otherwise(0)
    )


def rank_evidence(chunks: DataFrame, slots: DataFrame, prior: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """(company, slot, ref, page_index, score, rank) of chunks(company, page_index, ref, url, title, text) against slots(slot, term).

    score counts the slot's distinct terms among the words of chunk, title and url,
    and adds the page's boost, 1 on the first page, and 12 for chunks that carry a
    prior(company, ref) quote. Terms meet words by an equi-join; chunks without a
    score are left out; ranks are cut at each slot's quota.
    """
    quotas = quotas or SLOT_QUOTAS
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "text", "title", "url")), r"[^\p{L}\p{N}]+"))
    overlap = chunks.select("company", "ref", F.explode(words).alias("term")).join(bounded(slots), "term").groupBy("company", "slot", "ref").agg(F.count("*").alias("n"))
    rows = chunks.select("company", "page_index", "ref", "url", "title", F.explode(F.array(*map(F.lit, quotas))).alias("slot"))
    rows = rows.join(overlap.hint("merge"), ["company", "slot", "ref"], "left").join(prior.select("company", "ref", F.lit(12).alias("p")).hint("merge"), ["company", "ref"], "left")
    first = F.when(F.col("page_index") == 0, 1).otherwise(0)
    score = F.coalesce("n", F.lit(0)) + page_boost(F.col("url"), F.col("title"), F.col("slot")) + first + F.coalesce("p", F.lit(0))
    scored = rows.withColumn("score", score).where("score > 0")
    order = F.row_number().over(Window.partitionBy("company", "slot").orderBy(F.desc("score"), "page_index", "ref"))
    limit = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    # A literal bound lets Spark keep the first rows of each group before the shuffle; a company is never sorted whole.
    first_rows = scored.withColumn("rank", order).where(F.col("rank") <= max(quotas.values()))
    out = first_rows.withColumn("rank", F.col("rank").cast("long")).where(F.col("rank") <= limit[F.col("slot")])
    return out.select("company", "slot", "ref", "page_index", "score", "rank")


def search_page(ranked: DataFrame, keys: list[str], order: list[Column], cursor: int, size: int) -> DataFrame:
    """One page of a ranked list: rows after the cursor, with the total and the next cursor (null at the end)."""
    total = F.count("*").over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = ranked.withColumn("rank", rank.cast("long")).withColumn("total", total)
    more = F.when(F.col("total") > cursor + size, F.lit(cursor + size).cast("long"))
    return rows.where(F.col("rank").between(cursor + 1, cursor + size)).withColumn("next_cursor", more)


def neighbours(chunks: DataFrame, wanted: DataFrame, radius: int) -> DataFrame:
    """chunks(page, idx, ...) within radius of the wanted(page, idx) chunks of the same page, each once per wanted chunk."""
    w = wanted.select("page", F.explode(F.sequence(F.col("idx") - radius, F.col("idx") + radius)).alias("idx"), F.col("idx").alias("center"))
    return chunks.join(w.hint("merge"), ["page", "idx"])


def prior_quotes(quotes: DataFrame, chunks: DataFrame, block: str) -> DataFrame:
    """chunks of a block that carry a prior quote of it: equal, one inside the other, or its first 48 characters inside.

    Chunks are written with the hash of their flat text and read from there; a chunk
    is sought in quotes only if it is no longer than the longest of them.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"[^\S ]\s*| \s+", " "))  # noqa: E731  one space alone stays as it is
    folder = new_folder(chunks.sparkSession, "prior-quotes")
    q = stored(quotes.select(block, flat(F.col("quote")).alias("quote")).where(F.length("quote") >= 16).distinct(), f"{folder}/quotes")
    longest = q.agg(F.max(F.length("quote"))).first()[0] or 0
    own = stored(chunks.withColumn("__sum", F.sha2(flat(F.col("text")), 256)), f"{folder}/chunks")
    flats = own.select(block, F.col("__sum").alias("id"), flat(F.col("text")).alias("text"))
    # A chunk that holds a whole quote holds its first 48 characters too.
    begun = find_strings(q.select(block, F.substring("quote", 1, 48).alias("needle")), flats, block).select(block, F.col("id").alias("__sum"))
    short = flats.where(F.length("text") <= longest).select(block, F.col("text").alias("needle"))
    within = find_strings(short, q.select(block, F.col("quote").alias("id"), F.col("quote").alias("text")), block)
    found = begun.union(within.select(block, F.sha2("needle", 256).alias("__sum"))).distinct()
    return own.join(found.hint("merge"), [block, "__sum"], "left_semi").select(*chunks.columns)


def restore_evidence(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """facts(company, ref, ...) with the quote of their chunk; found tells whether the chunk exists."""
    own = chunks.select("company", "ref", F.col("text").alias("quote"))
    return facts.join(own.hint("merge"), ["company", "ref"], "left").withColumn("found", F.col("quote").isNotNull())


def evidence_ids(facts: DataFrame, refs: DataFrame) -> DataFrame:
    """(company, ids): ids of the facts behind refs(company, pos, ref), in the order of first mention; the last fact of a ref counts."""
    last = facts.groupBy("company", "ref").agg(F.max_by("id", "pos").alias("id"))
    first = refs.groupBy("company", "ref").agg(F.min("pos").alias("pos"))
    both = first.join(last.hint("merge"), ["company", "ref"])
    return both.groupBy("company").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def lexicon_join(texts: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """(key, term, times) of texts(key, text) and lexicon(term): how often a text's words in a row are those of a term; only matches are moved."""
    words = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    found = match_terms(texts.select(key, words.alias("text")), lexicon.select("term", F.lit(WORD).alias("rule")), key)
    return found.groupBy(key, "term").agg(F.sum("times").cast("long").alias("times"))


def facts_from_pages(pages: DataFrame, terms: DataFrame, span: int = 1024) -> DataFrame:
    """(company, id, kind, term, page_index) of pages(company, page_index, text) and terms(kind, pos, term), numbered in scan order.

    The terms are one dictionary, so a page is read once. Facts are written before they
    are numbered, runs of `span` pages at a time.
    """
    texts = pages.select(F.struct("company", "page_index").alias("id"), F.lower("text").alias("text"))
    held = match_terms(texts, terms.select("term", F.lit(ANYWHERE).alias("rule")), "id").select("id.company", "id.page_index", "term")
    found = held.hint("merge").join(terms.select("kind", "pos", "term"), "term").select("company", "page_index", "kind", "pos", "term")
    found = stored(found, new_folder(pages.sparkSession, "facts"))
    rows = number_rows(found, ["company"], F.floor(F.col("page_index") / span), ["page_index", "kind", "pos"], "place")
    return rows.select("company", F.concat(F.lit("ev-"), "company", F.lit("-"), "place").alias("id"), "kind", "term", "page_index")


def distinct_in_order(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """(key, values): distinct values in the order of first sight."""
    first = rows.groupBy(key, value).agg(F.min(pos).alias("pos"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def fingerprints(rows: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """(key, name): a hash of a group's rows that does not depend on their order.

    Rows are hashed one by one and the hashes added in four pieces, so a group is
    summed before the shuffle and never held whole; a repeated row counts twice.
    """
    own = F.sha2(F.to_json(F.struct(*fields)), 256)
    pieces = [F.sum(F.conv(F.substring(own, 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")).cast("string") for i in range(4)]
    return rows.groupBy(key).agg(F.sha2(F.concat_ws(",", *pieces), 256).alias(name))


def company_fingerprints(pages: DataFrame, page_fields: list[str], contacts: DataFrame, contact_fields: list[str], strategies: DataFrame, key: str) -> DataFrame:
    """(key, page_fingerprint, candidate_fingerprint, decision_fingerprint): of a company's pages, of its contacts (null without any), and of both under its strategies(key, strategy).

    Another strategy changes the decision's fingerprint alone; null keys are a company.
    """
    own = fingerprints(pages, key, page_fields, "page_fingerprint")
    candidates = fingerprints(contacts.withColumnRenamed(key, "__c"), "__c", contact_fields, "candidate_fingerprint")
    rows = own.join(candidates.hint("merge"), F.col(key).eqNullSafe(F.col("__c")), "left").drop("__c")
    rows = rows.join(strategies.select(F.col(key).alias("__s"), "strategy").hint("merge"), F.col(key).eqNullSafe(F.col("__s")))
    decision = F.sha2(F.concat_ws("|", "page_fingerprint", F.coalesce("candidate_fingerprint", F.lit("")), "strategy"), 256)
    return rows.select(key, "page_fingerprint", "candidate_fingerprint", decision.alias("decision_fingerprint"))
