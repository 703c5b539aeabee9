"""Dictionary matching: every term of a dictionary found in one pass over each text.

Dictionaries of bounded size become an Aho-Corasick automaton in each task, which
reads a text once however many terms there are; larger ones meet the texts by an
equi-join on gram keys, and what meets is counted by patterns. Both give the same.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of terms up to which a dictionary becomes an automaton.
AUTOMATON_BYTES = 8 << 20
#: What must not stand beside a term: nothing, letters and digits, ASCII letters and digits.
ANYWHERE, WORD, ASCII = "anywhere", "word", "ascii"
_BESIDE = {WORD: r"[\p{L}\p{N}]", ASCII: "[A-Za-z0-9]"}

FOUND = "array<struct<n: int, at: int, times: int>>"


def _automaton(terms: list[tuple[str, str]]):
    import ahocorasick

    automaton, of = ahocorasick.Automaton(), {}
    for n, (term, rule) in enumerate(terms):
        if term:
            of.setdefault(term, []).append((n, rule))
    for term, rules in of.items():
        automaton.add_word(term, (len(term), rules))
    if of:
        automaton.make_automaton()
    return automaton if of else None


def _places(automaton, text: str) -> dict[int, list[int]]:
    """First place and number of places of each term that stands in the text by its rule; overlapping places count."""
    seen: dict[int, list[int]] = {}
    for end, (length, rules) in automaton.iter(text):
        start = end - length + 1
        before, after = text[start - 1] if start else " ", text[end + 1] if end + 1 < len(text) else " "
        for n, rule in rules:
            if rule == ANYWHERE or not any(c.isalnum() and (rule == WORD or c.isascii()) for c in (before, after)):
                held = seen.get(n)
                if held is None:
                    seen[n] = [start, 1]
                else:
                    held[0] = min(held[0], start)
                    held[1] += 1
    return seen


def matched(text: Column, terms: list[tuple[str, str]]) -> Column:
    """array<struct<n, at, times>>: the terms(term, rule) that a text holds, by their place in the list, in that order.

    at is the first place (from 0, in code points), times the number of places.
    Case counts: lower both sides to ignore it. Null texts and empty terms hold and
    match nothing.
    """
    kind = pa.list_(pa.struct([("n", pa.int32()), ("at", pa.int32()), ("times", pa.int32())]))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(terms)
        for texts in batches:
            ends, found = array("i", [0]), [array("i") for _ in range(3)]
            for value in texts:  # one text at a time becomes an object
                text = value.as_py()
                seen = _places(automaton, text) if text and automaton else {}
                for n in sorted(seen):
                    for column, x in zip(found, (n, *seen[n]), strict=True):
                        column.append(x)
                ends.append(len(found[0]))
            columns = [pa.array(np.frombuffer(c, np.int32) if c else [], pa.int32()) for c in found]
            yield pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)

    return F.arrow_udf(find, FOUND)(text)


def _by_grams(texts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """match_terms() for dictionaries of any size."""
    from .evidence import find_strings

    whole = texts.select(F.lit(0).alias("all"), F.col(key).alias("id"), "text")
    met = find_strings(terms.select(F.lit(0).alias("all"), F.col("term").alias("needle")), whole, "all").select(F.col("id").alias(key), F.col("needle").alias("term")).distinct()
    rows = met.hint("merge").join(terms, "term").hint("merge").join(texts.select(key, "text"), key)
    quoted = F.regexp_replace("term", r"([.*+?^${}()|\[\]\\&~#-])", r"\\$1")
    pattern = F.concat(F.lit("(?="), quoted, F.lit(")"))
    for rule, beside in _BESIDE.items():
        bounded = F.concat(F.lit(f"(?<!{beside})(?="), quoted, F.lit(f"(?!{beside}))"))
        pattern = F.when(F.col("rule") == rule, bounded).otherwise(pattern)
    rows = rows.withColumn("pattern", pattern).withColumn("times", F.regexp_count("text", F.col("pattern"))).where("times > 0")
    before = F.regexp_extract_all("text", F.concat(F.lit("(?s)^(.*?)"), F.col("pattern")), F.lit(1))
    return rows.select(key, "term", "rule", F.length(F.get(before, F.lit(0))).alias("at"), "times")


def match_terms(texts: DataFrame, terms: DataFrame, key: str, most_bytes: int | None = None) -> DataFrame:
    """(key, term, rule, at, times) of texts(key, text) and terms(term, rule): each term that a text holds.

    The rule says what must not stand beside a term: ANYWHERE, WORD or ASCII. Terms
    that repeat count once, rows that repeat a key are texts of their own. Null and
    empty terms, null texts and null keys match nothing. The dictionary reaches the
    driver only if its terms have at most `most_bytes` bytes, which is counted first.
    """
    most = AUTOMATON_BYTES if most_bytes is None else most_bytes
    own = terms.select("term", "rule").where("term <> '' and rule is not null").distinct()
    size = own.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    texts = texts.select(key, "text").where(F.col(key).isNotNull() & F.col("text").isNotNull())
    if size > most:
        return _by_grams(texts, own, key)
    listed = sorted(map(tuple, own.collect()))
    rows = texts.select(key, F.inline(matched(F.col("text"), listed)))
    if not listed:
        return rows.select(key, F.lit("").alias("term"), F.lit("").alias("rule"), "at", "times")
    names = lambda i: F.get(F.array(*[F.lit(x[i]) for x in listed]), F.col("n"))
    if len(listed) <= 200:
        return rows.select(key, names(0).alias("term"), names(1).alias("rule"), "at", "times")
    # The dictionary's size is known to be at most `most`.
    numbered = texts.sparkSession.createDataFrame([(n, *x) for n, x in enumerate(listed)], "n int, term string, rule string")
    return rows.join(F.broadcast(numbered), "n").select(key, "term", "rule", "at", "times")
