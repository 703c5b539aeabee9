"""Nested JSON as VARIANT: kinds, canonical form and redaction, walked level by level in column functions.

A level of a document is one array of its members, whether it is an object or an
array, so an expression grows with the depth and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .records import SENSITIVE_KEY, redact

#: Levels that a canonical form orders; what lies deeper keeps the order of its bytes.
DEPTH = 12
# Levels below the root that redaction keeps, and members of each level.
REDACTED_DEPTH, REDACTED_MEMBERS = 6, 100


def kind(v: Column) -> Column:
    """object, array, string, number, boolean, null, or other (dates and the like); null for what is absent."""
    return _kind(F.call_function("schema_of_variant", v))


def _kind(s: Column) -> Column:
    return (
        F.when(s == "STRING", "string")
        .when(F.startswith(s, F.lit("OBJECT<")), "object")
        .when(F.startswith(s, F.lit("ARRAY<")), "array")
        .when((s == "BIGINT") | (s == "DOUBLE") | (s == "FLOAT") | F.startswith(s, F.lit("DECIMAL(")), "number")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .when(s.isNotNull(), "other")
    )


def members(v: Column) -> Column:
    """The members of an object by name; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """The items of an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def at(v: Column, name: str) -> Column:
    """The member of that name, null where there is none."""
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(v, f"$['{quoted}']", "variant")


def json_string(c: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _closed(what: Column, parts: Column, scalar: Column) -> Column:
    """A container of its parts, or the scalar; the parts stand in the expression once, since levels nest in them."""
    is_object = what == "object"
    whole = F.concat(F.when(is_object, "{").otherwise("["), F.array_join(parts, ","), F.when(is_object, "}").otherwise("]"))
    return F.when(what.isin("object", "array"), whole).otherwise(scalar)


def canonical_json(v: Column, depth: int = DEPTH) -> Column:
    """JSON whose objects have their names in the order of the root collation, at every level down to `depth`.

    Documents that differ only in white space or in the order of names come out
    alike; the order of arrays counts.
    """
    if depth == 0:
        return F.to_json(v)
    named = members(v)
    order = F.array_sort(F.transform(F.map_keys(named), lambda k: F.struct(F.collate(k, "UNICODE").alias("c"), k.alias("k"))))
    fields = F.transform(order, lambda o: F.struct(F.concat(json_string(o["k"]), F.lit(":")).alias("name"), F.element_at(named, o["k"]).alias("value")))
    plain = F.transform(items(v), lambda x: F.struct(F.lit("").alias("name"), x.alias("value")))
    parts = F.transform(F.coalesce(fields, plain), lambda m: F.concat(m["name"], canonical_json(m["value"], depth - 1)))
    return _closed(kind(v), parts, F.to_json(v))


def content_hash(json: Column, length: int = 64) -> Column:
    """SHA-256 of a document's canonical form, its first `length` digits; null where the text is no JSON."""
    return F.substring(F.sha2(canonical_json(F.try_parse_json(json)), 256), 1, length)


def _with(c: Column, use) -> Column:
    """use(c), c being made once for a row: what a lambda refers to is a value, where an expression that stands twice is made twice."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def number_at(v: Column, name: str, to: str) -> Column:
    """The member of that name as a number of type `to`; null for what is absent or of another kind. v, the member and its kind are made once for a row."""
    own = lambda x: _with(F.call_function("schema_of_variant", x), lambda s: F.when(_kind(s) == "number", F.try_variant_get(x, "$", to)))
    return _with(at(v, name), own)


def _redacted(raw: Column, v: Column, depth: int) -> Column:
    if depth > REDACTED_DEPTH:
        return F.lit('"[MAX_DEPTH]"')

    # VARIANT sorts names; the text keeps their order, which says what the first members are.
    texts = F.slice(F.map_entries(F.from_json(raw, "map<string,string>")), 1, REDACTED_MEMBERS)
    listed = F.slice(F.from_json(raw, "array<string>"), 1, REDACTED_MEMBERS)
    member = lambda name, raw, value: F.struct(name.alias("name"), raw.alias("raw"), value.alias("value"))
    fields = _with(members(v), lambda own: F.transform(texts, lambda m: member(m["key"], m["value"], F.element_at(own, m["key"]))))
    plain = _with(items(v), lambda own: F.transform(listed, lambda x, i: member(F.lit(None).cast("string"), x, F.get(own, i))))

    def part(m: Column) -> Column:
        inner = F.when(m["name"].rlike(SENSITIVE_KEY), F.lit('"[REDACTED]"')).otherwise(_redacted(m["raw"], m["value"], depth + 1))
        return F.concat(F.when(m["name"].isNotNull(), F.concat(json_string(m["name"]), F.lit(":"))).otherwise(""), inner)

    def whole(what: Column) -> Column:
        parts = F.transform(F.when(what == "object", fields).when(what == "array", plain), part)  # stands once, since levels nest in it
        text = json_string(redact(F.try_variant_get(v, "$", "string")))
        return _closed(what, parts, F.when(what == "string", text).otherwise(F.to_json(v)))

    return _with(_with(F.call_function("schema_of_variant", v), _kind), whole)


def redact_json(json: Column) -> Column:
    """JSON with secrets hidden at every level, as JSON.

    Members of sensitive names become a mark, whatever they hold; texts lose tokens,
    addresses and phone numbers; of each object and array the first REDACTED_MEMBERS
    stay; what lies below REDACTED_DEPTH levels becomes a mark. A text that is no JSON
    is redacted as a text, and given as a JSON string; null stays null.
    """
    parsed = lambda v: F.when(v.isNotNull(), _redacted(json, v, 0)).when(json.isNotNull(), json_string(redact(json)))
    return _with(F.try_parse_json(json), parsed)
