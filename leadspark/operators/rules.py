"""Rules over tables of JSON entities: a JSON schema compiled to column conditions, every failure reported."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nested import at, items, kind, members

FAILURE = "struct<path: string, rule: string, detail: string>"
#: Words of a schema that make no rule.
NOTES = {"$schema", "$id", "$defs", "title", "description", "default", "examples"}

# Fixed values below: what policies, country profiles and strategies must look like.
_ID = {"type": "string", "pattern": "^[a-z][a-z0-9-]{1,39}$"}
_TEXT = {"type": "string", "pattern": r"\S"}
_TEXTS = {"type": "array", "items": {"type": "string"}}


def _section(**properties: dict) -> dict:
    """An object with exactly these members."""
    return {"type": "object", "additionalProperties": False, "required": list(properties), "properties": properties}


POLICY = _section(
    schemaVersion={"const": 1},
    marketId=_ID,
    searchLocalization=_section(languages=_TEXTS, buyerRoleTerms=_TEXTS, queryPatterns=_TEXTS, translationRestrictions=_TEXTS),
    companyAnalysis=_section(identitySignals=_TEXTS, legalSuffixSemantics=_TEXTS, buyerSignals=_TEXTS, importAndScaleSignals=_TEXTS, falsePositivePatterns=_TEXTS, exclusions=_TEXTS),
    contactAndOutreach=_section(preferredContactTerms=_TEXTS, validationNotes=_TEXTS, defaultLanguage={"type": "string"}, etiquette=_TEXTS),
)
PROFILE = _section(
    id=_ID,
    displayName=_TEXT,
    shortName=_TEXT,
    aliases=_TEXTS | {"minItems": 1},
    gl={"type": "string", "pattern": "^[a-z]{2}$"},
    defaultHl={"type": "string", "minLength": 1},
    googleDomain=_TEXT,
    location=_TEXT,
    cities=_TEXTS | {"minItems": 1},
    phoneCountryCode={"type": "string", "pattern": "^[A-Z]{2}$"},
    callingCode={"type": "string", "pattern": r"^\+[0-9]{1,4}$"},
    domainSuffix={"type": "string", "pattern": r"(?i)^\.[a-z0-9.-]+$"},
    businessSuffixes=_TEXTS,
)
PROFILE["properties"]["countryNameAliases"] = _TEXTS
ROLES = ["Distributor", "Wholesaler", "Importer", "Manufacturer", "Retailer", "Service", "Unknown"]
STRATEGY = {
    "type": "object",
    "required": ["schemaVersion", "product", "objective", "country", "targetCustomer", "search"],
    "properties": {
        "schemaVersion": {"enum": [1, 2]},
        "product": {"type": "string", "minLength": 1},
        "objective": {"type": "string", "minLength": 1},
        "country": _ID,
        "targetCustomer": {"type": "object", "required": ["businessRoles"], "properties": {"businessRoles": {"type": "array", "minItems": 1, "items": {"enum": ROLES}}}},
        "search": {"type": "object", "required": ["requiredKeywords"], "properties": {"requiredKeywords": _TEXTS | {"minItems": 1}}},
        "marketPolicyRef": {"type": "object", "required": ["marketId", "version", "hash"], "properties": {"marketId": _ID, "version": _TEXT, "hash": _TEXT}},
    },
}


def text_at(v: Column, *names: str) -> Column:
    """The text at a path of names, null where there is none."""
    for name in names:
        v = at(v, name)
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))


def number_at(v: Column, *names: str) -> Column:
    for name in names:
        v = at(v, name)
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double"))


def strategy_fields(v: Column) -> list[tuple[str, str, Column]]:
    """Rules between fields of a strategy: from version 2 on it names a policy, that of its country."""
    second = number_at(v, "schemaVersion") == 2
    ref = text_at(v, "marketPolicyRef", "marketId")
    return [("$.marketPolicyRef", "required from version 2", second & at(v, "marketPolicyRef").isNull()), ("$.marketPolicyRef.marketId", "market of the country", second & ref.isNotNull() & ~ref.eqNullSafe(text_at(v, "country")))]


def same_market(market: Column) -> Callable[[Column], list[tuple[str, str, Column]]]:
    """The rule that a policy is of the market that it is filed under."""
    return lambda v: [("$.marketId", "market of its folder", text_at(v, "marketId").isNotNull() & ~text_at(v, "marketId").eqNullSafe(market))]


def _literal(v: Column, value: Any) -> Column:
    """Whether a value equals a scalar of the schema."""
    if value is None:
        return kind(v) == "null"
    if isinstance(value, bool):
        return (kind(v) == "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return (kind(v) == "number") & (F.try_variant_get(v, "$", "double") == float(value))
    return (kind(v) == "string") & (F.try_variant_get(v, "$", "string") == value)


def compile_schema(schema: dict, root: dict | None = None, path: str = "$") -> list[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column] | None]]:
    """(path, rule, fails, detail): conditions over a VARIANT that a document breaks; a value that is absent breaks only `required`.

    Known words: type, const, enum, pattern, minLength, minItems, minimum, maximum,
    required, properties, additionalProperties false, items, and $ref to #/$defs. Any
    other word is refused, so that no rule is lost in silence. A value of the wrong
    type breaks no further rule.
    """
    root = root or schema
    if "$ref" in schema:
        return compile_schema(root["$defs"][schema["$ref"].removeprefix("#/$defs/")], root, path)
    known = {"type", "const", "enum", "pattern", "minLength", "minItems", "minimum", "maximum", "required", "properties", "additionalProperties", "items"}
    if odd := set(schema) - known - NOTES:
        raise ValueError(f"{path}: unknown words {sorted(odd)}")
    out: list = []
    text, number = (lambda v: F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))), (lambda v: F.when(kind(v) == "number", F.try_variant_get(v, "$", "double")))
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]

        def wrong(v: Column) -> Column:
            plain = [k for k in kinds if k != "integer"]
            fits = kind(v).isin(*plain, "")  # null for what is absent
            return ~(fits | F.coalesce(number(v) == F.floor(number(v)), F.lit(False))) if "integer" in kinds else ~fits

        out.append((path, "type", wrong, kind))
    if "const" in schema:
        out.append((path, "const", lambda v: ~_literal(v, schema["const"]), None))
    if "enum" in schema:

        def unlisted(v: Column) -> Column:
            hit = F.lit(False)
            for value in schema["enum"]:
                hit = hit | F.coalesce(_literal(v, value), F.lit(False))
            return F.when(kind(v).isNotNull(), ~hit)

        out.append((path, "enum", unlisted, None))
    if "pattern" in schema:
        out.append((path, "pattern", lambda v: ~text(v).rlike(schema["pattern"]), None))
    if "minLength" in schema:
        out.append((path, "minLength", lambda v: F.length(text(v)) < schema["minLength"], None))
    if "minimum" in schema:
        out.append((path, "minimum", lambda v: number(v) < schema["minimum"], None))
    if "maximum" in schema:
        out.append((path, "maximum", lambda v: number(v) > schema["maximum"], None))
    if "minItems" in schema:
        out.append((path, "minItems", lambda v: F.size(items(v)) < schema["minItems"], None))
    for name in schema.get("required", []):
        out.append((f"{path}.{name}", "required", lambda v, name=name: (kind(v) == "object") & at(v, name).isNull(), None))
    if schema.get("additionalProperties") is False:
        allowed = F.array(*[F.lit(x) for x in schema.get("properties", {})]).cast("array<string>")
        extra = lambda v: F.array_except(F.map_keys(members(v)), allowed)
        out.append((path, "additionalProperties", lambda v: F.size(extra(v)) > 0, lambda v: F.array_join(F.array_sort(extra(v)), ",")))
    for name, inner in schema.get("properties", {}).items():
        for p, rule, fails, detail in compile_schema(inner, root, f"{path}.{name}"):
            out.append((p, rule, lambda v, f=fails, n=name: f(at(v, n)), detail and (lambda v, f=detail, n=name: f(at(v, n)))))
    if "items" in schema:
        for p, rule, fails, _ in compile_schema(schema["items"], root, f"{path}[*]"):
            out.append((p, rule, lambda v, f=fails: F.exists(items(v), f), None))
    return out


def entity_violations(rows: DataFrame, key: str, column: str, schema: dict, fields: Callable[[Column], list[tuple[str, str, Column]]] | None = None) -> DataFrame:
    """(key, path, rule, detail): every rule that the JSON text in `column` breaks; one row (`$`, json) where it is no JSON.

    fields gives rules between fields: (path, rule, fails). Of an array's items a
    broken rule is told once. Each row is read once, and nothing is shuffled.
    """
    v = F.col("__v")
    checks = [F.when(v.isNull(), F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"), F.lit(None).cast("string").alias("detail")))]
    for path, rule, fails, detail in compile_schema(schema):
        told = detail(v) if detail else F.lit(None).cast("string")
        checks.append(F.when(fails(v), F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"), told.alias("detail"))))
    for path, rule, fails in fields(v) if fields else []:
        checks.append(F.when(fails, F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("detail"))))
    own = rows.withColumn("__v", F.try_parse_json(column))
    broken = F.filter(F.array(*[c.cast(FAILURE) for c in checks]), lambda x: x.isNotNull())
    return own.select(key, F.inline(broken))
