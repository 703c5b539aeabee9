"""Nested JSON, rules over entities, and policy versions against plain Python."""

import copy
import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leadspark.functions import nested
from leadspark.operators import policies, rules


def some_json(rng, depth=0):
    pick = rng.randrange(7 if depth < 5 else 4)
    if pick >= 5:
        names = rng.sample(["b", "a", "B", "aB", "ab", "Ab", "c d", 'q"t', "é", "zz", "it's"], rng.randrange(6))
        return {k: some_json(rng, depth + 1) for k in names}
    if pick == 4:
        return [some_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [None, True, rng.randrange(-99, 10**9), rng.choice(["", "x\ny", 'say "é"\t', "\\", "7", "null", "\U0001f600"])][pick]


def plain_canonical(v):
    if isinstance(v, dict):
        # The root collation: letters first, case only between equals, small before large.
        order = sorted(v, key=lambda k: ([(c.lower() if c != "é" else "e~") for c in k if c.isalpha() or c == " "], k.swapcase()))
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + plain_canonical(v[k]) for k in order) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain_canonical, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def test_canonical_form_orders_names_at_every_level(spark):
    rng = random.Random(6)
    docs = [some_json(rng) for _ in range(150)] + [{"a": {"B": 1, "a": [{"d": 1, "C": 2}]}, "B": 2}]
    safe = lambda v: not any(x in json.dumps(v, ensure_ascii=False) for x in ("c d", "q\\", "it's", "é\":"))
    rows = [(i, json.dumps(d, ensure_ascii=False, indent=rng.choice([None, 2]))) for i, d in enumerate(docs)]
    got = {r.i: r for r in spark.createDataFrame(rows, "i long, j string").select("i", nested.canonical_json(F.parse_json("j")).alias("c"), nested.content_hash(F.col("j")).alias("h")).collect()}
    for i, d in enumerate(docs):
        assert json.loads(got[i].c) == d
        assert got[i].h == hashlib.sha256(got[i].c.encode()).hexdigest()
        if safe(d):
            assert got[i].c == plain_canonical(d), d
    turned = spark.createDataFrame([('{"b":[1,{"y":2,"x":null}],"a":"k"}',), ('{ "a":"k", "b":[1, {"x":null,"y":2}]}',), ('{"a":"k","b":[{"x":null,"y":2},1]}',), ("no json",), (None,)], "j string")
    h = [r[0] for r in turned.select(nested.content_hash(F.col("j"))).collect()]
    assert h[0] == h[1] != h[2] and h[3] is None and h[4] is None


SECRET = ("apikey", "password", "cookie", "authorization")


def plain_redacted(v, key="", depth=0):
    if any(s in key.lower() for s in SECRET):
        return "[REDACTED]"
    if depth > 6:
        return "[MAX_DEPTH]"
    if isinstance(v, dict):
        return {k: plain_redacted(x, k, depth + 1) for k, x in list(v.items())[:100]}
    if isinstance(v, list):
        return [plain_redacted(x, key, depth + 1) for x in v[:100]]
    return v.replace("token-abcdefghijkl", "[REDACTED_TOKEN]").replace("joe@x.com", "j***@x.com") if isinstance(v, str) else v


def test_redaction_reaches_every_level(spark):
    deep: dict = {"password": "s", "n": 1}
    for _ in range(9):
        deep = {"in": [deep, "token-abcdefghijkl"], "apiKey": {"x": 1}, "t": "mail joe@x.com"}
    many = {f"k{i:03d}" if i % 2 else f"z{i:03d}": i for i in range(150)}
    docs = [deep, many, {"list": list(range(120)), "inner": [many]}, "token-abcdefghijkl", [], {}, 5, {"Cookie": [1], "a": {"AUTHORIZATION": None, "b": '{"password":1}'}}, [[[[[[[[1]]]]]]]]]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(100, "no json, joe@x.com"), (101, None), (102, "")]
    got = {r.i: r.r for r in spark.createDataFrame(rows, "i long, j string").select("i", nested.redact_json(F.col("j")).alias("r")).collect()}
    for i, d in enumerate(docs):
        assert json.loads(got[i]) == plain_redacted(d), d
    assert list(json.loads(got[1])) == list(many)[:100]  # the first ones as written, not as sorted
    assert got[100] == '"no json, j***@x.com"' and got[101] is None and got[102] == '""'


POLICY = {
    "schemaVersion": 1, "marketId": "ae", "searchLocalization": {"languages": ["en"], "buyerRoleTerms": [], "queryPatterns": [], "translationRestrictions": []},
    "companyAnalysis": {"identitySignals": [], "legalSuffixSemantics": [], "buyerSignals": [], "importAndScaleSignals": [], "falsePositivePatterns": [], "exclusions": []},
    "contactAndOutreach": {"preferredContactTerms": [], "validationNotes": [], "defaultLanguage": "en", "etiquette": []},
}
PROFILE = {"id": "ae", "displayName": "UAE", "shortName": "UAE", "aliases": ["uae"], "gl": "ae", "defaultHl": "en", "googleDomain": "google.ae", "location": "Dubai", "cities": ["Dubai"], "phoneCountryCode": "AE", "callingCode": "+971", "domainSuffix": ".ae", "businessSuffixes": []}
STRATEGY = {"schemaVersion": 2, "product": "mesh", "objective": "find", "country": "ae", "targetCustomer": {"businessRoles": ["Importer"]}, "search": {"requiredKeywords": ["mesh"]}, "marketPolicyRef": {"marketId": "ae", "version": "v1", "hash": "h"}}
GONE = object()


def broken(base, path, value):
    out = copy.deepcopy(base)
    *way, last = path.split(".")
    at = out
    for name in way:
        at = at[name]
    if value is GONE:
        del at[last]
    else:
        at[last] = value
    return out


def texts_cases(section, names):
    for name in names:
        yield f"{section}.{name}", GONE, f"$.{section}.{name}", "required"
        yield f"{section}.{name}", "x", f"$.{section}.{name}", "type"
        yield f"{section}.{name}", ["x", 1], f"$.{section}.{name}[*]", "type"


CASES = [
    (rules.POLICY, lambda v: rules.same_market(F.lit("ae"))(v), POLICY, [
        ("schemaVersion", 2, "$.schemaVersion", "const"), ("schemaVersion", "1", "$.schemaVersion", "const"), ("marketId", GONE, "$.marketId", "required"), ("marketId", 5, "$.marketId", "type"), ("more", 1, "$", "additionalProperties"),
        ("searchLocalization", None, "$.searchLocalization", "type"), ("companyAnalysis.more", [], "$.companyAnalysis", "additionalProperties"), ("contactAndOutreach.defaultLanguage", None, "$.contactAndOutreach.defaultLanguage", "type"),
        ("marketId", "sa", "$.marketId", "market of its folder"),
        *texts_cases("searchLocalization", POLICY["searchLocalization"]), *texts_cases("companyAnalysis", POLICY["companyAnalysis"]), *texts_cases("contactAndOutreach", ["preferredContactTerms", "validationNotes", "etiquette"]),
    ]),
    (rules.PROFILE, None, PROFILE, [
        *[(k, GONE, f"$.{k}", "required") for k in PROFILE], *[(k, 7, f"$.{k}", "type") for k in PROFILE], *[(k, " ", f"$.{k}", "pattern") for k in ("displayName", "shortName", "location", "googleDomain")],
        ("id", "Ae", "$.id", "pattern"), ("gl", "AE", "$.gl", "pattern"), ("phoneCountryCode", "ae", "$.phoneCountryCode", "pattern"), ("callingCode", "971", "$.callingCode", "pattern"), ("callingCode", "+97101", "$.callingCode", "pattern"),
        ("domainSuffix", "ae", "$.domainSuffix", "pattern"), ("cities", [], "$.cities", "minItems"), ("aliases", [], "$.aliases", "minItems"), ("defaultHl", "", "$.defaultHl", "minLength"), ("countryNameAliases", "x", "$.countryNameAliases", "type"), ("extra", 1, "$", "additionalProperties"),
    ]),
    (rules.STRATEGY, rules.strategy_fields, STRATEGY, [
        ("schemaVersion", 3, "$.schemaVersion", "enum"), ("product", "", "$.product", "minLength"), ("objective", GONE, "$.objective", "required"), ("targetCustomer.businessRoles", [], "$.targetCustomer.businessRoles", "minItems"),
        ("targetCustomer.businessRoles", ["Importer", "Thief"], "$.targetCustomer.businessRoles[*]", "enum"), ("search.requiredKeywords", [], "$.search.requiredKeywords", "minItems"), ("marketPolicyRef", GONE, "$.marketPolicyRef", "required from version 2"), ("marketPolicyRef.marketId", "sa", "$.marketPolicyRef.marketId", "market of the country"),
    ]),
]


@pytest.mark.parametrize(("schema", "fields", "base", "cases"), CASES, ids=["policy", "profile", "strategy"])
def test_each_rule_is_told_once_it_is_broken(spark, schema, fields, base, cases):
    docs = [json.dumps(base)] + [json.dumps(broken(base, p, v)) for p, v, _, _ in cases] + ["no json", None, "[]"]
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "k long, doc string, path string")
    got = {}
    for r in rules.entity_violations(df, "k", "doc", schema, fields).collect():
        got.setdefault(r.k, []).append((r.path, r.rule))
    assert 0 not in got
    for i, (_, _, path, rule) in enumerate(cases, 1):
        assert got.get(i) == [(path, rule)], (cases[i - 1], got.get(i))
    assert got[len(docs) - 3] == [("$", "json")] and got[len(docs) - 1][0] == ("$", "type")
    assert rules.entity_violations(df.limit(0), "k", "doc", schema, fields).count() == 0


def test_versions_of_a_strategy_and_unknown_words(spark):
    first = broken(broken(STRATEGY, "schemaVersion", 1), "marketPolicyRef", GONE)
    df = spark.createDataFrame([(1, json.dumps(first))], "k long, doc string")
    assert rules.entity_violations(df, "k", "doc", rules.STRATEGY, rules.strategy_fields).count() == 0
    with pytest.raises(ValueError, match="maxLength"):
        rules.compile_schema({"type": "string", "maxLength": 3})
    ref = {"$defs": {"n": {"type": "integer", "minimum": 1, "maximum": 3}}, "properties": {"x": {"$ref": "#/$defs/n"}, "y": {"type": ["string", "null"]}}}
    rows = [('{"x":2,"y":null}', []), ('{"x":2.5}', ["type"]), ('{"x":0}', ["minimum"]), ('{"x":4,"y":1}', ["maximum", "type"]), ('{"x":true}', ["type"])]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(rows)], "k long, doc string")
    got = rules.entity_violations(df, "k", "doc", ref).collect()
    assert [sorted(r.rule for r in got if r.k == i) for i in range(len(rows))] == [w for _, w in rows]


def test_only_named_versions_are_opened(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    hashed = lambda d: hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    sa = broken(POLICY, "marketId", "sa")
    versions = [("ae", "v1", json.dumps(POLICY, indent=1).replace("\n", " ")), ("ae", "v2", json.dumps(sa)), ("sa", "v1", json.dumps(sa)), ("kw", "v1", "no json")]
    manifests = [("ae", "v1", hashed(POLICY)), ("sa", "v1", "other"), ("kw", "v1", "h"), ("qa", "v7", "h")]
    m, v = spark.createDataFrame(manifests, "market string, version string, hash string"), spark.createDataFrame(versions, "market string, version string, json string")
    policies.write_policies(v, m, root)
    # Files that no reader could open, under versions that no manifest names.
    for market, version in (("ae", "v9"), ("ae", "v7"), ("qa", "v1")):
        folder = Path(tmp_path) / "p" / "versions" / f"market={market}" / f"version={version}"
        folder.mkdir(parents=True)
        (folder / "part.txt.gz").write_bytes(b"this is no archive")
    active = policies.active_policies(spark, root)
    got = {r.market: r for r in active.collect()}
    assert {k: (r.version, r.json is not None) for k, r in got.items()} == {"ae": ("v1", True), "sa": ("v1", True), "kw": ("v1", True), "qa": ("v7", False)}
    assert {r.file.split("/versions/")[1].rsplit("/", 1)[0] for r in got.values() if r.file} == {"market=ae/version=v1", "market=sa/version=v1", "market=kw/version=v1"}
    problems = lambda manifests: sorted(tuple(r) for r in policies.policy_problems(manifests, active.where("json is not null")).collect())
    assert problems(m) == [("kw", "v1", "json"), ("qa", "v7", "missing"), ("sa", "v1", "hash")]
    wrong = spark.createDataFrame([("ae", "v2", hashed(sa)), ("ae", "v2", "h")], "market string, version string, hash string")
    assert sorted(tuple(r) for r in policies.policy_problems(wrong, v).collect()) == [("ae", "v2", "hash"), ("ae", "v2", "market"), ("ae", "v2", "market")]


def test_redaction_makes_each_level_once_and_is_dealt_out(spark, tmp_path):
    from pyspark.sql import functions as F

    from leadspark.functions import nested
    from leadspark.plans import QUERIES

    plan = spark.range(1).select(nested.redact_json(F.col("id").cast("string")).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("schema_of_variant") <= nested.REDACTED_DEPTH + 1
    spark.range(200).select(F.col("id").alias("c_custkey"), F.lit("Customer#1").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit("X").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = QUERIES["redact_nested"](spark, str(tmp_path)).withColumn("p", F.spark_partition_id())
    assert rows.select("p").distinct().count() > 1 and rows.count() == 200
    text = '{"b":[{"api_key":1,"x":"a@b.example"},[],{},null,"7"],"a":1.5}'
    got = spark.createDataFrame([(text,), ("no json",), (None,), ("[]",)], "t string").select(nested.redact_json(F.col("t")).alias("r")).collect()
    assert got[0].r == '{"b":[{"api_key":"[REDACTED]","x":"a***@b.example"},[],{},null,"7"],"a":1.5}' and got[2].r is None and got[3].r == "[]"
