"""Quality rules over tables: violations, repairs, merges and checks, each a set of rows instead of an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (country, calling code, trunk prefix, shortest and longest national number).
NUMBERING = (
    ("AE", "971", "0", 8, 9), ("AR", "54", "0", 10, 11), ("AT", "43", "0", 7, 12), ("AU", "61", "0", 9, 9), ("BD", "880", "0", 8, 10), ("BE", "32", "0", 8, 9), ("BH", "973", "", 8, 8), ("BR", "55", "0", 10, 11), ("CA", "1", "1", 10, 10), ("CH", "41", "0", 9, 9),
    ("CL", "56", "", 9, 9), ("CN", "86", "0", 10, 11), ("CO", "57", "", 8, 10), ("CZ", "420", "", 9, 9), ("DE", "49", "0", 6, 11), ("DK", "45", "", 8, 8), ("DZ", "213", "0", 8, 9), ("EG", "20", "0", 8, 10), ("ES", "34", "", 9, 9), ("FI", "358", "0", 6, 10),
    ("FR", "33", "0", 9, 9), ("GB", "44", "0", 9, 10), ("GR", "30", "", 10, 10), ("HU", "36", "06", 8, 9), ("ID", "62", "0", 8, 12), ("IE", "353", "0", 8, 9), ("IN", "91", "0", 10, 10), ("IQ", "964", "0", 8, 10), ("IR", "98", "0", 10, 10), ("IT", "39", "", 6, 11),
    ("JO", "962", "0", 8, 9), ("JP", "81", "0", 9, 10), ("KE", "254", "0", 9, 9), ("KR", "82", "0", 8, 10), ("KW", "965", "", 8, 8), ("KZ", "7", "8", 10, 10), ("LB", "961", "0", 7, 8), ("MA", "212", "0", 9, 9), ("MX", "52", "", 10, 10), ("MY", "60", "0", 8, 10),
    ("NG", "234", "0", 8, 10), ("NL", "31", "0", 9, 9), ("NO", "47", "", 8, 8), ("NZ", "64", "0", 8, 10), ("OM", "968", "", 8, 8), ("PH", "63", "0", 8, 10), ("PK", "92", "0", 9, 10), ("PL", "48", "", 9, 9), ("PT", "351", "", 9, 9), ("QA", "974", "", 8, 8),
    ("RO", "40", "0", 9, 9), ("RU", "7", "8", 10, 10), ("SA", "966", "0", 8, 9), ("SE", "46", "0", 7, 9), ("SG", "65", "", 8, 8), ("TH", "66", "0", 8, 9), ("TN", "216", "", 8, 8), ("TR", "90", "0", 10, 10), ("UA", "380", "0", 9, 9), ("US", "1", "1", 10, 10),
    ("VN", "84", "0", 9, 10), ("YE", "967", "0", 7, 9), ("ZA", "27", "0", 9, 9),
)
# Area codes of countries that share the calling code of another one, which has all the rest.
SHARED = {
    "CA": (204, 226, 236, 249, 250, 289, 306, 343, 365, 403, 416, 418, 431, 437, 438, 450, 506, 514, 519, 548, 579, 581, 587, 604, 613, 639, 647, 672, 705, 709, 778, 780, 782, 807, 819, 825, 867, 873, 902, 905),
    "KZ": (6, 7),
}


def number_prefixes(numbering: tuple = NUMBERING, shared: dict = SHARED) -> dict[str, str]:
    """Country by the leading digits of its international numbers; the longest that fits counts."""
    out = {code: iso for iso, code, *_ in numbering if iso not in shared}
    codes = {iso: code for iso, code, *_ in numbering}
    return out | {f"{codes[iso]}{area}": iso for iso, areas in shared.items() for area in areas}


def rule_violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule): every rule that a row fails; a rule is a condition that must hold."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(failed).alias("rule"))


def validate_phones(found: DataFrame) -> DataFrame:
    """found(value, iso, ...) with valid, e164, country and in_country, by the numbering plan.

    A number that begins with + or 00 tells its country by the longest prefix that
    fits; any other is one of the country iso, less its trunk prefix. valid says
    whether the national number has a length of its country, in_country whether
    that is iso. Without a known country all but in_country are null; a value
    without digits is not valid. The plan is of fixed size and stands in the
    expression, so no row is moved.
    """
    prefixes = number_prefixes()
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    of, codes, trunks = table(prefixes.items()), table((i, c) for i, c, *_ in NUMBERING), table((i, t) for i, _, t, *_ in NUMBERING)
    least, most = table((i, lo) for i, *_, lo, _ in NUMBERING), table((i, hi) for i, *_, hi in NUMBERING)
    abroad = F.trim("value").rlike(r"^(\+|00)")
    own = found.withColumn("__d", F.regexp_replace("value", r"\D", "")).withColumn("__abroad", abroad)
    own = own.withColumn("__d", F.when(F.col("__abroad"), F.regexp_replace("__d", "^00", "")).otherwise(F.col("__d")))
    told = F.coalesce(*[F.try_element_at(of, F.substring("__d", 1, n)) for n in range(max(map(len, prefixes)), 0, -1)])
    own = own.withColumn("country", F.when(F.col("__abroad"), told).when(F.try_element_at(codes, F.col("iso")).isNotNull(), F.col("iso")))
    code, trunk = F.try_element_at(codes, F.col("country")), F.try_element_at(trunks, F.col("country"))
    inland = F.when((trunk != "") & F.startswith("__d", trunk), F.substr("__d", F.length(trunk) + 1)).otherwise(F.col("__d"))
    own = own.withColumn("__n", F.when(F.col("__abroad"), F.substr("__d", F.length(code) + 1)).otherwise(inland))
    size = F.length("__n")
    valid = size.between(F.try_element_at(least, F.col("country")), F.try_element_at(most, F.col("country")))
    own = own.withColumn("valid", F.when(F.col("__abroad") & F.col("country").isNull(), F.lit(False)).otherwise(valid))
    own = own.withColumn("e164", F.when(F.col("valid"), F.concat(F.lit("+"), code, F.col("__n")))).withColumn("in_country", F.coalesce(F.col("valid") & (F.col("country") == F.col("iso")), F.lit(False)))
    return own.drop("__d", "__abroad", "__n")


def submission_violations(leads: DataFrame, facts: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(lead, rule, detail): all faults of submissions at once.

    leads(lead, company, fit, scale, confidence, reviewed), facts(lead, company, id,
    ref), refs(lead, ref) that the qualification names, chunks(company, ref).
    """
    scores = rule_violations(
        leads.withColumn("detail", F.concat_ws("/", "fit", "scale", "confidence")),
        ["lead", "detail"],
        {
            "score_range": F.col("fit").between(0, 100) & F.col("scale").between(0, 100),
            "confidence_range": F.col("confidence").between(0.0, 1.0),
            "review_required": (F.col("confidence") >= 0.8) | F.col("reviewed"),
        },
    ).select("lead", "rule", "detail")
    missing = facts.join(chunks.hint("merge"), ["company", "ref"], "left_anti").select("lead", F.lit("unknown_chunk").alias("rule"), F.col("ref").alias("detail"))
    twice = facts.groupBy("lead", "id").agg(F.count("*").alias("n")).where("n > 1").select("lead", F.lit("duplicate_id").alias("rule"), F.col("id").alias("detail"))
    loose = refs.join(facts.hint("merge"), ["lead", "ref"], "left_anti").select("lead", F.lit("missing_fact").alias("rule"), F.col("ref").alias("detail")).distinct()
    none = leads.join(facts.hint("merge"), "lead", "left_anti").select("lead", F.lit("no_evidence").alias("rule"), F.lit("").alias("detail"))
    return scores.unionByName(missing).unionByName(twice).unionByName(loose).unionByName(none)


def submission_v1_violations(submissions: DataFrame, chosen: DataFrame, contacts: DataFrame, facts: DataFrame, chunks: DataFrame, uses: DataFrame) -> DataFrame:
    """(lead, rule, detail): all faults of submissions of the first version at once.

    submissions(lead, company_id, candidate_id, all_read, confidence, qualified,
    reviewed, recommended), chosen(lead, ref) contacts, contacts(lead, ref) that are
    known, facts(lead, id, ref), chunks(lead, ref) that exist, uses(lead, id) that the
    conclusions name. A null recommendation or `none` recommends nobody.
    """
    rows = submissions.withColumn("detail", F.col("candidate_id").cast("string"))
    rules = {
        "pages_unread": F.col("all_read"),
        "company_id": F.col("company_id").eqNullSafe(F.col("candidate_id")),
        "review_required": ((F.col("confidence") >= 0.8) & F.col("qualified")) | F.col("reviewed"),
    }
    own = rule_violations(rows, ["lead", "detail"], rules).select("lead", "rule", "detail")
    fault = lambda df, rule, c: df.select("lead", F.lit(rule).alias("rule"), F.col(c).cast("string").alias("detail"))
    strangers = fault(chosen.join(contacts.select("lead", "ref").hint("merge"), ["lead", "ref"], "left_anti"), "unknown_contact", "ref")
    twice = fault(facts.groupBy("lead", "id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_id", "id")
    nowhere = fault(facts.join(chunks.select("lead", "ref").hint("merge"), ["lead", "ref"], "left_anti"), "unknown_chunk", "ref")
    loose = fault(uses.select("lead", "id").distinct().join(facts.select("lead", "id").hint("merge"), ["lead", "id"], "left_anti"), "unknown_id", "id")
    named = submissions.where("recommended <> 'none'").select("lead", F.col("recommended").alias("ref"))
    known = chosen.select("lead", "ref").join(contacts.select("lead", "ref").hint("merge"), ["lead", "ref"], "left_semi")
    nobody = fault(named.join(known.hint("merge"), ["lead", "ref"], "left_anti"), "recommended_contact", "ref")
    return own.unionByName(strangers).unionByName(twice).unionByName(nowhere).unionByName(loose).unionByName(nobody)


def repair_submissions(facts: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """facts with those that refs name but facts lack, filled from chunks; the kind follows the strongest use."""
    kind = F.when(F.bool_or(F.col("use") == "scale"), "scale").when(F.bool_or(F.col("use") == "product"), "product").when(F.bool_or(F.col("use") == "role"), "business_role").otherwise("product")
    missing = refs.groupBy("lead", "company", "ref").agg(kind.alias("kind")).join(facts.select("lead", "ref").hint("merge"), ["lead", "ref"], "left_anti")
    filled = missing.join(chunks.hint("merge").select("company", "ref", F.substring("text", 1, 200).alias("value")), ["company", "ref"])
    filled = filled.select("lead", "company", "ref", "kind", "value", F.lit(0.75).alias("confidence"), F.lit(True).alias("repaired"))
    return facts.withColumn("repaired", F.lit(False)).unionByName(filled)


def violation_hints(violations: DataFrame, hints: DataFrame) -> DataFrame:
    """(lead, hint): distinct hints for the rules that a submission failed."""
    return violations.hint("merge").join(hints, "rule").select("lead", "hint").distinct()


def merge_patch(current: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """current with the patch's values where it has any; a patched row gets the next version and loses its approval."""
    p = patch.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__patched"))
    both = current.join(p, key, "left")
    changed = F.col("__patched").isNotNull()
    return both.select(
        key,
        *[F.coalesce(f"__{f}", f).alias(f) for f in fields],
        (F.col("version") + F.when(changed, 1).otherwise(0)).alias("version"),
        F.when(~changed, F.col("approved_hash")).alias("approved_hash"),
    )


def mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field): where two tables of the same key disagree; a row missing at the right disagrees in all fields."""
    r = right.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    both = left.join(r, key, "left")
    differs = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return both.select(key, F.explode(differs).alias("field"))


def first_match(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def consistency_violations(leads: DataFrame, facts: DataFrame, uses: DataFrame, contacts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(lead, rule): submissions that claim what no fact or contact of theirs supports.

    leads(lead, company, name, role, imports, fit, scale, confidence, qualified, risks,
    recommended), facts(lead, ref, kind), uses(lead, ref) that the qualification
    names, contacts(company, ref) that are known, chosen(lead, ref) that the
    submission lists. A null name, role, import capability or recommendation claims
    nothing.
    """
    kinds = facts.groupBy("lead").agg(F.bool_or(F.col("kind") == "identity").alias("has_name"))
    used = facts.join(uses.hint("merge"), ["lead", "ref"], "left_semi").groupBy("lead")
    used = used.agg(*[F.bool_or(F.col("kind") == k).alias(f"uses_{k}") for k in ("product", "business_role", "scale")])
    own = chosen.join(leads.select("lead", "company", "recommended").hint("merge"), "lead")
    known = own.join(contacts.select("company", "ref", F.lit(True).alias("known")).distinct().hint("merge"), ["company", "ref"], "left")
    picked = known.groupBy("lead").agg(F.bool_or(F.col("known").isNull()).alias("stranger"), F.bool_or(F.col("known") & (F.col("ref") == F.col("recommended"))).alias("recommends"))
    rows = leads.join(kinds.hint("merge"), "lead", "left").join(used.hint("merge"), "lead", "left").join(picked.hint("merge"), "lead", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = {
        "identity_fact": F.col("name").isNull() | has("has_name"),
        "role_fact": F.col("role").isNull() | has("uses_business_role"),
        "import_fact": F.col("imports").isNull() | has("uses_scale"),
        "fit_fact": (F.col("fit") <= 0) | has("uses_product"),
        "scale_fact": (F.col("scale") <= 0) | has("uses_scale"),
        "unknown_contact": ~has("stranger"),
        "risk_required": ((F.col("confidence") >= 0.8) & F.col("qualified")) | (F.col("risks") > 0),
        "recommended_contact": F.col("recommended").isNull() | has("recommends"),
    }
    return rule_violations(rows, ["lead"], rules)
