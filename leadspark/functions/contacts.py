"""Contacts: patterns, roles, checks, confidence and rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import registrable

# What counts as an email address and as a phone number.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+\d{1,3}[\s().-]*)?(?:\d[\s().-]*){8,14}\d"
EMAIL_PARTS = r"(?i)^([A-Z0-9._%+-]+)@([A-Z0-9.-]+\.[A-Z]{2,})$"
# Words that tell who answers, first match first.
ROLES = (("sales", "sales|trade|commercial|export|wholesale"), ("support", "help|support|service"), ("general", "info|contact|office|general"))


def role(value: Column, nearby: Column) -> Column:
    """Who answers at a contact, by its address and the text around it."""
    text = F.lower(F.concat(value, F.lit(" "), F.coalesce(nearby, F.lit(""))))
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in ROLES], F.lit("unknown"))


def email_domain(value: Column) -> Column:
    """The lower-case domain of a valid address, else null."""
    found = F.lower(F.regexp_extract(value, EMAIL_PARTS, 2))
    return F.when(found != "", found)


def same_domain(found: Column, company: Column) -> Column:
    """Whether an email's domain and a company's belong to one registrable domain; false where there is none."""
    return F.coalesce(registrable(found) == registrable(company), F.lit(False))


def weighted(*parts: tuple[Column, float]) -> Column:
    """Sum of the weights of true parts, in their order, at most 1."""
    total = F.lit(0.0)
    for condition, weight in parts:
        total = total + F.when(F.coalesce(condition, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), total)


# Fixed values below: the weights of confidence, rank and label.
def email_confidence(syntax: Column, mx: Column, same_domain: Column, who: Column) -> Column:
    return weighted((syntax, 0.25), (mx, 0.25), (same_domain, 0.35), (who == "sales", 0.15))


def phone_confidence(parsed: Column, in_country: Column, who: Column, kind: Column) -> Column:
    return weighted((parsed, 0.25), (in_country, 0.55), ((who == "sales") | (kind == "whatsapp"), 0.2))


def rank(value: Column, kind: Column, confidence: Column, same_domain: Column, mx: Column, in_country: Column, who: Column) -> Column:
    """Order of contacts within a company; higher is better."""
    add = lambda condition, n: F.when(F.coalesce(condition, F.lit(False)), F.lit(n)).otherwise(F.lit(0))
    local = F.lower(F.substring_index(value, "@", 1))
    return (
        F.coalesce(confidence, F.lit(0.0)) * 10
        + add(same_domain, 8)
        + add(mx, 2)
        + add(in_country, 2)
        + add(who == "sales", 6)
        + add(who == "general", 3)
        + add(local.rlike("sales|trade|commercial|export|procurement"), 4)
        + add(kind == "email", 2)
    )


def public_label(value: Column, nearby: Column) -> Column:
    """struct(label, confidence) that a contact is shown with."""
    local = F.lower(F.substring_index(value, "@", 1))
    sales = F.concat(local, F.lit(" "), F.lower(F.coalesce(nearby, F.lit("")))).rlike("sales|trade|commercial|export")
    support = local.rlike("help|support|service")
    label = F.when(sales, "sales").when(support, "support").otherwise("public")
    return F.struct(label.alias("label"), F.when(sales, 0.96).when(support, 0.58).otherwise(0.82).alias("confidence"))
