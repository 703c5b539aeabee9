"""Log records: redaction, failure classes and access filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is secret or transient in a record.
SENSITIVE_KEY = r"(?i)(?:api[_-]?key|authorization|password|secret|access[_-]?token|refresh[_-]?token|cookie|private[_-]?key)"
SECRET = r"(?i)\b(?:sk|pk|key|token)[-_][A-Za-z0-9._-]{10,}\b"
ADDRESS = r"(?i)\b([A-Z0-9._%+-])[^@\s]*@([A-Z0-9.-]+\.[A-Z]{2,})\b"
NUMBER = r"(?<!\d)(\+?\d[\d\s().-]{7,}\d)(?!\d)"
TRANSIENT = r"(?i)(?:408|425|429|500|502|503|504|rate.?limit|timeout|timed out|temporar|overload|econn|enet|eai_again|getaddrinfo|name resolution|fetch failed|network|socket|aborted?|超时|域名解析|服务暂不可用)"
LONGEST = 4000


def redact_words(c: Column) -> Column:
    """Secrets as a mark, addresses as first letter and domain."""
    return F.regexp_replace(F.regexp_replace(c, SECRET, "[REDACTED_TOKEN]"), ADDRESS, "$1***@$2")


def redact_numbers(c: Column) -> Column:
    """Phone numbers as *** and their last four digits."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1)))
    digits = lambda p: F.regexp_replace(p, r"\D", "")
    return F.aggregate(found, c, lambda text, p: F.when(F.length(digits(p)) >= 8, F.replace(text, p, F.concat(F.lit("***"), F.right(digits(p), F.lit(4))))).otherwise(text))


def shorten(c: Column) -> Column:
    return F.when(F.length(c) > LONGEST, F.concat(F.substring(c, 1, LONGEST), F.lit("…[truncated:"), F.length(c).cast("string"), F.lit("]"))).otherwise(c)


def redact(c: Column) -> Column:
    return shorten(redact_numbers(redact_words(c)))


def redact_map(m: Column) -> Column:
    """A map's values redacted, those of sensitive keys hidden; at most 100 entries are kept."""
    first = F.map_from_entries(F.slice(F.map_entries(m), 1, 100))
    return F.transform_values(first, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit("[REDACTED]")).otherwise(redact(v)))


def is_transient(message: Column) -> Column:
    return message.rlike(TRANSIENT)


def failure_kind(error_name: Column, trace_status: Column, message: Column) -> Column:
    """Class of a failed analysis, the first that holds."""
    return (
        F.when(error_name == "CompanyAnalysisValidationError", "validation")
        .when(error_name == "OperationTimeoutError", "timeout")
        .when(trace_status == "budget_exhausted", "budget_exhausted")
        .when(message.rlike("(?i)terminated"), "terminated")
        .when(is_transient(message), "transient")
        .otherwise("unknown")
    )


def keeps_access(method: Column, path: Column, poll: Column, status: Column) -> Column:
    """Whether a request belongs in the access log: API calls, except successful status polls."""
    polls = (F.upper(method) == "GET") & ((path == "/api/health") | path.rlike(r"^/api/orchestrator/sessions/[^/]+/activity$") | (F.coalesce(poll, F.lit("")) == "1"))
    return path.startswith("/api/") & ((F.coalesce(status, F.lit(0)) >= 400) | ~polls)
