"""Pluggable company scoring: a user's function over batches, failures kept apart from results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def score_companies(companies: DataFrame, scorer: Callable[[dict], dict], key: str, fields: dict[str, str], retries: int = 2) -> DataFrame:
    """(key, fields..., status, error, attempts): scorer's answer for each row; a row that still fails after its retries fails alone."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for attempt in range(1, retries + 2):
                    try:
                        out.append({key: row[key], **scorer(row), "status": "ok", "error": None, "attempts": attempt})
                        break
                    except Exception as e:  # a scorer may raise anything; the row carries it
                        if attempt > retries:
                            out.append({key: row[key], **dict.fromkeys(fields), "status": "failed", "error": f"{type(e).__name__}: {e}", "attempts": attempt})
            yield pd.DataFrame(out, columns=[key, *fields, "status", "error", "attempts"])

    kinds = ", ".join(f"{k} {v}" for k, v in fields.items())
    return companies.mapInPandas(run, f"{key} {companies.schema[key].dataType.simpleString()}, {kinds}, status string, error string, attempts int")
