"""Egress guard: may a query leave for an outside service?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import has, python


class EgressError(ValueError):
    pass


def verdict(query: Column, strict: bool = True) -> Column:
    """token, raw_pii or clean. strict also knows scoped tokens and case numbers."""
    raw = F.lit(False)
    for pattern in fixed.RAW_PII:
        raw = raw | has(query, pattern)
    return F.when(has(query, fixed.STRICT_PII_TOKEN if strict else fixed.PII_TOKEN), "token").when(raw, "raw_pii").otherwise("clean")


def assert_safe(query: str, strict: bool = True) -> None:
    """For a single query on the driver, before any connector is called."""
    if python(fixed.STRICT_PII_TOKEN if strict else fixed.PII_TOKEN).search(query):
        raise EgressError("the query holds a de-identification token")
    if any(python(p).search(query) for p in fixed.RAW_PII):
        raise EgressError("the query likely holds personal data")
