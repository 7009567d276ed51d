"""Ordered domains: severity and confidence as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
#: Fixed values.
SEVERITY_WEIGHT = {"CRITICAL": 10.0, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 2.5, "INFO": 0.5}
SEVERITY_RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
SEVERITY_BASE = {"CRITICAL": 40.0, "HIGH": 30.0, "MEDIUM": 20.0, "LOW": 10.0, "INFO": 2.0}
CONFIDENCE_MULTIPLIER = {"CONFIRMED": 1.0, "HIGH": 1.0, "MEDIUM": 0.8, "LOW": 0.5, "UNKNOWN": 0.2}
CONFIDENCE_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
REACHABILITY_BONUS = {"REACHABLE": 20.0, "STATIC_REACHABILITY": 15.0, "UNREACHABLE": -10.0}
EXPOSURE_BONUS = {"INTERNET_FACING": 20.0, "AUTHENTICATED": 10.0, "INTERNAL": 5.0}
FLOW_CATEGORIES = ("TAINT", "INJECTION", "CODE_INJECTION")
CRITICAL_PATHS = ("auth", "security", "payment", "api", "infra")


def lookup(c: Column, table: dict, default) -> Column:
    """A value of a small fixed table as a CASE."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def severity_weight(c: Column) -> Column:
    return lookup(c, SEVERITY_WEIGHT, 0.0)


def severity_rank(c: Column) -> Column:
    return lookup(c, SEVERITY_RANK, 0)


def confidence_multiplier(c: Column) -> Column:
    return lookup(c, CONFIDENCE_MULTIPLIER, 0.2)


def is_flow(category: Column) -> Column:
    return category.isin(*FLOW_CATEGORIES)
