"""Package names, semantic versions and licences as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order of precedence.
LICENSES = (
    ("DENY", ("GPL-3.0", "AGPL-3.0", "SSPL-1.0")),
    ("REVIEW_REQUIRED", ("GPL-2.0", "LGPL-3.0", "MPL-2.0", "EPL-2.0")),
    ("ALLOW", ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Unlicense", "CC0-1.0")),
)


def normalised(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), "[-_.]+", "-"))


def version_key(v: Column) -> Column:
    """(major, minor, patch, release?, pre-release): compares as versions do; missing parts are 0.

    A pre-release is its runs of digits and letters: numbers by value, before letters.
    """
    core = F.split(F.regexp_replace(F.split_part(F.split_part(v, F.lit("-"), F.lit(1)), F.lit("+"), F.lit(1)), "^[vV=]+", ""), r"\.")
    part = lambda i: F.coalesce(F.try_element_at(core, F.lit(i)).try_cast("int"), F.lit(0))
    pre = F.regexp_extract(v, r"^[^-]*-([^+]*)", 1)
    run = lambda p: F.struct(p.try_cast("decimal(38,0)").isNull().alias("text"), p.try_cast("decimal(38,0)").alias("number"), p.alias("name"))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").alias("release"), F.transform(F.regexp_extract_all(pre, F.lit("([0-9]+|[A-Za-z]+)"), 1), run).alias("pre"))


def satisfies(v: Column, constraint: Column) -> Column:
    """Comma-joined comparisons (>=, <=, >, <, ==, =, !=), ^ and ~ ranges; empty or * fits all."""
    key = version_key(v)

    def one(c: Column) -> Column:
        c = F.trim(c)
        op = F.regexp_extract(c, r"^([<>=!^~]*)", 1)
        want = version_key(F.trim(F.regexp_replace(c, r"^[<>=!^~]+", "")))
        return (
            F.when((c == "") | (c == "*"), F.lit(True))
            .when(op == ">=", key >= want)
            .when(op == "<=", key <= want)
            .when(op == ">", key > want)
            .when(op == "<", key < want)
            .when(op == "!=", key != want)
            .when(op == "^", (key >= want) & (key["major"] == want["major"]) & ((want["major"] > 0) | (key["minor"] == want["minor"])))
            .when(op.isin("~", "~="), (key >= want) & (key["major"] == want["major"]) & (key["minor"] == want["minor"]))
            .otherwise(key == want)
        )

    return F.exists(F.split(constraint, r"\|\|"), lambda alt: F.forall(F.split(alt, ","), one))


def license_action(lic: Column) -> Column:
    """First tier one of whose names the licence contains; unknown needs review."""
    text = F.upper(F.trim(lic))
    out = F.when(lic.isNull() | text.isin("", "UNKNOWN"), F.lit("REVIEW_REQUIRED"))
    for action, names in LICENSES:
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(text, F.lit(n.upper()))
        out = out.when(hit, F.lit(action))
    return out.otherwise(F.lit("REVIEW_REQUIRED"))


def is_typosquat(a: Column, b: Column) -> Column:
    """Lengths at most one apart and exactly one unlike place among the common ones."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    unlike = F.size(F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return (a != b) & (F.abs(F.length(a) - F.length(b)) <= 1) & (unlike == 1)
