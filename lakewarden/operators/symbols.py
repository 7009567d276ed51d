"""Names that modules hand on: what a dotted name finally means.

``bindings(name, target)``: the dotted name of a module's import and what it imports; "module.*" stands for a star import.
Of several bindings of a name the explicit one counts before those by star, as the later import hides the earlier in a
package's ``__init__`` only where both are explicit (then the smallest target stands). Chains are cut by pointer doubling, so a
name handed on n times takes log n joins; names that lead in a ring stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _count, _cut


def final_bindings(bindings: DataFrame, names: DataFrame) -> DataFrame:
    """name -> target, where each target is bound no further; ``names(name)`` are what star imports can find."""
    b = bindings.where("name is not null and target is not null and name <> target").distinct()
    exact = b.where("name not like '%*'").groupBy("name").agg(F.min("target").alias("target"))
    stars = _cut(b.where("name like '%*'").select(F.regexp_replace("name", r"\*$", "").alias("into"), F.concat("target", F.lit(".")).alias("from")))
    # what a star import brings: public names of the module, defined or imported there; star imports of star imports in rounds
    public = _cut(names.select("name").union(exact.select("name")).distinct())
    star = None
    fresh = public
    while not stars.isEmpty():
        parts = fresh.select("name", F.regexp_extract("name", r"^(.*\.)?([^.]+)$", 1).alias("from"), F.regexp_extract("name", r"^(.*\.)?([^.]+)$", 2).alias("last")).where("last not like '\\_%'")
        got = parts.join(stars, "from").select(F.concat("into", "last").alias("name"), F.col("name").alias("target")).groupBy("name").agg(F.min("target").alias("target"))
        got = _cut(got.join(public, "name", "left_anti"))  # explicit names hide those by star
        if got.isEmpty():
            break
        star = got if star is None else star.union(got)
        fresh = got.select("name")
        public = _cut(public.union(fresh))
    links = _cut(exact if star is None else exact.union(star))
    left = links.count()
    while left:
        nxt = links.select(F.col("name").alias("target"), F.col("target").alias("next"))
        links = _cut(links.join(nxt, "target", "left").select("name", F.coalesce("next", "target").alias("target")).where("name <> target"))
        still = _count(links.join(links.select(F.col("name").alias("target")), "target", "left_semi"))
        if still in (0, left):
            break
        left = still
    return links


def resolve_names(asked: DataFrame, bindings: DataFrame, names: DataFrame) -> DataFrame:
    """``asked`` with ``resolved``: its name's final meaning, where a prefix of up to three parts from the end is bound."""
    links = final_bindings(bindings, names)
    out = asked.select(F.col("name").alias("n0")).distinct()
    found = None
    for cut in range(3):
        head, rest = (F.regexp_extract("n0", rf"^(.+?)((?:\.[^.]+){{{cut}}})$", g) for g in (1, 2))
        hit = out.select("n0", head.alias("name"), rest.alias("rest")).join(links, "name").select("n0", F.lit(cut).alias("cut"), F.concat("target", "rest").alias("resolved"))
        found = hit if found is None else found.union(hit)
    best = found.groupBy("n0").agg(F.min(F.struct("cut", "resolved")).alias("b")).select("n0", "b.resolved")
    return asked.join(best, F.col("name") == F.col("n0"), "left").withColumn("resolved", F.coalesce("resolved", "name")).drop("n0")
