"""Rules as functions from facts to findings: each on its own, so that a broken one takes nothing along."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

Rule = Callable[[dict[str, DataFrame]], DataFrame]


class Catalog:
    """Rules by id, in order of registration, with their category and language."""

    def __init__(self):
        self.rules: dict[str, tuple[Rule, str, str]] = {}

    def rule(self, rule_id: str, category: str = "OTHER", language: str = "UNKNOWN"):
        def register(f: Rule) -> Rule:
            if rule_id in self.rules:
                raise ValueError(f"rule {rule_id} is there already")
            self.rules[rule_id] = (f, category, language)
            return f

        return register

    def evaluate(self, spark: SparkSession, facts: dict[str, DataFrame], folder: str, language: str | None = None) -> tuple[DataFrame | None, DataFrame]:
        """(findings of all rules that ran, or None; a row for each rule: seconds, findings, error).

        A rule's findings are written to the folder as it runs: what fails while running is told apart as well.
        """
        done, rows = [], []
        for rule_id, (f, _, lang) in self.rules.items():
            if language and lang not in ("UNKNOWN", language):
                continue
            began, error, n = time.perf_counter(), None, 0
            try:
                path = f"{folder}/{rule_id}"
                f(facts).write.mode("overwrite").parquet(path)
                out = spark.read.parquet(path)
                n = out.count()
                done.append(out)
            except Exception as e:  # noqa: BLE001  a rule's failure, of whatever kind, is its own row
                error = f"{type(e).__name__}: {e}"[:500]
            rows.append((rule_id, time.perf_counter() - began, n, error))
        found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done) if done else None
        return found, spark.createDataFrame(rows, "rule_id string, seconds double, findings long, error string")
