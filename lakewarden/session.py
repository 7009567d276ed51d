"""What every session needs before Python runs on its executors."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed on them."""
    env = spark.sparkContext.environment
    have = (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    # files go to Python in batches of so many bytes (or one longer file), not of 10,000 of any length
    now = spark.conf.get(BATCH_CONF)
    if not re.fullmatch(r"\d+b", now) or int(now[:-1]) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")
