"""Streams of deliveries: replay protection, newest wins, retries and dead letters."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

MAX_BYTES = 5_000_000


def signed(deliveries: DataFrame, secret: str) -> DataFrame:
    """Deliveries of at most 5 MB whose signature fits; HMAC has no built-in, so batches go to Arrow."""

    @F.pandas_udf("boolean")
    def fits(body: pd.Series, signature: pd.Series) -> pd.Series:
        ok = [b is not None and s is not None and hmac.compare_digest("sha256=" + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest(), s) for b, s in zip(body, signature, strict=True)]
        return pd.Series(ok, dtype=bool)

    return deliveries.where(F.octet_length("body") <= MAX_BYTES).where(fits("body", "signature"))


def parsed(deliveries: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """Deliveries with ``repo``, ``pr``, ``action`` and ``url`` of their JSON body; others than such bodies give none.

    The url must be https and its host one of ``hosts`` or below one; batch and stream alike.
    """
    j = lambda p: F.get_json_object("body", p)
    url = F.coalesce(j("$.repository.clone_url"), j("$.repository.html_url"))
    host = F.lower(F.regexp_extract(url, r"^https://(?:[^/@]*@)?([^/:?#]+)", 1))
    fits = F.lit(False)
    for h in hosts:
        fits = fits | (host == h) | F.endswith(host, F.lit(f".{h}"))
    out = deliveries.where(F.octet_length("body") <= MAX_BYTES).where(fits)
    return out.select("*", j("$.repository.full_name").alias("repo"), j("$.pull_request.number").cast("long").alias("pr"), j("$.action").alias("action"), url.alias("url")).where("repo is not null")


def once(deliveries: DataFrame, key: str, ts: str, within: str = "10 minutes") -> DataFrame:
    """Each delivery id once; state is dropped behind the watermark."""
    return deliveries.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def latest(deliveries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the newest row (``complete`` or ``update`` output); batch and stream alike."""
    rest = [c for c in deliveries.columns if c not in keys]
    return deliveries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window (an extension of this library)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def attempts(jobs: DataFrame, handler, retries: int = 3) -> DataFrame:
    """status DONE or DEAD and the number of attempts of each job row; ``handler(row dict)`` may raise."""
    ship(jobs.sparkSession)
    cols = jobs.columns

    def run(batches):
        for pdf in batches:
            status, tried = [], []
            for r in pdf.to_dict("records"):
                for n in range(1, retries + 1):
                    try:
                        handler(r)
                        status.append("DONE")
                        break
                    except Exception:  # noqa: BLE001  whatever the handler raises counts as a failed attempt
                        if n == retries:
                            status.append("DEAD")
                tried.append(n)
            yield pdf[cols].assign(status=status, attempts=tried)

    return jobs.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in jobs.schema)}, status string, attempts int")
