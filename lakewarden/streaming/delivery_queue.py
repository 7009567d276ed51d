"""A queue of deliveries as keyed state: attempts, retries by timers, dead letters; a newer delivery makes the older obsolete.

``run`` is the stream, whose state survives restarts in its checkpoint; ``replayed`` says the same of a log that is complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.times import micros
from ..session import ship

OPEN, DONE, DEAD, OBSOLETE = "QUEUED", "DONE", "DEAD", "OBSOLETE"
_OUT = "target string, delivery string, status string, attempts int, error string"


class DeliveryQueue(StatefulProcessor):
    """The jobs of one target, by delivery: when it came, its body, status, attempts and when it is due."""

    def __init__(self, handler: Callable[[dict], object], most: int = 3, backoff_ms: int = 60_000, keep_ms: int = 7 * 86_400_000):
        self.handler, self.most, self.backoff, self.keep = handler, most, backoff_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "delivery string", "came long, body string, status string, attempts int, due long", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, told = timerValues.getCurrentProcessingTimeInMs(), []
        new = pd.concat(rows).sort_values(["ts", "delivery"], kind="stable").drop_duplicates("delivery")
        new = [(r.delivery, r.ts.value // 1000, r.body) for r in new.itertuples() if not self.jobs.containsKey((r.delivery,))]  # ids seen before are replays
        if new:
            held = [(d[0], j) for d, j in self.jobs.iterator()]
            newest = max([*((came, d) for d, came, _ in new), *((j[0], d) for d, j in held)])
            for d, j in held:
                if j[2] == OPEN and (j[0], d) != newest:
                    told.append(self._put(key, d, j[0], None, OBSOLETE, j[3], 0))
            for d, came, body in new:
                if (came, d) == newest:
                    told.append(self._attempt(key, d, came, body, 0, now))
                else:
                    told.append(self._put(key, d, came, None, OBSOLETE, 0, 0))
        yield self._frame(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due = [(d[0], j) for d, j in self.jobs.iterator() if j[2] == OPEN and j[4] <= now]
        yield self._frame([self._attempt(key, d, j[0], j[1], j[3], now) for d, j in sorted(due)])

    def close(self) -> None:
        pass

    def _attempt(self, key, delivery, came, body, tried, now):
        try:
            self.handler({"target": key[0], "delivery": delivery, "body": body, "attempt": tried + 1})
        except Exception as e:  # noqa: BLE001  whatever the handler raises is a failed attempt
            if tried + 1 < self.most:
                due = now + self.backoff * 2**tried
                self.handle.registerTimer(due)
                return self._put(key, delivery, came, body, OPEN, tried + 1, due, str(e))
            return self._put(key, delivery, came, None, DEAD, tried + 1, 0, str(e))
        return self._put(key, delivery, came, None, DONE, tried + 1, 0)

    def _put(self, key, delivery, came, body, status, attempts, due, error=None):
        self.jobs.updateValue((delivery,), (came, body, status, attempts, due))
        return key[0], delivery, status, attempts, error

    @staticmethod
    def _frame(rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["target", "delivery", "status", "attempts", "error"]).astype({"attempts": "int32"})


def run(deliveries: DataFrame, handler: Callable[[dict], object], most: int = 3, backoff_ms: int = 60_000, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """A stream of ``deliveries(target, delivery, ts, body)`` as a stream of (target, delivery, status, attempts, error), a row each change.

    A delivery is tried when it comes and, while ``handler(dict)`` raises, again after ``backoff_ms``, twice that and so on, ``most`` times in
    all: DONE, or DEAD with the last error; between attempts it is QUEUED. A newer delivery of its target (by time, then id) makes a queued one
    OBSOLETE, also if it comes late; finished ones stay. An id that was seen within ``keep_ms`` is a replay and gives nothing; bodies are dropped
    with the end of a job, the rest of its state ``keep_ms`` after its last change. Rows without a target, id or time are dropped.
    The handler runs at least once an attempt: after a lost executor a batch's attempts run again, from the state before it. Needs the RocksDB state store.
    """
    ship(deliveries.sparkSession)
    rows = deliveries.where("target is not null and delivery is not null and ts is not null").select(F.col("target").cast("string").alias("target"), F.col("delivery").cast("string").alias("delivery"), "ts", F.col("body").cast("string").alias("body"))
    return rows.groupBy("target").transformWithStateInPandas(DeliveryQueue(handler, most, backoff_ms, keep_ms), _OUT, "Update", "ProcessingTime")


def replayed(deliveries: DataFrame, most: int = 3, backoff_s: int = 600, slice_s: int = 86_400) -> DataFrame:
    """(target, delivery, status, attempts) of a whole log ``deliveries(target, delivery, ts, fails)``, where the first ``fails`` attempts fail.

    An attempt takes no time. A delivery that isn't finished when the next of its target comes (by time, then id) is OBSOLETE; an attempt at that
    very instant isn't made. Of a repeated id the first counts; rows without a target, id or time are dropped, ``fails`` null is none.
    Only what comes within a delivery's life can change it, so a target's rows are dealt into slices of time, each with the beginning of the
    next: a busy target is many tasks. ``slice_s`` is raised to the longest life where it is less.
    """
    waits = [backoff_s * (2**n - 1) for n in range(most)]  # seconds from arrival to each attempt
    life = waits[-1]
    width = max(slice_s, life + 1)
    d = deliveries.where("target is not null and delivery is not null and ts is not null")
    d = d.groupBy("delivery").agg(F.min(F.struct(micros(deliveries, "ts").alias("us"), "target", F.greatest(F.coalesce("fails", F.lit(0)), F.lit(0)).cast("long").alias("fails"))).alias("r")).select("delivery", "r.*")
    own = F.floor(F.col("us") / (width * 1_000_000)).cast("long")
    early = F.col("us") - own * (width * 1_000_000) <= life * 1_000_000
    dealt = d.withColumn("own", own).withColumn("slice", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))))
    after = F.lead("us").over(Window.partitionBy("target", "slice").orderBy("us", "delivery"))
    d = dealt.withColumn("wait", after - F.col("us")).where("slice = own")
    made = lambda n: F.lit(True) if n == 0 else F.col("wait").isNull() | (F.lit(waits[n] * 1_000_000) < F.col("wait"))
    tried = sum((F.when((F.col("fails") >= n) & made(n), 1).otherwise(0) for n in range(most)), F.lit(0))
    d = d.withColumn("attempts", F.when(F.col("wait") == 0, 0).otherwise(tried).cast("int"))
    status = F.when((F.col("attempts") > F.col("fails")), DONE).when(F.col("attempts") == most, DEAD).otherwise(OBSOLETE)
    return d.select("target", "delivery", status.alias("status"), "attempts")
