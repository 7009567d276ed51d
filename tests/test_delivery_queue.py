"""The delivery queue: a log against brute force, and a stream that is stopped and begun again."""

import datetime as dt
import json
import random
import time

from pyspark.sql import functions as F

from lakewarden.streaming import delivery_queue as Q

T0 = dt.datetime(2024, 1, 1)


def plain(rows, most, backoff):
    first = {}
    for target, d, ts, fails in rows:
        if None not in (target, d, ts) and (d not in first or (ts, target, max(fails or 0, 0)) < first[d]):
            first[d] = (ts, target, max(fails or 0, 0))
    out = set()
    for d, (ts, target, fails) in first.items():
        later = [(t, x) for x, (t, k, _) in first.items() if k == target and (t, x) > (ts, d)]
        end = min(later)[0] if later else None
        tried, at = 0, ts
        while tried < most and (end is None or at < end):
            tried += 1
            if tried > fails:
                break
            at += dt.timedelta(seconds=backoff * 2 ** (tried - 1))
        out.add((target, d, "DONE" if tried > fails else "DEAD" if tried == most else "OBSOLETE", tried))
    return out


def test_log_equals_brute_force(spark):
    """Ties of time, repeated ids, nulls, a busy target over many slices, slices shorter than a life."""
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "b", "c"]), rnd.randrange(250), T0 + dt.timedelta(seconds=60 * rnd.randrange(900)), rnd.choice([0, 0, 1, 2, 3, 7, -1, None])) for _ in range(300)]
    rows += [("z", 900, T0, 1), ("z", 901, T0 + dt.timedelta(seconds=600), 5), ("z", 902, T0 + dt.timedelta(seconds=600), 0), (None, 903, T0, 0), ("z", None, T0, 0), ("z", 904, None, 0)]
    df = spark.createDataFrame(rows, "target string, delivery long, ts timestamp, fails int").withColumn("slice", F.lit(1)).withColumn("own", F.lit("x"))
    for width in (1, 3600, 86_400):
        assert {tuple(r) for r in Q.replayed(df, 3, 600, width).collect()} == plain(rows, 3, 600)
    assert {tuple(r) for r in Q.replayed(df, 1, 600).collect()} == plain(rows, 1, 600)
    assert Q.replayed(df.limit(0)).collect() == []


def test_stream_keeps_its_state_over_a_restart(spark, tmp_path):
    """A job tried twice before the stop is dead after one more try; a newer delivery makes the queued one obsolete; replays give nothing."""
    source, sink, ckpt = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    schema = "target string, delivery string, ts timestamp, body string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def send(name, *rows):
        text = "\n".join(json.dumps({"target": t, "delivery": d, "ts": f"2024-01-01T00:00:{s:02}", "body": b}) for t, d, s, b in rows)
        (tmp_path / f"{name}.part").write_text(text)
        (tmp_path / f"{name}.part").rename(tmp_path / "in" / f"{name}.json")

    def handler(job):
        if job["body"] == "bad":
            raise ValueError(f"attempt {job['attempt']}")

    def start(backoff_ms):
        out = Q.run(spark.readStream.schema(schema).json(source), handler, 3, backoff_ms)
        return out.writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(sink)).option("checkpointLocation", ckpt).outputMode("update").start()

    def told():
        return {(r.target, r.delivery, r.status, r.attempts, r.error) for r in spark.read.parquet(sink).collect()}

    def until(query, want):
        for _ in range(300):
            if query.exception():
                raise query.exception()
            try:
                if want <= told():
                    return
            except Exception:  # noqa: BLE001  nothing is written yet
                pass
            time.sleep(0.2)
        raise AssertionError(want - told())

    send("1", ("p", "p1", 1, "bad"), ("q", "q1", 1, "ok"), ("r", "r1", 1, "bad"), ("q", "q0", 0, "ok"), (None, "x", 1, "ok"))
    first = {("p", "p1", "QUEUED", 1, "attempt 1"), ("q", "q0", "OBSOLETE", 0, None), ("q", "q1", "DONE", 1, None), ("r", "r1", "QUEUED", 1, "attempt 1")}
    query = start(4000)
    until(query, first)
    query.stop()
    send("2", ("r", "r2", 5, "ok"), ("q", "q1", 9, "ok"), ("r", "r0", 0, "ok"))
    query = start(200)
    second = first | {("p", "p1", "QUEUED", 2, "attempt 2"), ("p", "p1", "DEAD", 3, "attempt 3"), ("r", "r1", "OBSOLETE", 1, None), ("r", "r2", "DONE", 1, None), ("r", "r0", "OBSOLETE", 0, None)}
    until(query, second - {("r", "r1", "OBSOLETE", 1, None)})
    query.stop()
    got = told()
    assert {x for x in got if x[0] != "r"} == {x for x in second if x[0] != "r"}
    assert any(x[:3] == ("r", "r1", "OBSOLETE") for x in got)
    assert {x[1] for x in got} == {"p1", "q0", "q1", "r0", "r1", "r2"}
