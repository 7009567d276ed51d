"""Rolling exact median and median absolute deviation of irregular series.

Every click asks for the median of its series over the last hour, ties at its own instant included, and for the
median distance from that median. Values are whole cents.

 1. Each click_id is taken once; rows go to a written table.
 2. Every series is cut into chunks of time, dyadic slices that hold at most ``rows`` clicks each: counts of slices of
    about a second are merged upwards, first within 38 hours, then within months. No series and no hour is
    one task, however dense.
 3. A chunk gets its own clicks and a halo, the clicks of one window before it. Halo clicks that no window of the
    chunk loses are only counted by cents, with map-side sums; the others keep their time. A second of one series
    that alone holds more than ``rows`` clicks is counted too, by instant and cents, and its answers are joined back.
 4. Within a chunk a counted binary trie over the bits of the cents, offset so that the least is zero, holds the
    window: a branching node knows how many values of the window lie below its zero side. The chunk's instants are
    dealt to lanes, runs of consecutive instants; all lanes slide at once, each over counts of its own. Per step values
    enter and leave along their paths, bit descent selects both middle values, and differences of two prefix counts
    bisect the radius that holds half of the window.

Memory of a task: a chunk's rows, its halo by distinct cents, and ``CELLS`` counts. Where a window itself holds many
times ``rows`` clicks, chunks are shorter than the window and each takes the window's distinct cents with it; so many
copies as chunks fit into a window are summed before they are shuffled.

Defined results: clicks of null time are dropped; of rows that share a click_id and differ the one of the earliest
time stays (then null kind, then least kind, then least cents, null first); rows of null click_id are one click. A null
or non-finite value, or one beyond 2**53 cents, has no cents; its click has a window all the same. An empty table gives no rows; other
columns are not read. Times without a zone are taken as they stand, whatever the session's zone; times with one are instants.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

#: Bits of microseconds of the smallest slice (about a second) and of the largest (101 days); slices are merged in two
#: steps, at most 131,072 of them in 38 hours first. Clicks look up their chunks by keys of about an hour.
FINE, MIDDLE, COARSE, KEY = 20, 37, 43, 32
#: Counts of all lanes of a chunk together.
CELLS, LANES = 8_000_000, 512
OWN, COUNTED, ASKED = 0, 1, 2  # a click, counted values of a window, counted clicks of an overfull second


def micros(ts: Column, kind: T.DataType) -> Column:
    """Exact microseconds since 1970, without any zone where the column has none."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(ts)
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000 + second


def cents(value: Column) -> Column:
    c = F.floor(value.cast("double") * 100 + 0.5)
    return F.when(F.abs(value.cast("double")) <= float(1 << 53) / 100, c)


def cover(at: np.ndarray, total: np.ndarray, whole: np.ndarray, low: int, high: int, limit: int):
    """Largest dyadic slices of at most ``limit`` rows: their (numbers, bits, rows).

    ``at`` are sorted numbers of slices of ``low`` bits; those that aren't ``whole`` are cut already.
    """
    out = []
    for bits in range(low, high):
        first = np.flatnonzero(np.diff(at >> 1, prepend=(at[0] >> 1) - 1))
        many = np.add.reduceat(total, first) > limit
        stop = whole & np.repeat(many, np.diff(first, append=len(at)))
        out.append((at[stop], np.full(stop.sum(), bits), total[stop]))
        at, total, whole = at[first] >> 1, np.add.reduceat(total, first), ~many
        if not whole.any():
            break
    else:
        out.append((at[whole], np.full(whole.sum(), high), total[whole]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def chunks(rows: DataFrame, limit: int) -> DataFrame:
    """series, start, bits, n: the slices of ``rows(series, us)`` that are tasks."""
    schema = "series string, start long, bits int, n long"

    def table(series, at, bits, n):
        return pa.table({"series": pa.array([series] * len(at), pa.string()), "start": at << bits, "bits": bits.astype(np.int32), "n": n})

    def fine(key, t):
        t = t.sort_by("slice")
        at, n = t["slice"].to_numpy(), t["n"].to_numpy()
        return table(key[0].as_py(), *cover(at, n, np.ones(len(at), bool), FINE, MIDDLE, limit))

    def coarse(key, t):
        t = t.sort_by("start")
        start, bits, n = (t[c].to_numpy() for c in ("start", "bits", "n"))
        at = start >> MIDDLE
        first = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
        up, up_bits, up_n = cover(at[first], np.add.reduceat(n, first), bits[first] == MIDDLE, MIDDLE, COARSE, limit)
        cut = bits < MIDDLE
        return table(key[0].as_py(), np.concatenate([up, start[cut] >> bits[cut]]), np.concatenate([up_bits, bits[cut]]).astype(np.int64), np.concatenate([up_n, n[cut]]))

    slices = rows.groupBy("series", F.shiftright("us", FINE).alias("slice")).agg(F.count("*").alias("n"))
    blocks = slices.groupBy("series", F.shiftright("slice", MIDDLE - FINE).alias("block")).applyInArrow(fine, schema)
    return blocks.groupBy("series", F.shiftright("start", COARSE).alias("block")).applyInArrow(coarse, schema)


class Trie:
    """The branching nodes of the binary trie over sorted distinct ``values``, none of them negative.

    Node j parts values[j] from values[j + 1] at their highest differing bit, so there is one for each such pair.
    ``below[j]`` is the first value of its zero side. ``up[i]`` lists the nodes that have value i on their zero side
    (their counts change with it), ``sib[i]`` those that have it on their one side (their counts precede it).
    """

    def __init__(self, values: np.ndarray):
        self.values, m = values, len(values)
        self.m, self.below = m, np.zeros(max(m - 1, 0), np.int64)
        self.child = np.zeros((2, max(m - 1, 1)), np.int64)
        self.root = -1
        up, sib = [], []
        lo, hi, above, side = np.array([0]), np.array([m]), np.array([-1]), np.array([0])
        while True:
            big = hi - lo > 1
            self._hang(above[~big], side[~big], ~lo[~big])
            lo, hi, above, side = lo[big], hi[big], above[big], side[big]
            if not len(lo):
                break
            part = values[lo] ^ values[hi - 1]
            bit = np.where(part >> 32 > 0, 31 + np.frexp((part >> 32).astype(np.float64))[1], np.frexp((part & 0xFFFFFFFF).astype(np.float64))[1] - 1)
            split = np.searchsorted(values, values[hi - 1] >> bit << bit)
            node = split - 1
            self.below[node] = lo
            self._hang(above, side, node)
            n = hi - lo
            leaf = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            right = leaf >= np.repeat(split, n)
            for cols, which, none in ((up, ~right, m), (sib, right, m + 1)):
                col = np.full(m, none)
                col[leaf[which]] = np.repeat(node, n)[which]
                cols.append(col)
            lo, hi = np.stack([lo, split], 1).ravel(), np.stack([split, hi], 1).ravel()
            above, side = np.repeat(node, 2), np.tile([0, 1], len(node))
        self.up, self.sib = self._narrow(up, m), self._narrow(sib, m + 1)
        self.sib = np.concatenate([self.sib, np.full((1, self.sib.shape[1]), m + 1)])  # beyond the last value

    def _hang(self, above, side, what) -> None:
        if len(above) and above[0] < 0:
            self.root = int(what[0])
        else:
            self.child[side, above] = what

    def _narrow(self, cols: list[np.ndarray], none: int) -> np.ndarray:
        paths = np.sort(np.stack(cols, 1), 1) if cols else np.full((self.m, 1), none)
        return np.ascontiguousarray(paths[:, : max(1, int((paths < none).sum(1).max()))])


class Window:
    """Counted windows of several lanes over one trie: a row of ``counts`` is a lane's, by node.

    The last two columns take what no node needs: the first is never read, the second stays zero.
    """

    def __init__(self, trie: Trie, lanes: int):
        self.t, self.width = trie, trie.m + 2
        self.counts = np.zeros((lanes, self.width), np.int32 if trie.m < 1 << 30 else np.int64)
        self.flat = self.counts.ravel()
        self.n = np.zeros(lanes, np.int64)

    def fill(self, lane: int, leaf: np.ndarray, weight: np.ndarray) -> None:
        """A lane's first window."""
        t = self.t
        cum = np.concatenate([[0], np.cumsum(np.bincount(leaf, weight, t.m).astype(np.int64))])
        self.counts[lane, : t.m - 1] = cum[1 : t.m] - cum[t.below]
        self.n[lane] = cum[-1]

    def add(self, lane: np.ndarray, leaf: np.ndarray, weight: np.ndarray) -> None:
        at = (lane * self.width)[:, None] + self.t.up[leaf]
        np.add.at(self.flat, at.ravel(), np.repeat(weight, at.shape[1]).astype(self.flat.dtype))
        np.add.at(self.n, lane, weight)

    def before(self, lane: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each lane's window are less than ``x``."""
        at = np.searchsorted(self.t.values, x)
        inner = self.flat[(lane * self.width)[:, None] + self.t.sib[at]].sum(1, dtype=np.int64)
        return np.where(at == self.t.m, self.n[lane], inner)

    def select(self, lane: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each lane's window, by bit descent."""
        node, k, row = np.full(len(lane), self.t.root), k.copy(), lane * self.width
        while (node >= 0).any():
            inner = node >= 0
            at = np.where(inner, node, self.t.m + 1)
            less = self.flat[row + at]
            right = (k >= less) & inner
            k -= np.where(right, less, 0)
            node = np.where(inner, self.t.child[right.astype(np.int64), np.where(inner, node, 0)], node)
        return self.t.values[~node]

    def middle(self, lane: np.ndarray) -> np.ndarray:
        """Doubled medians."""
        n, two = self.n[lane], np.concatenate([lane, lane])
        v = self.select(two, np.maximum(np.concatenate([n - 1, n]) // 2, 0))
        return v[: len(lane)] + v[len(lane) :]

    def within(self, lane, m2, r) -> np.ndarray:
        """How many values c of the window have |2c - m2| <= r."""
        return self.before(lane, (m2 + r) // 2 + 1) - self.before(lane, -((r - m2) // 2))

    def spread(self, lane: np.ndarray, m2: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """Doubled medians of |2c - m2|; ``guess`` (a radius near the answer) only saves steps."""
        n = self.n[lane]
        first, second = np.maximum(n - 1, 0) // 2 + 1, n // 2 + 1  # so many values lie within the two radii
        lo, hi = np.full(len(lane), -1), np.maximum(2 * self.t.values[-1] - m2, m2)
        probes = [guess + guess // 8, guess - guess // 8 - 1]
        live = np.arange(len(lane))
        while len(live):
            a, b = lo[live], hi[live]
            mid = np.clip(probes.pop(0)[live], a + 1, b - 1) if probes else (a + b) // 2
            ok = self.within(lane[live], m2[live], mid) >= first[live]
            hi[live], lo[live] = np.where(ok, mid, b), np.where(ok, a, mid)
            live = live[hi[live] - lo[live] > 1]
        # the second of two middle distances: the same, or the next one out on either side
        top, bottom = self.before(lane, (m2 + hi) // 2 + 1), self.before(lane, -((hi - m2) // 2))
        far = np.iinfo(np.int64).max // 4
        two = self.select(np.concatenate([lane, lane]), np.concatenate([np.minimum(top, np.maximum(n - 1, 0)), np.maximum(bottom - 1, 0)]))
        over = np.where(top < n, 2 * two[: len(lane)] - m2, far)
        under = np.where(bottom > 0, m2 - 2 * two[len(lane) :], far)
        return hi + np.where(top - bottom >= second, hi, np.minimum(over, under))


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def slide(asked: np.ndarray, us: np.ndarray, value: np.ndarray, weight: np.ndarray, width: int):
    """n, doubled median, doubled deviation of the window [q - width, q] of each sorted distinct instant of ``asked``.

    ``us`` (sorted), ``value``, ``weight``: counted values. Where n < 2 the other two mean nothing.
    """
    if not len(us):
        none = np.zeros(len(asked), np.int64)
        return none, none, none
    least = int(value.min())
    distinct, leaf = np.unique(value - least, return_inverse=True)
    trie = Trie(distinct)
    enter, leave = np.searchsorted(us, asked, side="right"), np.searchsorted(us, asked - width)
    steps = -(-len(asked) // max(1, min(LANES, len(asked) // 8, CELLS // (trie.m + 2))))
    head = np.arange(0, len(asked), steps)
    w = Window(trie, len(head))
    n, m2, mad = (np.zeros(len(asked), np.int64) for _ in range(3))
    radius = np.zeros(len(head), np.int64)
    for step in range(steps):
        lane = np.flatnonzero(head + step < len(asked))
        q = head[lane] + step
        if not step:
            for i, at in zip(lane.tolist(), q.tolist(), strict=True):
                own = slice(leave[at], enter[at])
                w.fill(i, leaf[own], weight[own])
        else:
            for ends, sign in ((enter, 1), (leave, -1)):
                at = spans(ends[q - 1], ends[q])
                if len(at):
                    w.add(np.repeat(lane, ends[q] - ends[q - 1]), leaf[at], sign * weight[at])
        n[q], m2[q] = w.n[lane], w.middle(lane)
        mad[q] = w.spread(lane, m2[q], radius[lane])
        radius[lane] = mad[q] // 2
    return n, m2 + 2 * least, mad


def answers(width: int, kind: pa.DataType):
    """The clicks and overfull instants of one chunk with their windows."""

    def own(key, t):
        t = t.sort_by("us")
        us, role, weight = (t[c].to_numpy() for c in ("us", "role", "n"))
        known = np.asarray(t["cents"].is_valid())
        value = np.asarray(t["cents"].fill_null(0))
        asks = role != COUNTED
        asked, which = np.unique(us[asks], return_inverse=True)
        n, m2, mad = slide(asked, us[known], value[known], weight[known], width)
        rows, which = pa.array(np.flatnonzero(asks)), which.ravel()
        if (role == ASKED).any():  # one answer an instant
            keep = np.flatnonzero((role[asks] == OWN) | (np.diff(which, prepend=-1) > 0))
            rows, which = rows.take(pa.array(keep)), which[keep]
        few = n[which] < 2
        t = t.take(rows)
        return pa.table({"series": t["series"], "role": t["role"], "click_id": t["click_id"].cast(kind), "us": t["us"], "cents": t["cents"], "n": n[which], "median2": pa.array(m2[which], mask=few), "mad4": pa.array(mad[which], mask=few)})

    return own


def rolling_medians(clicks: DataFrame, minutes: int = 60, rows: int = 32_768, id_col: str = "click_id", ts_col: str = "ts", series_col: str = "kind", value_col: str = "value") -> DataFrame:
    """click_id, kind, n, median2, mad4, far for every click of known time."""
    ws = Workspace(clicks.sparkSession)
    width = minutes * 60_000_000
    series = F.when(F.col(series_col).isNotNull(), F.concat(F.lit("="), F.col(series_col).cast("string")))
    us = micros(F.col(ts_col), clicks.schema[ts_col].dataType)
    fields = F.struct(us.isNull().alias("no"), us.alias("us"), series.alias("series"), cents(F.col(value_col)).alias("cents"))
    once = clicks.select(F.col(id_col).alias("click_id"), fields.alias("x")).groupBy("click_id").agg(F.min("x").alias("x"))
    once = once.where("not x.no").select("click_id", F.coalesce("x.series", F.lit("")).alias("series"), "x.us", "x.cents")
    once = ws.stage(once, "clicks")

    parts = ws.stage(chunks(once, rows), "chunks")
    part = F.struct("start", "bits", (F.col("n") > rows).alias("full"))
    end = F.col("start") + F.expr("shiftleft(1L, bits)")
    keys = F.sequence(F.shiftright(F.col("start") - width, KEY), F.shiftright(end - 1, KEY))
    near = parts.select("series", F.explode(keys).alias("key"), part.alias("part")).groupBy("series", "key").agg(F.collect_list("part").alias("parts"))
    # chunks that see a click: its own, and those that begin within a window after it
    sees = F.filter("parts", lambda p: (p["start"] - width <= F.col("us")) & (F.col("us") < p["start"] + F.call_function("shiftleft", F.lit(1).cast("long"), p["bits"])))
    dealt = once.withColumn("key", F.shiftright("us", KEY)).join(near.hint("shuffle_hash"), ["series", "key"])
    dealt = dealt.select("click_id", "series", "us", "cents", F.explode(sees).alias("part")).select("click_id", "series", "us", "cents", "part.*")
    dealt = ws.stage(dealt.where("us >= start or cents is not null"), "dealt")

    inside, lost = F.col("us") >= F.col("start"), F.col("us") < F.col("start") + F.expr("shiftleft(1L, bits)") - width
    key, id_type = ["series", "start", "bits"], once.schema["click_id"].dataType
    single = dealt.where((inside & ~F.col("full")) | (~inside & lost))
    single = single.select(*key, F.when(inside, OWN).otherwise(COUNTED).alias("role"), F.when(inside, F.col("click_id")).alias("click_id"), "us", "cents", F.lit(1).cast("long").alias("n"))
    summed = dealt.where((inside & F.col("full")) | (~inside & ~lost))
    at = F.when(inside, F.col("us")).otherwise(F.col("start") - 1)  # the order within the halo doesn't matter to windows that lose none of it
    summed = summed.groupBy(*key, F.when(inside, ASKED).otherwise(COUNTED).alias("role"), at.alias("us"), "cents").agg(F.count("*").alias("n"))
    summed = summed.select(*key, "role", F.lit(None).cast(id_type).alias("click_id"), "us", "cents", "n")
    kind = id_type.simpleString()
    schema = f"series string, role int, click_id {kind}, us long, cents long, n long, median2 long, mad4 long"
    out = single.union(summed).groupBy(*key).applyInArrow(answers(width, pa.string() if kind == "string" else _arrow(id_type)), schema)
    if not parts.where(F.col("n") > rows).isEmpty():
        out = ws.stage(out, "answers")
        full = dealt.where(inside & F.col("full")).select("click_id", "series", "us", "cents")
        per = out.where(F.col("role") == ASKED).select("series", "us", "n", "median2", "mad4")
        out = out.where(F.col("role") == OWN).drop("role").unionByName(full.join(per.hint("shuffle_hash"), ["series", "us"]))
    off = F.abs(2 * F.col("cents") - F.col("median2"))
    return out.select("click_id", F.expr("if(series = '', null, substring(series, 2))").alias("kind"), "n", "median2", "mad4", (2 * off > 3 * F.col("mad4")).alias("far"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
