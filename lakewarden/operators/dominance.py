"""Which statements can run at all, and under which conditions: dominators of control-flow rows.

A file's functions are one group, as large as the file. Immediate dominators are found by passes in reverse postorder until none
changes; the conditions of a block are those on its chain of dominators. Joins bring them to lines, to flows, and to the calls
on a flow's way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut


def dominators(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """Immediate dominator of each of ``n`` blocks; the entry 0 is its own, -1 is out of reach."""
    after, before = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in edges:
        after[a].append(b)
        before[b].append(a)
    order, number, stack = [], [-1] * n, [(0, iter(after[0]))]
    number[0] = 0
    while stack:
        at, rest = stack[-1]
        for b in rest:
            if number[b] < 0:
                number[b] = 0
                stack.append((b, iter(after[b])))
                break
        else:
            order.append(at)
            stack.pop()
    for i, b in enumerate(order):
        number[b] = i  # postorder
    idom = [-1] * n
    idom[0], changed = 0, True
    while changed:
        changed = False
        for b in reversed(order[:-1]):
            best = -1
            for p in before[b]:
                if idom[p] < 0:
                    continue
                if best < 0:
                    best = p
                    continue
                q = p
                while q != best:
                    while number[q] < number[best]:
                        q = idom[q]
                    while number[best] < number[q]:
                        best = idom[best]
            if best != idom[b]:
                idom[b], changed = best, True
    return idom


def _blocks(key, t):
    t = t.sort_by([("unit", "ascending"), ("block", "ascending")])
    cols = {c: t[c].to_pylist() for c in ("fn", "unit", "kind", "block", "to", "text")}
    units = np.array(cols["unit"], np.int64)
    out: dict[str, list] = {c: [] for c in ("fn", "unit", "block", "idom", "reached", "conditions")}
    for unit in np.unique(units).tolist():
        own = np.flatnonzero(units == unit).tolist()
        texts = {cols["block"][i]: cols["text"][i] for i in own if cols["kind"][i] == "block"}
        idom = dominators(len(texts), [(cols["block"][i], cols["to"][i]) for i in own if cols["kind"][i] == "edge"])
        chain: dict[int, list[str]] = {}
        for b in range(len(texts)):
            path, at = [], b
            while idom[at] >= 0 and at not in chain and at:
                path.append(at)
                at = idom[at]
            for x in reversed(path):
                chain[x] = chain.get(idom[x], []) + ([texts[x]] if texts[x] else [])
            for c, v in zip(out, (cols["fn"][own[0]], unit, b, idom[b] if b and idom[b] >= 0 else None, idom[b] >= 0, chain.get(b, [texts[b]] if texts[b] and not b else [])), strict=True):
                out[c].append(v)
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()))
    return pa.table({"path": pa.array([key[0].as_py()] * len(out["fn"]), pa.string()), **{c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)}})


def blocks(rows: DataFrame) -> DataFrame:
    """path, fn, unit, block, idom, reached, conditions of every block."""
    parts = rows.where("kind <> 'lines'").select("path", "fn", "unit", "kind", "block", "to", "text")
    return parts.groupBy("path").applyInArrow(_blocks, "path string, fn string, unit int, block int, idom int, reached boolean, conditions array<string>")


def line_conditions(rows: DataFrame) -> DataFrame:
    """path, line, reached, conditions: a line runs if any of its statements does; of several the innermost one's conditions."""
    lines = rows.where("kind = 'lines'").select("path", "unit", "block", F.explode(F.sequence("line", "last")).alias("line"))
    on = lines.distinct().join(blocks(rows).select("path", "unit", "block", "reached", "conditions"), ["path", "unit", "block"])
    best = F.max_by("conditions", F.struct(F.col("reached"), F.size("conditions"), F.col("block")))
    return on.groupBy("path", "line").agg(F.max("reached").alias("reached"), best.alias("conditions"))


def feasible_flows(flows: DataFrame, rows: DataFrame) -> DataFrame:
    """``flows`` (of ``dataflow.labelled_paths``) with verdict and conditions.

    UNREACHABLE if its source, its sink or a call on its way can't run, CONDITIONAL if conditions hold at any of them, else
    EXPLOITABLE; NOT_EXPLOITABLE stays what it was made. Conditions are in the order of the way, each once.
    Flows and rows are read twice, so both are written once: files are parsed once. So is the result, as its joins are.
    """
    flows, rows = _cut(flows), _cut(rows)
    key = ["path", "fn", "source", "source_line", "sink_path", "sink", "sink_line"]
    step = F.transform("via", lambda v, i: F.struct((i + 1).alias("at"), F.regexp_extract(v, r"^(.*?):(\d+) ", 1).alias("p"), F.regexp_extract(v, r"^(.*?):(\d+) ", 2).cast("int").alias("l")))
    ends = lambda at, p, l: F.array(F.struct(at.alias("at"), F.col(p).alias("p"), F.col(l).alias("l")))
    sites = flows.select(*key, F.explode(F.concat(ends(F.lit(0), "path", "source_line"), step, ends(F.size("via") + 1, "sink_path", "sink_line"))).alias("s"))
    known = line_conditions(rows).select(F.col("path").alias("p"), F.col("line").alias("l"), "reached", "conditions")
    met = sites.select(*key, "s.*").join(known, ["p", "l"], "left")
    told = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "conditions"))), lambda x: F.coalesce(x["conditions"], F.array().cast("array<string>")))))
    way = met.groupBy(*key).agg(F.min(F.coalesce("reached", F.lit(True))).alias("runs"), told.alias("conditions"))
    verdict = F.when(F.col("label") == "NOT_EXPLOITABLE", F.col("label")).when(~F.col("runs"), "UNREACHABLE").when(F.size("conditions") > 0, "CONDITIONAL").otherwise("EXPLOITABLE")
    return _cut(flows.join(way, key).withColumn("verdict", verdict).drop("runs"))
