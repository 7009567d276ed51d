"""Prefix trie of conversations.

Conversations that begin with the same turns share the nodes of these turns. A node stands for a distinct sequence of
first turns; the root for none.

 1. A turn is the digest of its role and text. A conversation becomes one short row: its digests one after another, its
    turns' word counts. Equal conversations become one row with a weight, its least id, and the checksum of its ids, which
    are joined by blocks of ids first and then hashed in order as they stream by.
 2. Rows are dealt by the digest of their first turn. First turns whose subtries are small share a bucket; within
    applyInPandas a bucket is a forest of pointer dictionaries (digest -> node), built turn by turn. Children have larger
    numbers than their parents, so running down the numbers is the postorder, without recursion.
 3. A subtrie with more than ``limit`` turns isn't built in one task. All its rows share their first turns up to where the
    least and the greatest of them part; those turns are nodes of their own ("spine"), the rows are dealt again by the
    turn that follows, and so on until every part is small. What the parts hand up (members, leaves, saved tokens) is
    summed per spine node by Spark, from the deepest round up.

Memory of a task: a bucket, about ``limit`` turns (36 bytes each, and a dictionary entry), or the one row of a conversation that is
longer than that. A checksum streams, whatever the number of its ids.

Defined results: turns of a conversation are ordered by turn (null first), turns of one number by digest; repeated rows
are turns like others. Null role or text is empty. Rows of null conv_id belong to no conversation. An empty table gives no rows,
not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Turns that a task builds a trie of, about; ids in a block of a checksum.
LIMIT, BLOCK_BITS = 2_500, 12
WIDTH = 32  # characters of a digest
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: array of (digest, words) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull())
    turn = F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    kept = rows.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return kept.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def borrowed_heads(own: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of the first of their family, h = crc32(id) % most."""
    own = Workspace(own.sparkSession).stage(own, "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    # a family's first conversation, cut to the turns that any member may take
    base = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<digest: string, words: int>>")), F.lit(1), h)
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def checksums(members: DataFrame) -> DataFrame:
    """key -> sha, the SHA-256 of its conv_ids as decimal text, ascending, comma-joined, for ``members(key, conv_id)``.

    Only blocks of ids meet, and pass in order; nothing is gathered.
    """
    block = F.shiftright("conv_id", BLOCK_BITS)
    parts = members.groupBy("key", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches):
        key, state = None, None
        for b in batches:
            done = []
            for k, ids in zip(b["key"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["key", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "sha"])

    return parts.repartition("key").sortWithinPartitions("key", "block").mapInArrow(hashed, "key string, sha string")


def forest(cut: list[int], seqs: list[str], words: list, weight: list[int], least: list[int], sha: list[str]) -> dict[str, list]:
    """Nodes of the subtries of some rows; the top of each lies at depth ``cut``, and ``top`` names a row below it (else -1)."""
    tops: dict[str, int] = {}
    child: list[dict] = []
    parent, depth, conv, n, saved, ends, top = [], [], [], [], [], [], []
    for row, (start, seq, own, w, c) in enumerate(zip(cut, seqs, words, weight, least, strict=True)):
        node, at = -1, start - 1
        for k in range(at * WIDTH, len(seq), WIDTH):
            # the top of a subtrie is named by all turns up to it, other nodes by theirs below their parent
            where, name = (child[node], seq[k : k + WIDTH]) if node >= 0 else (tops, seq[: k + WIDTH])
            found = where.get(name)
            if found is None:
                found = where[name] = len(parent)
                parent.append(node)
                depth.append(at + 1)
                top.append(row if node < 0 else -1)
                conv.append(c)
                n.append(0)
                saved.append(int(own[at]))
                ends.append(EMPTY)
                child.append({})
            node = found
            n[node] += w
            conv[node] = min(conv[node], c)
            at += 1
        ends[node] = sha[row]
    leaves = [0] * len(parent)
    saved = [(m - 1) * words for m, words in zip(n, saved, strict=True)]
    for node in range(len(parent) - 1, -1, -1):  # children first
        leaves[node] = leaves[node] or 1
        if (up := parent[node]) >= 0:
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    ups = [conv[p] if p >= 0 else None for p in parent]
    return {"conv_id": conv, "depth": depth, "parent_conv_id": ups, "n_convs": n, "n_children": list(map(len, child)), "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "top": top}


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """All nodes of a bucket's subtries; the top of each also says what it hangs on."""
    out = pd.DataFrame(forest(*(pdf[c].tolist() for c in ("cut", "seq", "words", "weight", "conv_id", "sha"))))
    on, at = pdf["on"].tolist(), pdf["on_conv"].tolist()
    out["on"] = [on[t] if t >= 0 else None for t in out["top"]]
    out["parent_conv_id"] = pd.array([at[t] if t >= 0 else p for t, p in zip(out["top"], out["parent_conv_id"], strict=True)], "Int64")
    return out.drop(columns="top")


def shared_turns(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many first turns the least and the greatest of some sequences share, hence all between them."""
    return pa.array([len(os.path.commonprefix([x, y])) // WIDTH for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def prefix_trie(rebuilt: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie over ``rebuilt(conv_id long, turns array<struct<digest, words>>)``; the columns of NODE."""
    spark = rebuilt.sparkSession
    ws = Workspace(spark)
    flat = rebuilt.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))
    flat = ws.stage(flat.withColumn("key", F.md5(F.col("seq").cast("binary"))), "conversations")
    # equal sequences have equal words
    classes = flat.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("seq").alias("seq"), F.first("words").alias("words"))
    classes = ws.stage(classes.join(checksums(flat.select("key", "conv_id")), "key").drop("key"), "classes")
    total = classes.agg(F.min("conv_id"), F.sum("weight"), F.sum(F.length("seq")), F.max(F.when(F.col("seq") == "", F.col("sha")))).first()
    if total[0] is None:
        return spark.createDataFrame([], NODE)

    # rounds: what is still to be dealt, by the node that it hangs on
    rest = classes.where("seq <> ''").select("*", F.lit(1).alias("cut"), F.lit("").alias("on"), F.lit(total[0]).alias("on_conv"))
    small, spines = [], []
    while True:
        gid = F.md5(F.substring("seq", F.lit(1), F.col("cut") * WIDTH).cast("binary"))
        rest = rest.withColumn("gid", gid)
        size = F.length("seq") / WIDTH - F.col("cut") + 1
        sizes = rest.groupBy("gid").agg(F.sum(size).alias("size"), F.count("*").alias("rows"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.min("conv_id").alias("spine_conv"), F.sum("weight").alias("n"), F.first("cut").alias("first"), F.first("on").alias("above"), F.first("on_conv").alias("above_conv"))
        large = sizes.where((F.col("size") > limit) & (F.col("rows") > 1))
        large = ws.stage(large.select("gid", "spine_conv", "n", "first", "above", "above_conv", F.length("lo").alias("least"), F.arrow_udf(shared_turns, "int")("lo", "hi").alias("last")), "large")
        if large.isEmpty():
            small.append(rest)
            break
        ids = large.select("gid", "last", "spine_conv")
        small.append(rest.join(ids, "gid", "left_anti"))
        inside = rest.join(ids, "gid")
        ended = inside.where(F.length("seq") == F.col("last") * WIDTH).select("gid", F.col("sha").alias("end"))
        words = inside.groupBy("gid").agg(F.first("words").alias("words"))
        spines.append(large.join(ended, "gid", "left").join(words, "gid").withColumn("words", F.slice("words", F.col("first"), F.col("last") - F.col("first") + 1)))
        rest = inside.where(F.length("seq") > F.col("last") * WIDTH).select("conv_id", "weight", "sha", "seq", "words", (F.col("last") + 1).alias("cut"), F.col("gid").alias("on"), F.col("spine_conv").alias("on_conv"))
        rest = ws.stage(rest, "rest")
        spines[-1] = ws.stage(spines[-1], "spine")

    todo = small[0]
    for more in small[1:]:
        todo = todo.unionByName(more)
    buckets = max(1, -(-total[2] // WIDTH // limit))
    todo = todo.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets))).select("bucket", "cut", "seq", "words", "weight", "conv_id", "sha", "on", "on_conv")
    nodes = ws.stage(todo.groupBy("bucket").applyInPandas(build, f"{NODE}, `on` string"), "nodes")

    # spine nodes, the deepest round first: sums of what hangs on them, then up along the run of single children
    done = nodes.drop("on")
    tops = nodes.where("`on` is not null").select("on", "n_leaves", "saved_tokens")
    for spine in reversed(spines):
        below = tops.groupBy("on").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("on", "gid")
        run = spine.join(below, "gid").withColumn("d", F.explode(F.sequence("first", "last")))
        deepest = F.col("d") == F.col("last")
        own = F.aggregate(F.slice("words", F.col("d") - F.col("first") + 1, F.col("last") - F.col("d") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
        run = run.select(
            F.col("spine_conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") == F.col("first"), F.col("above_conv")).otherwise(F.col("spine_conv")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(deepest, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
            (F.col("saved") + (F.col("n") - 1) * own).alias("saved_tokens"), F.when(deepest, F.coalesce("end", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
            F.when(F.col("d") == F.col("first"), F.col("above")).alias("on"),
        )
        run = ws.stage(run, "run")
        done = done.unionByName(run.drop("on"))
        tops = tops.unionByName(run.where("`on` is not null").select("on", "n_leaves", "saved_tokens"))
    first = tops.where("`on` = ''").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = first.select(F.lit(total[0]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total[1]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(total[3] or EMPTY).alias("ends_sha256"))
    return done.unionByName(root)
