"""Python package versions and specifiers as expressions: keys that sort as versions do, and membership."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERN = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|beta|preview|pre|a|b|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
_FAR = 1 << 40
#: Versions between which two constraints are tried, beside their own.
SAMPLES = ("0.0.1", "1.0.0", "2.0.0", "2.19.0", "2.31.0", "3.0.0", "5.0.0")


def _release(text: Column) -> Column:
    """Numbers of a release; zeros at the end don't count."""
    numbers = F.transform(F.split(F.regexp_replace(text, r"(\.0+)+$", ""), r"\."), lambda p: p.try_cast("long"))
    return numbers


def version_key(v: Column) -> Column:
    """A struct that compares as versions do; null for what is no version. Local parts don't count."""
    part = lambda i: F.regexp_extract(v, _PATTERN, i)
    number = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0).cast("long"))
    letter = F.lower(part(3))
    rank = F.when(letter.isin("a", "alpha"), 1).when(letter.isin("b", "beta"), 2).otherwise(3)
    has_post, has_dev = (part(5) != "") | (part(6) != ""), part(8) != ""
    pre = F.when(letter != "", F.struct(rank.alias("l"), number(4).alias("n"))).when(has_dev & ~has_post, F.struct(F.lit(0).alias("l"), F.lit(0).cast("long").alias("n"))).otherwise(F.struct(F.lit(9).alias("l"), F.lit(0).cast("long").alias("n")))
    post = F.when(part(5) != "", number(5)).when(part(6) != "", number(7)).otherwise(F.lit(-1).cast("long"))
    dev = F.when(has_dev, number(9)).otherwise(F.lit(_FAR).cast("long"))
    return F.when(v.rlike(_PATTERN), F.struct(number(1).alias("epoch"), _release(part(2)).alias("release"), pre.alias("pre"), post.alias("post"), dev.alias("dev")))


def is_prerelease(v: Column) -> Column:
    return (F.regexp_extract(v, _PATTERN, 3) != "") | (F.regexp_extract(v, _PATTERN, 8) != "")


def _base(k: Column) -> Column:
    """The release without what comes before or after it."""
    return F.struct(k["epoch"].alias("epoch"), k["release"].alias("release"))


def _prefixed(v: Column, head: Column) -> Column:
    """Whether a version's release begins with that of ``head`` (numbers with dots)."""
    numbers = lambda t: F.transform(F.split(F.regexp_extract(t, _PATTERN, 2), r"\."), lambda p: p.try_cast("long"))
    mine, want = numbers(v), numbers(head)
    padded = F.concat(mine, F.array_repeat(F.lit(0).cast("long"), F.size(want)))
    return (F.slice(padded, F.lit(1), F.size(want)) == want) & (version_key(v)["epoch"] == version_key(head)["epoch"])


def _item(v: Column, item: Column) -> Column:
    """One comparison of a specifier."""
    item = F.trim(item)
    op = F.regexp_extract(item, r"^(===|~=|==|!=|<=|>=|<|>)", 1)
    want = F.trim(F.regexp_replace(item, r"^(===|~=|==|!=|<=|>=|<|>)", ""))
    star = F.endswith(want, F.lit(".*"))
    head = F.regexp_replace(want, r"\.\*$", "")
    k, w = version_key(v), version_key(head)
    local = F.contains(want, F.lit("+"))
    same = F.when(local, (k == w) & (F.lower(F.regexp_extract(v, _PATTERN, 10)) == F.lower(F.regexp_extract(head, _PATTERN, 10)))).otherwise(k == w)
    short = F.regexp_replace(F.regexp_extract(head, _PATTERN, 2), r"\.\d+$", "")
    return (
        F.when(item == "", F.lit(True))
        .when(op == "===", F.lower(F.trim(v)) == F.lower(want))
        .when(op == "==", F.when(star, _prefixed(v, head)).otherwise(same))
        .when(op == "!=", F.when(star, ~_prefixed(v, head)).otherwise(~same))
        .when(op == "~=", (k >= w) & _prefixed(v, short))
        .when(op == ">=", k >= w)
        .when(op == "<=", k <= w)
        # neither a pre-release of the bound nor a post-release of it is beyond it
        .when(op == "<", (k < w) & ~(is_prerelease(v) & ~is_prerelease(head) & (_base(k) == _base(w))))
        .when(op == ">", (k > w) & ~((k["post"] >= 0) & (w["post"] < 0) & (_base(k) == _base(w))))
        .otherwise(F.lit(False))
    )


def matches(v: Column, spec: Column) -> Column:
    """Whether a version fits a comma-joined specifier; pre-releases only where the specifier names one."""
    items = F.split(F.coalesce(spec, F.lit("")), ",")
    named = F.exists(items, lambda i: ~F.trim(i).rlike(r"^!=") & is_prerelease(F.trim(F.regexp_replace(F.trim(i), r"^[<>=!~]+", ""))))
    return F.coalesce(F.when(version_key(v).isNotNull(), F.forall(items, lambda i: _item(v, i)) & (~is_prerelease(v) | named)), F.lit(False))


def bounds(spec: Column) -> Column:
    """The versions that a specifier names."""
    return F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda i: F.regexp_replace(F.trim(F.regexp_replace(F.trim(i), r"^[<>=!~]+", "")), r"\.\*$", "")), lambda x: x != "")


def conflicting(a: Column, b: Column) -> Column:
    """Whether none of the sample versions and of those that the specifiers name fits both."""
    tried = F.concat(F.array(*map(F.lit, SAMPLES)), bounds(a), bounds(b))
    return ~F.exists(tried, lambda v: matches(v, a) & matches(v, b))


def is_broad(spec: Column) -> Column:
    """No bound at all, or a lower bound at a whole version."""
    text = F.coalesce(spec, F.lit(""))
    return (text == "") | F.exists(F.split(text, ","), lambda i: F.trim(i).rlike(r"^>=?\s*([012]|.*\.0)$"))


def overlaps(spec: Column, introduced: Column, until: Column) -> Column:
    """Whether a constraint takes an end of an affected interval."""
    return matches(introduced, spec) | F.coalesce(matches(until, spec) & until.isNotNull(), F.lit(False))


# --- specifiers as sets of ranges -------------------------------------------------------------
#
# A cut is a place between versions: (-1) before all, (1) after all, or (0, key, side) just before (0) or just after (1) a
# version. A range lies between two cuts; a specifier is a sorted array of disjoint ranges.

_KEY = "struct<epoch: bigint, release: array<bigint>, pre: struct<l: int, n: bigint>, post: bigint, dev: bigint>"
_RANGES = f"array<struct<lo: struct<end: int, key: {_KEY}, side: int>, hi: struct<end: int, key: {_KEY}, side: int>>>"


def _cut(key: Column, side: int) -> Column:
    return F.struct(F.lit(0).alias("end"), key.alias("key"), F.lit(side).alias("side"))


def _far(end: int) -> Column:
    return F.struct(F.lit(end).alias("end"), F.lit(None).cast(_KEY).alias("key"), F.lit(0).alias("side"))


def _ranges(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in pairs)).cast(_RANGES)


def _as_key(epoch: Column, release: Column, pre: tuple[int, int], post: int, dev: int) -> Column:
    return F.struct(epoch.alias("epoch"), release.alias("release"), F.struct(F.lit(pre[0]).alias("l"), F.lit(pre[1]).cast("long").alias("n")).alias("pre"), F.lit(post).cast("long").alias("post"), F.lit(dev).cast("long").alias("dev"))


def everything() -> Column:
    return _ranges((_far(-1), _far(1)))


def intersect(a: Column, b: Column) -> Column:
    """Versions in both."""
    both = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["lo"], y["lo"]).alias("lo"), F.least(x["hi"], y["hi"]).alias("hi")))))
    return F.array_sort(F.filter(both, lambda r: r["lo"] < r["hi"]))


def complement(a: Column) -> Column:
    """Versions outside: what lies between the ranges, before the first and after the last."""
    cuts = F.flatten(F.transform(a, lambda r: F.array(r["lo"], r["hi"])))
    ends = F.concat(F.array(_far(-1)).cast(f"array<struct<end: int, key: {_KEY}, side: int>>"), cuts, F.array(_far(1)).cast(f"array<struct<end: int, key: {_KEY}, side: int>>"))
    pairs = F.transform(F.sequence(F.lit(0), F.size(a)), lambda i: F.struct(F.get(ends, 2 * i).alias("lo"), F.get(ends, 2 * i + 1).alias("hi")))
    return F.filter(pairs, lambda r: r["lo"] < r["hi"])


def _head(item: Column) -> Column:
    """op, star, key and what the bounds of one comparison need."""
    item = F.trim(item)
    op = F.regexp_extract(item, r"^(===|~=|==|!=|<=|>=|<|>)", 1)
    want = F.trim(F.regexp_replace(item, r"^(===|~=|==|!=|<=|>=|<|>)", ""))
    head = F.regexp_replace(want, r"\.\*$", "")
    text = F.regexp_extract(head, _PATTERN, 2)
    # ~= holds all but the last number, == with a star all of them
    held = F.when(op == "~=", F.regexp_replace(text, r"\.\d+$", "")).otherwise(text)
    numbers = F.transform(F.split(held, r"\."), lambda p: p.try_cast("long"))
    nxt = F.concat(F.slice(numbers, F.lit(1), F.size(numbers) - 1), F.array(F.element_at(numbers, -1) + 1))
    plain = lambda n: _release(F.array_join(F.transform(n, lambda x: x.cast("string")), "."))
    return F.struct(
        (item == "").alias("any"), op.alias("op"), F.endswith(want, F.lit(".*")).alias("star"), version_key(head).alias("key"), is_prerelease(head).alias("early"),
        _release(text).alias("release"), plain(numbers).alias("first"), plain(nxt).alias("next"), (op.isin("~=") & ~head.rlike(r"\d\.\d")).alias("bad"),
    )


def _item_ranges(h: Column) -> Column:
    key, epoch = h["key"], h["key"]["epoch"]
    dev0 = lambda release: _cut(_as_key(epoch, release, (0, 0), -1, 0), 0)
    final, posts = _as_key(epoch, h["release"], (9, 0), -1, _FAR), _cut(_as_key(epoch, h["release"], (9, 0), _FAR, _FAR), 1)
    at, after, low, high = _cut(key, 0), _cut(key, 1), _far(-1), _far(1)
    one, prefix = _ranges((at, after)), _ranges((dev0(h["first"]), dev0(h["next"])))
    none = F.array().cast(_RANGES)
    is_post = key["post"] >= 0
    return (
        F.when(h["any"], everything())
        .when(key.isNull() | h["bad"], none)
        .when(h["op"].isin("==", "==="), F.when(h["star"], prefix).otherwise(one))
        .when(h["op"] == "!=", F.when(h["star"], complement(prefix)).otherwise(complement(one)))
        .when(h["op"] == "~=", F.filter(_ranges((at, dev0(h["next"]))), lambda r: r["lo"] < r["hi"]))
        .when(h["op"] == ">=", _ranges((at, high)))
        .when(h["op"] == "<=", _ranges((low, after)))
        # pre-releases of a bound that is none itself aren't below it, post-releases of one aren't above it
        .when(h["op"] == "<", F.when(h["early"], _ranges((low, at))).when(is_post, _ranges((low, dev0(h["release"])), (_cut(final, 0), at))).otherwise(_ranges((low, dev0(h["release"])))))
        .when(h["op"] == ">", F.when(is_post, _ranges((after, high))).when(h["early"], _ranges((after, _cut(final, 1)), (posts, high))).otherwise(_ranges((posts, high))))
        .otherwise(none)
    )


def spec_ranges(spec: Column) -> Column:
    """The versions of a comma-joined specifier as disjoint ranges in order; none for what can't be read.

    Whether pre-releases count is left to the caller: the ranges hold those that lie inside. Beside a bound that is itself a
    pre- or post-release, pre-releases of post-releases and post-releases of pre-releases count by their place. ``===`` counts
    as ``==``.
    """
    heads = F.transform(F.split(F.coalesce(spec, F.lit("")), ","), _head)
    return F.aggregate(F.transform(heads, _item_ranges), everything(), intersect)


def in_ranges(v: Column, ranges: Column) -> Column:
    at = _cut(version_key(v), 0)
    return F.coalesce(version_key(v).isNotNull() & F.exists(ranges, lambda r: (r["lo"] <= at) & (at < r["hi"])), F.lit(False))


def affected_ranges(introduced: Column, until: Column, inclusive: Column | None = None) -> Column:
    """An advisory's interval: from a version on, up to another, which may belong to it. Null or "0": from the first on."""
    lo = F.when(introduced.isNull() | (introduced == "0"), _far(-1)).otherwise(_cut(version_key(introduced), 0))
    hi = F.when(until.isNull(), _far(1)).when(F.coalesce(inclusive, F.lit(False)) if inclusive is not None else F.lit(False), _cut(version_key(until), 1)).otherwise(_cut(version_key(until), 0))
    return F.filter(_ranges((lo, hi)), lambda r: r["lo"] < r["hi"])


def disjoint(a: Column, b: Column) -> Column:
    """Whether no version fits both specifiers."""
    return F.size(intersect(spec_ranges(a), spec_ranges(b))) == 0
