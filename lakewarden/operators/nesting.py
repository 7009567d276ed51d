"""Nested structure of brace languages by joins and prefixes: no file is walked by one loop.

 1. What a line does to a small automaton (code, block comment, template string) is a function from the state at its start to
    that at its end. Functions compose, so lines are composed within blocks of ``BLOCK`` lines, blocks within a file, and every
    line gets the state that it begins in. Comments and strings are then taken out of it by its own state.
 2. Braces of what is left get their depth by a running sum. An opening brace and the next closing one of its depth belong
    together. What was defined since the last brace is what a brace opens.
 3. Counting only the braces of definitions gives each its level; the last one opened on the level below is its parent.

Regular-expression literals and expressions inside template strings aren't told from division and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import _cut

#: Lines that are composed at once.
BLOCK = 256
CODE, COMMENT, TEMPLATE = 0, 1, 2
#: What isn't code, from where it begins: strings (they end with their line), comments, templates; the open ones reach to the line's end.
_TOKEN = r"""(?s)(?:"(?:\\.|[^"\\])*+"?|'(?:\\.|[^'\\])*+'?|//.*\z|/\*.*?\*/|/\*.*\z|`(?:\\.|[^`\\])*+`?)"""
_MARK = r"""["'`/*\\\\]"""
#: What a line of code must hold for a token.
_TOLD = r"[{}]|\bclass\b|\bfunction\b|=>|\("
#: Words that look like methods.
_WORDS = "if|for|while|switch|catch|function|return|with|do|else|new|typeof|await"
DEFINITIONS = (
    ("class", r"\bclass\s+([A-Za-z_$][\w$]*)"),
    ("function", r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)"),
    ("function", r"([A-Za-z_$][\w$]*)\s*[:=]\s*(?:async\s+)?(?:function\b|\([^(){}]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)"),
    ("method", rf"^\s*(?:(?:async|static|get|set|public|private|protected)\s+)*(?!(?:{_WORDS})\b)([A-Za-z_$][\w$]*)\s*\([^(){{}}]*\)\s*(?=\{{)"),
)


def _last(text: Column) -> Column:
    """The last of a line's strings, comments and templates, if any."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), F.lit(-1))


def _end(last: Column) -> Column:
    """The state in which a line of code ends, by the last of what isn't code."""
    body = F.regexp_replace(last, r"(?s)^`(?:\\.|[^`\\])*+", "")
    open_ = F.when(F.startswith(last, F.lit("/*")) & ~(F.endswith(last, F.lit("*/")) & (F.length(last) >= 4)), COMMENT).when(F.startswith(last, F.lit("`")) & (body == ""), TEMPLATE)
    return F.coalesce(open_, F.lit(CODE))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, _TOKEN, " ")


def code_lines(lines: DataFrame) -> DataFrame:
    """``lines(path, line_no, text)`` with ``state`` (at the line's start) and ``code``, the text less comments and strings."""
    # column by column, so that no pattern is matched again for each of its uses
    rows = lines.select("path", "line_no", F.coalesce("text", F.lit("")).alias("text"))
    text, comment, template = F.col("text"), F.col("after_comment"), F.col("after_template")
    # most lines have no mark at all: they change no state, and are code as they stand or not at all
    rows = rows.withColumns({"plain": ~text.rlike(_MARK), "closed": F.instr(text, "*/")})
    shut = F.when(~F.col("plain"), F.regexp_extract(text, r"(?s)^((?:\\.|[^`\\])*+`)", 1)).otherwise("")
    rows = rows.withColumn("shut", F.length(shut))
    rows = rows.withColumns({"after_comment": F.when(F.col("closed") > 0, F.substring(text, F.col("closed") + 2, F.length(text))), "after_template": F.when(F.col("shut") > 0, F.substring(text, F.col("shut") + 1, F.length(text)))})
    rows = rows.withColumns({"last_code": F.when(~F.col("plain"), _last(text)), "last_comment": _last(comment), "last_template": _last(template)})
    ends = F.when(F.col("plain"), F.array(*map(F.lit, (CODE, COMMENT, TEMPLATE)))).otherwise(F.array(_end(F.col("last_code")), F.when(comment.isNull(), COMMENT).otherwise(_end(F.col("last_comment"))), F.when(template.isNull(), TEMPLATE).otherwise(_end(F.col("last_template")))))
    codes = F.when(F.col("plain"), F.array(text, F.lit(""), F.lit(""))).otherwise(F.array(_bare(text), F.coalesce(_bare(comment), F.lit("")), F.coalesce(_bare(template), F.lit(""))))
    rows = rows.select("path", "line_no", ends.alias("ends"), codes.alias("codes"), F.floor(F.col("line_no") / BLOCK).alias("block"))
    at = lambda a, i: F.element_at(a, i + 1)
    # a block's own function, then what all blocks before it make of the first state
    own = rows.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "ends", "codes"))).alias("l"))
    same = F.array(*map(F.lit, (CODE, COMMENT, TEMPLATE)))
    own = own.withColumn("f", F.aggregate("l", same, lambda acc, x: F.transform(acc, lambda s: at(x["ends"], s))))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("first", F.aggregate(F.collect_list("f").over(before), F.lit(CODE), lambda s, f: at(f, s)))
    states = F.aggregate("l", F.array("first"), lambda acc, x: F.concat(acc, F.array(at(x["ends"], F.element_at(acc, -1)))))
    each = own.withColumn("s", states).select("path", F.posexplode("l").alias("i", "x"), "s")
    return each.select("path", F.col("x.line_no").alias("line_no"), at(F.col("s"), F.col("i")).alias("state"), at(F.col("x.codes"), at(F.col("s"), F.col("i"))).alias("code"))


def tokens(code: DataFrame) -> DataFrame:
    """path, pos, line_no, token (open, close, def), name, kind of ``code_lines`` in order."""

    def found_by(kind: str, pattern: str) -> Column:
        """Definitions of one form and where each stands; the same one twice in a line is one."""
        pairs = F.arrays_zip(F.regexp_extract_all("code", F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all("code", F.lit(pattern), F.lit(0)).alias("w"))
        return F.transform(pairs, lambda x: F.struct(F.call_function("locate", x["w"], F.col("code")).alias("at"), F.lit("def").alias("token"), x["n"].alias("name"), F.lit(kind).alias("kind")))

    marks = [found_by(*d) for d in DEFINITIONS]
    letters = F.split("code", "")
    braces = F.filter(F.transform(letters, lambda c, i: F.struct((i + 1).alias("at"), F.when(c == "{", "open").when(c == "}", "close").alias("token"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"))), lambda b: b["token"].isNotNull())
    # of several readings of one place (a method that is a function as well) the first definition's counts
    found = F.filter(F.concat(*marks), lambda m: m["name"] != "")
    some = code.where(F.col("code").rlike(_TOLD))
    flat = some.select("path", "line_no", F.explode(F.concat(braces, found)).alias("m")).select("path", "line_no", "m.*")
    flat = flat.dropDuplicates(["path", "line_no", "at", "token", "name"])
    pos = F.shiftleft(F.col("line_no").cast("long"), 31) + F.col("at")  # whatever the number of lines, and the length of each
    return flat.select("path", pos.alias("pos"), "line_no", "token", "name", "kind")


def outline(lines: DataFrame) -> DataFrame:
    """path, name, kind, line, last, parent, level of every class, function and method of ``lines(path, line_no, text)``.

    ``parent`` is the innermost definition around it (null: none), ``level`` how many there are. A body that never closes has no last line.
    Rows are written once, so that the joins that give them broadcast what is small as rows only.
    """
    # a line without a mark and without what makes a token changes no state and gives no row: it isn't shuffled
    lines = lines.where(F.col("text").rlike(_MARK) | F.col("text").rlike(_TOLD))
    t = _cut(tokens(code_lines(lines)))  # few and short; all that follows reads them several times
    here = W.partitionBy("path").orderBy("pos")
    back = here.rowsBetween(W.unboundedPreceding, -1)
    step = F.when(F.col("token") == "open", 1).when(F.col("token") == "close", -1).otherwise(0)
    t = t.withColumn("depth", F.sum(step).over(here) + F.when(F.col("token") == "close", 1).otherwise(0))
    t = t.withColumn("brace", F.last(F.when(F.col("token") != "def", F.col("pos")), True).over(back)).withColumn("d", F.last(F.when(F.col("token") == "def", F.struct("pos", "line_no", "name", "kind")), True).over(back))
    opens = (F.col("token") == "open") & F.col("d").isNotNull() & (F.col("d.pos") > F.coalesce("brace", F.lit(-1)))
    level = W.partitionBy("path", "depth").orderBy("pos")
    b = t.where("token <> 'def'").withColumn("named", opens)
    b = b.withColumn("end", F.when((F.col("token") == "open") & (F.lead("token").over(level) == "close"), F.struct(F.lead("pos").over(level).alias("pos"), F.lead("line_no").over(level).alias("line_no"))))
    made = _cut(b.where("named").select("path", F.col("d.pos").alias("pos"), "d.name", "d.kind", F.col("d.line_no").alias("line"), F.col("pos").alias("from"), F.col("end.pos").alias("to"), F.col("end.line_no").alias("last")))
    # definitions without braces of their own: one line, nothing inside
    plain = t.where("token = 'def'").join(made.select("path", "pos"), ["path", "pos"], "left_anti").where("kind = 'function'")
    plain = plain.select("path", "pos", "name", "kind", F.col("line_no").alias("line"), F.col("pos").alias("from"), F.col("pos").alias("to"), F.col("line_no").alias("last"))
    every = _cut(made.union(plain).withColumn("leaf", F.col("from") == F.col("to")))
    # levels by the braces of definitions only
    steps = made.select("path", F.col("from").alias("at"), F.lit(1).alias("n")).union(made.where("to is not null").select("path", F.col("to"), F.lit(-1)))
    marks = steps.select("path", "at", "n", F.lit(None).cast("long").alias("own")).union(every.select("path", F.col("pos"), F.lit(0), F.col("pos")))
    up = marks.withColumn("level", F.sum("n").over(W.partitionBy("path").orderBy("at", F.col("own").isNotNull()))).where("own is not null").select("path", F.col("own").alias("pos"), "level")
    every = every.join(up, ["path", "pos"])
    below = every.where("not leaf").select("path", (F.col("level") + 1).alias("key"), F.col("from").alias("at"), F.struct("name", "to").alias("opened"), F.lit(None).cast("long").alias("child"))
    inside = below.union(every.select("path", F.col("level").alias("key"), F.col("pos").alias("at"), F.lit(None).cast(below.schema["opened"].dataType), F.col("pos").alias("child")))
    parents = inside.withColumn("p", F.last("opened", True).over(W.partitionBy("path", "key").orderBy("at"))).where("child is not null").select("path", F.col("child").alias("pos"), F.col("p.name").alias("parent"))
    return _cut(every.join(parents, ["path", "pos"]).select("path", "name", "kind", "line", "last", F.when(F.col("level") > 0, F.col("parent")).alias("parent"), F.col("level").cast("int").alias("level")))
