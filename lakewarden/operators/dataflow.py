"""Data flow over all files: which inputs reach which dangerous calls, across functions and files, and how.

Rows of ``sources.def_use`` are nodes and edges inside functions. Calls are resolved to functions over all files, names
that packages hand on included. Then two fixpoints, each a semi-naive loop of joins in which only new rows go on:

 1. ``reach``: from every parameter and every source, the nodes of its function that its value gets to. Where a
    parameter gets to what its function returns, every call of that function gains an edge from that argument to its
    result (a summary), so values pass through calls and come back only to the call they came from. A source that gets
    to what its function returns goes on at every caller.
 2. ``entered``: from every source, the parameters that it is handed to, then theirs. Parameters that only hand on to one
    other, with no sink of their own, are skipped by pointer doubling, so a chain of n helpers takes log n steps.

A value carries the set of contexts that every step on its way has made it safe for, as bits. Of two ways to the same
node the one whose bits are a subset of the other's stands; neither is a subset, both stand. A flow's label is that
of its least safe way, and that way is shown. Rounds end when nothing is new; there is no limit on depth.

Shuffles are by (path, node); tables of a round are written, so a lost executor costs a round at most.

``shared_paths`` does this once for packages that differ by their name only, and gives each its own flows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.def_use import facts_again, file_facts
from .graph import _count, _cut
from .symbols import resolve_names

#: Fixed values.
SOURCES = {
    "request.args": "HTTP_REQUEST", "request.form": "HTTP_REQUEST", "request.json": "HTTP_REQUEST", "request.data": "HTTP_REQUEST", "request.cookies": "HTTP_REQUEST", "request.headers": "HTTP_REQUEST",
    "request.values": "HTTP_REQUEST", "request.GET": "HTTP_REQUEST", "request.POST": "HTTP_REQUEST", "request.query_params": "HTTP_REQUEST", "sys.argv": "CLI_ARGUMENT", "input": "CLI_ARGUMENT",
    "argparse": "CLI_ARGUMENT", "click": "CLI_ARGUMENT", "typer": "CLI_ARGUMENT", "os.environ": "ENVIRONMENT_VARIABLE", "os.getenv": "ENVIRONMENT_VARIABLE", "open": "FILE_READ", "read_text": "FILE_READ",
    "read_bytes": "FILE_READ", "file.read": "FILE_READ", "cursor.fetchone": "DATABASE_DATA", "cursor.fetchall": "DATABASE_DATA",
}
SINKS = {
    "SQL_INJECTION": ("cursor.execute", "cursor.executemany", "connection.execute", "db.execute"),
    "COMMAND_INJECTION": ("os.system", "os.popen", "subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_output"),
    "CODE_EXECUTION": ("eval", "exec", "compile"),
    "PATH_TRAVERSAL": ("open", "Path", "os.remove", "os.unlink", "os.listdir"),
    "SSRF": ("requests.get", "requests.post", "requests.request", "httpx.get", "httpx.post", "urllib.request.urlopen"),
    "TEMPLATE_INJECTION": ("jinja2.Template", "Template", "render_template_string"),
}
SANITIZERS = {
    "shlex.quote": "SHELL_SAFE", "html.escape": "HTML_SAFE", "escape": "HTML_SAFE", "markupsafe.escape": "HTML_SAFE", "werkzeug.security.safe_str_cmp": "GENERAL_SAFE", "int": "GENERAL_SAFE",
    "float": "GENERAL_SAFE", "bool": "GENERAL_SAFE", "os.path.basename": "PATH_SAFE",
}
NEEDS = {"SQL_INJECTION": "SQL_SAFE", "COMMAND_INJECTION": "SHELL_SAFE", "PATH_TRAVERSAL": "PATH_SAFE", "SSRF": "SSRF_SAFE"}
#: Calls in a condition that check a value without changing it.
VALIDATORS = ("isinstance", "type", "isdigit", "isalnum", "isnumeric", "re.fullmatch", "re.match")
RULES = {"SQL_INJECTION": "TAINT-SQL", "COMMAND_INJECTION": "TAINT-CMD", "CODE_EXECUTION": "TAINT-CODE", "PATH_TRAVERSAL": "TAINT-PATH", "SSRF": "TAINT-SSRF", "TEMPLATE_INJECTION": "TAINT-TEMPLATE"}
GENERAL, VALIDATED = "GENERAL_SAFE", "VALIDATED"
#: From the safest on.
LABELS = ("NOT_EXPLOITABLE", "UNLIKELY", "LIKELY", "HIGHLY_LIKELY")


@dataclass(frozen=True)
class TaintConfig:
    """What is a source, a sink, a sanitizer or a check, by names of calls and reads."""

    sources: dict[str, str] = field(default_factory=lambda: dict(SOURCES))
    sinks: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(SINKS))
    sanitizers: dict[str, str] = field(default_factory=lambda: dict(SANITIZERS))
    needs: dict[str, str] = field(default_factory=lambda: dict(NEEDS))
    validators: tuple[str, ...] = VALIDATORS
    rules: dict[str, str] = field(default_factory=lambda: dict(RULES))

    def override(self, more: dict) -> TaintConfig:
        """With the entries of a mapping (a YAML document's) added: sources and sanitizers by name, sinks and needs by kind.

        A name set to null is taken out; a kind of sink gets its names added, or is taken out by null.
        """
        unknown = set(more) - {"sources", "sinks", "sanitizers", "needs", "validators", "rules"}
        if unknown:
            raise ValueError(f"unknown parts of a taint configuration: {sorted(unknown)}")
        put = lambda old, new: {k: v for k, v in (old | (new or {})).items() if v is not None}
        sinks = dict(self.sinks)
        for kind, names in (more.get("sinks") or {}).items():
            sinks[kind] = None if names is None else (*sinks.get(kind, ()), *(n for n in ([names] if isinstance(names, str) else names) if n not in sinks.get(kind, ())))
        rules = put(self.rules, more.get("rules"))
        sinks = {k: v for k, v in sinks.items() if v}
        rules |= {k: f"TAINT-{k}" for k in sinks if k not in rules}
        return replace(self, sources=put(self.sources, more.get("sources")), sinks=sinks, sanitizers=put(self.sanitizers, more.get("sanitizers")), needs=put(self.needs, more.get("needs")), validators=(*self.validators, *(more.get("validators") or ())), rules=rules)

    @property
    def first_parts(self) -> set[str]:
        """First parts of all names: a package called so isn't like one with another name."""
        names = (*self.sources, *(n for names in self.sinks.values() for n in names), *self.sanitizers, *self.validators)
        return {n.partition(".")[0] for n in names}

    @property
    def contexts(self) -> dict[str, int]:
        names = [VALIDATED, GENERAL, *sorted({*self.sanitizers.values(), *self.needs.values()} - {GENERAL, VALIDATED})]
        return {c: 1 << i for i, c in enumerate(names)}

    def source_kind(self, name: Column, call: bool) -> Column:
        """A read or call of a source's name or of what lies under it; a read by any object that ends so as well."""
        out = F.lit(None).cast("string")
        for s, kind in reversed(self.sources.items()):
            hit = (name == s) | name.startswith(f"{s}.")
            if not call and "." in s:
                hit = hit | F.concat(F.lit("."), name).contains(f".{s}")
            out = F.when(hit, F.lit(kind)).otherwise(out)
        return out

    def sink_kind(self, name: Column) -> Column:
        """Exact, or by a dotted tail (``self.cursor.execute``)."""
        exact, tail = F.lit(None).cast("string"), F.lit(None).cast("string")
        for kind, names in reversed(self.sinks.items()):
            exact = F.when(name.isin(*names), F.lit(kind)).otherwise(exact)
            dotted = [name.endswith(f".{n}") for n in names if "." in n]
            if dotted:
                tail = F.when(reduce(Column.__or__, dotted), F.lit(kind)).otherwise(tail)
        return F.coalesce(exact, tail)

    def safe_bits(self, name: Column) -> Column:
        out = F.lit(0)
        for s, context in self.sanitizers.items():
            out = F.when(name == s, F.lit(self.contexts[context])).otherwise(out)
        return out

    def check_bits(self, name: Column) -> Column:
        plain = [v for v in self.validators if "." not in v]
        return F.when(name.isin(*self.validators) | F.substring_index(name, ".", -1).isin(*plain), F.lit(self.contexts[VALIDATED])).otherwise(F.lit(0))

    def label(self, bits: Column, sink_kind: Column, source_kind: Column) -> Column:
        has = lambda bit: bits.bitwiseAND(F.lit(bit)) != 0
        need = has(self.contexts[GENERAL])
        for kind, context in self.needs.items():
            need = need | ((sink_kind == kind) & has(self.contexts[context]))
        return F.when(need, F.lit(LABELS[0])).when(has(self.contexts[VALIDATED]), F.lit(LABELS[1])).when(source_kind == "HTTP_REQUEST", F.lit(LABELS[3])).otherwise(F.lit(LABELS[2]))


def _new(rows: DataFrame, known: DataFrame | None, start: list[str]) -> DataFrame:
    """Rows that say something new: the shortest way for each bits, unless bits that are a subset are known for that start and node."""
    key = [*start, "path", "id"]
    rows = rows.groupBy(*key, "bits").agg(F.min(F.struct(F.size("via"), "via")).alias("w")).select(*key, "bits", "w.via")
    if known is not None:
        o = known.select(*(F.col(c).alias(f"o_{c}") for c in key), F.col("bits").alias("o_bits"))
        same = reduce(Column.__and__, [F.col(c) == F.col(f"o_{c}") for c in key])
        rows = rows.join(o, same & (F.col("o_bits").bitwiseAND(F.col("bits")) == F.col("o_bits")), "left_anti")
    ways = F.collect_list(F.struct("bits", "via")).alias("ways")  # of one start and node, as many as there are sets of contexts
    least = F.filter("ways", lambda w: ~F.exists("ways", lambda o: (o["bits"] != w["bits"]) & (o["bits"].bitwiseAND(w["bits"]) == o["bits"])))
    return _cut(rows.groupBy(*key).agg(ways).select(*key, F.explode(least).alias("w")).select(*key, "w.bits", "w.via"))


class Program:
    """Nodes, edges and calls of all files, by one configuration."""

    def __init__(self, facts: DataFrame, config: TaintConfig):
        self.config = config
        facts = _cut(facts)
        of = lambda *kinds: facts.where(F.col("kind").isin(*kinds))
        step = lambda what, line: F.concat(F.col("path"), F.lit(":"), F.col(line).cast("string"), F.lit(" "), F.col(what))
        name = F.col("name")

        # calls -> functions, by position here or by dotted name anywhere
        defs = of("def").select(F.col("name").alias("dotted"), F.col("path").alias("fn_path"), F.col("text").alias("fn"))
        asked = of("target")
        there = asked.where("text is null").select("path", "id", "line", "pos", "name")
        there = resolve_names(there, of("bind").select("name", F.col("text").alias("target")), of("def", "module").select("name"))
        there = there.join(defs, F.col("resolved") == F.regexp_replace("dotted", r"#\d+", "")).select("path", "id", "line", "pos", "fn_path", "fn")
        here = asked.where("text = 'here'").select("path", "id", "line", "pos", F.col("path").alias("fn_path"), F.col("name").alias("fn"))
        self.calls = _cut(here.union(there).distinct())

        params = of("param").select(F.col("path").alias("fn_path"), "fn", F.col("id").alias("param"), F.col("name").alias("param_name"), F.col("pos").alias("param_pos"))
        args = of("arg").select("path", F.col("src").alias("id"), F.col("id").alias("call"), F.col("name").alias("keyword"), F.col("pos").alias("arg_pos"))
        given = args.union(of("recv").select("path", F.col("src").alias("id"), F.col("id").alias("call"), F.lit(None).cast("string"), F.lit(-9)))
        meets = self.calls.withColumnRenamed("id", "call").join(params, ["fn_path", "fn"]).join(given, ["path", "call"])
        at = F.col("arg_pos") + F.col("pos")
        fits = (
            (F.col("keyword").isNotNull() & ((F.col("keyword") == F.col("param_name")) | (F.col("param_pos") == -2)))
            | ((F.col("arg_pos") >= 0) & ((at == F.col("param_pos")) | ((F.col("param_pos") == -1) & (at >= F.col("pos")))))
            | ((F.col("arg_pos") == -1) & (F.col("param_pos") >= F.col("pos")))
            | ((F.col("arg_pos") == -1) & (F.col("param_pos") == -1))
            | ((F.col("arg_pos") == -2) & ((F.col("param_pos") >= F.col("pos")) | F.col("param_pos").isin(-2, -3)))
            | ((F.col("arg_pos") == -9) & (F.col("pos") == 1) & (F.col("param_pos") == 0))
        )
        label = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("fn"), F.lit("("), F.col("param_name"), F.lit(")"))
        self.bindings = _cut(meets.where(fits & F.col("id").isNotNull()).select("path", "id", "call", "fn_path", "param", label.alias("label")).distinct())

        # a method of a source's object is a source as well
        any_call = F.coalesce(self.config.source_kind(name, True), F.when(name.contains("."), self.config.source_kind(name, False)))
        # edges inside functions: checks, fields, and through calls that mean no known function or make an object
        flow = of("flow").select("path", F.col("src").alias("id"), F.col("id").alias("to"))
        checks = of("check").select("path", F.col("id").alias("to"), self.config.check_bits(name).alias("add"))
        local = flow.join(checks, ["path", "to"], "left").select("path", "id", "to", F.coalesce("add", F.lit(0)).alias("add"), F.lit(None).cast("string").alias("step"))
        known = self.calls.where("fn not like '%.\\_\\_init\\_\\_' and fn not like '%.\\_\\_init\\_\\_#%'").select("path", F.col("id").alias("call")).distinct()
        results = of("result").select("path", F.col("id").alias("call"), self.config.safe_bits(name).alias("add"), any_call.isNotNull().alias("is_source"), step("name", "line").alias("step"))
        through = given.join(known, ["path", "call"], "left_anti").join(results.where("not is_source"), ["path", "call"]).where("arg_pos <> -9 or add = 0")
        self.local = _cut(local.union(through.select("path", "id", F.col("call").alias("to"), "add", F.when(F.col("add") != 0, F.col("step")))).distinct())

        self.returns = of("ret").select("path", "fn", F.col("src").alias("id")).distinct()
        reads = of("read").select("path", "fn", "id", "name", "line", self.config.source_kind(name, False).alias("source_kind"))
        called = of("result").select("path", "fn", "id", "name", "line", any_call.alias("source_kind"))
        self.sources = _cut(reads.union(called).where("source_kind is not null"))
        self.params = of("param").select("path", "fn", "id")

        sunk = of("result").select("path", F.col("id").alias("call"), F.col("name").alias("sink"), self.config.sink_kind(name).alias("sink_kind"), F.col("line").alias("sink_line"), F.col("text").alias("shape")).where("sink_kind is not null")
        harmless = ((F.col("sink_kind") == "SQL_INJECTION") & ((F.coalesce("shape", F.lit("")) == "const") | ((F.col("arg_pos") > 0) | (F.col("arg_pos") < -1) & ~F.coalesce("keyword", F.lit("")).isin("sql", "query", "statement", "operation")))) | ((F.col("sink_kind") == "COMMAND_INJECTION") & (F.coalesce("shape", F.lit("")) == "list"))
        self.sinks = _cut(args.join(sunk, ["path", "call"]).where(~harmless).select("path", "id", "sink", "sink_kind", "sink_line").distinct())

    def reach(self) -> DataFrame:
        """s_path, s_id, path, id, bits, via: what parameters and sources get to in their functions, through calls and back."""
        from_param = self.params.select(F.col("path").alias("s_path"), F.col("id").alias("s_id"), "path", "id", F.lit(True).alias("is_param"))
        from_source = self.sources.select(F.col("path").alias("s_path"), F.col("id").alias("s_id"), "path", "id", F.lit(False).alias("is_param"))
        start = ["s_path", "s_id", "is_param"]
        delta = _cut(from_param.union(from_source).select(*start, "path", "id", F.lit(0).alias("bits"), F.array().cast("array<string>").alias("via")).distinct())
        known, edges, rounds = delta, self.local, 0
        fn_of = self.params.select(F.col("path").alias("s_path"), F.col("id").alias("s_id"))
        on = lambda rows, e: rows.join(e, ["path", "id"]).select(*start, "path", F.col("to").alias("id"), F.col("bits").bitwiseOR(F.col("add")).alias("bits"), F.when(F.col("step").isNull(), F.col("via")).otherwise(F.concat("via", F.array("step"))).alias("via"))
        while True:
            back = delta.join(self.returns, ["path", "id"])
            # parameters that newly reach a return: an edge at every call
            ends = back.where("is_param").join(fn_of, ["s_path", "s_id"]).select(F.col("s_path").alias("fn_path"), F.col("s_id").alias("param"), F.col("bits").alias("add"), F.concat(F.lit("back from "), "fn").alias("end"))
            gained = self.bindings.join(ends.distinct(), ["fn_path", "param"]).select("path", "id", F.col("call").alias("to"), "add", F.concat_ws(", ", "label", "end").alias("step"))
            gained = _cut(gained.groupBy("path", "id", "to", "add").agg(F.min("step").alias("step")))
            # sources that reach a return go on at every caller
            up = back.where("not is_param").select(*start, F.col("path").alias("fn_path"), "fn", "bits", "via").join(self.calls, ["fn_path", "fn"])
            up = up.select(*start, "path", "id", "bits", F.concat("via", F.array(F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(" back from "), F.col("fn")))).alias("via"))
            delta = _new(on(delta, edges).union(on(known, gained)).union(up), known, start)
            if delta.isEmpty():
                return known
            known, edges, rounds = known.union(delta), edges.union(gained), rounds + 1
            if rounds % 4 == 0:
                known, edges = _cut(known), _cut(edges)

    def entered(self, reach: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(source -> parameter rows, sinks of every parameter), with parameters that only hand on skipped."""
        inside = reach.join(self.bindings, ["path", "id"]).select("s_path", "s_id", "is_param", F.col("fn_path").alias("path"), F.col("param").alias("id"), "bits", F.concat("via", F.array("label")).alias("via"))
        hands = _cut(inside.where("is_param").drop("is_param").groupBy("s_path", "s_id", "path", "id", "bits").agg(F.min(F.struct(F.size("via"), "via")).alias("w")).select("s_path", "s_id", "path", "id", "bits", "w.via"))
        own = _cut(reach.where("is_param").join(self.sinks, ["path", "id"]).select(F.col("s_path").alias("path"), F.col("s_id").alias("id"), F.col("path").alias("sink_path"), "sink", "sink_kind", "sink_line", "bits", "via"))
        # pointer doubling over parameters with one way on and no sink
        busy = own.select(F.col("path").alias("s_path"), F.col("id").alias("s_id")).distinct()
        single = hands.groupBy("s_path", "s_id").agg(F.count("*").alias("n"), F.first(F.struct("path", "id", "bits", "via")).alias("to")).where("n = 1").join(busy, ["s_path", "s_id"], "left_anti")
        jump = _cut(single.select("s_path", "s_id", "to.*"))
        left = jump.count()
        while left:
            n = jump.select(F.col("s_path").alias("path"), F.col("s_id").alias("id"), F.col("path").alias("n_path"), F.col("id").alias("n_id"), F.col("bits").alias("n_bits"), F.col("via").alias("n_via"))
            both = jump.join(n, ["path", "id"], "left")
            jump = _cut(both.select("s_path", "s_id", F.coalesce("n_path", "path").alias("path"), F.coalesce("n_id", "id").alias("id"), F.col("bits").bitwiseOR(F.coalesce("n_bits", F.lit(0))).alias("bits"), F.concat("via", F.coalesce("n_via", F.array().cast("array<string>"))).alias("via")))
            jump = jump.where("s_path <> path or s_id <> id")  # a ring of parameters leads nowhere
            still = _count(jump.join(jump.select(F.col("s_path").alias("path"), F.col("s_id").alias("id")), ["path", "id"], "left_semi"))
            if still == 0 or still == left:
                break
            left = still
        skip = jump.select(F.col("s_path").alias("path"), F.col("s_id").alias("id"), F.col("path").alias("n_path"), F.col("id").alias("n_id"), F.col("bits").alias("n_bits"), F.col("via").alias("n_via"))

        def skipped(rows):
            both = rows.join(skip, ["path", "id"], "left")
            return both.select("s_path", "s_id", F.coalesce("n_path", "path").alias("path"), F.coalesce("n_id", "id").alias("id"), F.col("bits").bitwiseOR(F.coalesce("n_bits", F.lit(0))).alias("bits"), F.concat("via", F.coalesce("n_via", F.array().cast("array<string>"))).alias("via"))

        on = hands.join(skip.select(F.col("path").alias("s_path"), F.col("id").alias("s_id")), ["s_path", "s_id"], "left_anti")
        on = _cut(skipped(on)).select(F.col("s_path").alias("path"), F.col("s_id").alias("id"), F.col("path").alias("to_path"), F.col("id").alias("to"), F.col("bits").alias("add"), F.col("via").alias("more"))
        start = ["s_path", "s_id"]
        delta = _new(skipped(inside.where("not is_param").drop("is_param")), None, start)
        known, rounds = delta, 0
        while True:
            found = delta.join(on, ["path", "id"]).select("s_path", "s_id", F.col("to_path").alias("path"), F.col("to").alias("id"), F.col("bits").bitwiseOR(F.col("add")).alias("bits"), F.concat("via", "more").alias("via"))
            delta = _new(found, known, start)
            if delta.isEmpty():
                return known, own
            known, rounds = known.union(delta), rounds + 1
            if rounds % 4 == 0:
                known = _cut(known)


def labelled_paths(facts: DataFrame, config: TaintConfig | None = None) -> DataFrame:
    """Every flow with its label and way: path, fn, rule_id, source, source_kind, source_line, sink_path, sink, sink_kind, sink_line, label, via.

    ``facts`` are rows of ``sources.def_use``. One row for each source, line, function and sink; of several ways the least safe.
    """
    config = config or TaintConfig()
    program = Program(facts, config)
    reach = _cut(program.reach())
    near = reach.where("not is_param").join(program.sinks, ["path", "id"]).select("s_path", "s_id", F.col("path").alias("sink_path"), "sink", "sink_kind", "sink_line", "bits", "via")
    entered, own = program.entered(reach)
    far = entered.join(own.select("path", "id", "sink_path", "sink", "sink_kind", "sink_line", F.col("bits").alias("more_bits"), F.col("via").alias("more")), ["path", "id"])
    far = far.select("s_path", "s_id", "sink_path", "sink", "sink_kind", "sink_line", F.col("bits").bitwiseOR(F.col("more_bits")).alias("bits"), F.concat("via", "more").alias("via"))
    source = program.sources.select(F.col("path").alias("s_path"), F.col("id").alias("s_id"), "fn", F.col("name").alias("source"), "source_kind", F.col("line").alias("source_line"))
    rows = near.union(far).join(source, ["s_path", "s_id"])
    rows = rows.withColumn("label", config.label(F.col("bits"), F.col("sink_kind"), F.col("source_kind")))
    rank = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    best = rows.groupBy(F.col("s_path").alias("path"), "fn", "source", "source_kind", "source_line", "sink_path", "sink", "sink_kind", "sink_line").agg(F.min(F.struct((-rank).alias("rank"), F.size("via").alias("n"), "via", "label")).alias("b"))
    rule = F.lit(None).cast("string")
    for kind, rule_id in config.rules.items():
        rule = F.when(F.col("sink_kind") == kind, F.lit(rule_id)).otherwise(rule)
    return best.select("path", "fn", rule.alias("rule_id"), "source", "source_kind", "source_line", "sink_path", "sink", "sink_kind", "sink_line", "b.label", "b.via")


def _open_roots(files: DataFrame, config: TaintConfig) -> DataFrame:
    """Roots of packages that can't be seen on their own: they own names of others, ask for them, are asked for, or are called like a configured name."""
    whole = files.sparkSession.createDataFrame([(n,) for n in sorted(config.first_parts)], "root string")
    others = _cut(files.where("root = ''").select(F.explode("owns").alias("root")).distinct())
    if not others.where("root = '*'").isEmpty():  # names that a star import brings to the top can have any first part
        return files.select("root").distinct()
    asked = files.select(F.explode("asks").alias("root")).distinct()
    asked = _cut(asked.join(files.select("root").distinct().union(others), "root", "left_semi"))
    out = whole.union(others).union(asked)
    if not asked.isEmpty():
        out = out.union(files.select("root", F.explode("asks").alias("ask")).join(asked.withColumnRenamed("root", "ask"), "ask", "left_semi").select("root"))
    return out.distinct()


def shared_paths(files: DataFrame, config: TaintConfig | None = None) -> DataFrame:
    """``labelled_paths`` of ``files(path, content)``, found once for packages that are equal but for their name.

    A package is all files whose modules share their first part. It is seen on its own if it asks for no name of
    another package here and none asks for its names; then its flows follow from its facts alone, and those of equal facts with
    another name are the same under that name. All other packages are seen together, as they are. Files are parsed once; one
    row each is shuffled, and facts only of one package of each kind.
    """
    config = config or TaintConfig()
    files = _cut(file_facts(files))
    seen = _cut(_open_roots(files, config))
    parts = files.where("root <> ''").select("root", *(F.col(c).cast("decimal(20,0)").alias(c) for c in ("a", "b")))
    kind = ["n", "a", "b"]  # of a set of files, in any order
    packages = _cut(parts.groupBy("root").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).join(seen, "root", "left_anti"))
    first = _cut(packages.groupBy(*kind).agg(F.min("root").alias("first")))
    members = _cut(packages.join(first, kind).select("first", F.col("root").alias("member")))
    # the first package of each kind, and all that can't be seen on their own
    some = files.join(first.select(F.col("first").alias("root")), "root", "left_semi").select(*files.columns)
    alone = files.where("root = ''").union(files.where("root <> ''").join(seen, "root", "left_semi").select(*files.columns))
    some = _cut(some.union(alone))
    flows = labelled_paths(facts_again(some, files), config)
    flows = _cut(flows.join(some.select("path", "root").distinct(), "path"))
    flows = flows.join(members, F.col("root") == F.col("first"), "left")
    put = lambda c: F.concat("member", F.substr(c, F.length("first") + 1))
    is_led = lambda c: F.col(c).startswith(F.concat("first", F.lit("."))) | (F.col(c) == F.col("first"))
    shared = F.col("member").isNotNull()
    new = {"via": F.when(shared, F.transform("via", put))} | {c: F.when(shared, put(F.col(c))) for c in ("path", "sink_path")} | {c: F.when(shared & is_led(c), put(F.col(c))) for c in ("source", "sink")}
    return flows.select(*(F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in _PATHS))


_PATHS = ["path", "fn", "rule_id", "source", "source_kind", "source_line", "sink_path", "sink", "sink_kind", "sink_line", "label", "via"]
_COLUMNS = ["path", "fn", "rule_id", "source", "source_kind", "source_line", "sink", "sink_kind", "sink_line"]


def taint_flows(files: DataFrame, config: TaintConfig | None = None) -> DataFrame:
    """Flows of ``files(path, content)`` that weren't made safe for their sink."""
    return labelled_flows(files, config).where(F.col("label") != LABELS[0]).drop("label")


def labelled_flows(files: DataFrame, config: TaintConfig | None = None) -> DataFrame:
    """All flows, those made safe among them, with a label of how likely each can be used."""
    return shared_paths(files, config).select(*_COLUMNS, "label")
