"""Rules over Python facts: declarative rows on calls, and events of behaviour, concurrency and web routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import _cut, strong_components

#: rule, severity, confidence, category, resolved call names.
CALL_RULES = (
    ("AST-001", "HIGH", "HIGH", "CODE_INJECTION", ("eval", "builtins.eval")),
    ("AST-002", "HIGH", "HIGH", "CODE_INJECTION", ("exec", "builtins.exec")),
    ("AST-003", "HIGH", "MEDIUM", "CODE_INJECTION", ("compile", "builtins.compile")),
    ("AST-004", "HIGH", "HIGH", "CODE_INJECTION", ("os.system",)),
    ("AST-005", "HIGH", "HIGH", "CODE_INJECTION", ("subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_call", "subprocess.check_output")),
    ("AST-006", "HIGH", "HIGH", "UNSAFE_DESERIALIZATION", ("pickle.load", "pickle.loads", "pickle.Unpickler", "cPickle.load", "cPickle.loads")),
    ("AST-007", "HIGH", "HIGH", "UNSAFE_DESERIALIZATION", ("yaml.load",)),
    ("AST-008", "MEDIUM", "MEDIUM", "CODE_INJECTION", ("__import__", "importlib.import_module")),
    ("AST-010", "HIGH", "HIGH", "CODE_INJECTION", ("os.popen",)),
)


def call_findings(facts: DataFrame) -> DataFrame:
    """Calls by their resolved name; subprocess calls count only where ``shell`` isn't off."""
    calls = facts.where("kind = 'call'")
    shell = F.coalesce(F.col("kwargs")["shell"], F.lit("False"))
    hits = []
    for rule, severity, confidence, category, names in CALL_RULES:
        cond = F.col("resolved").isin(*names)
        if rule == "AST-005":
            cond = cond & ~shell.isin("False", "0", "None")
        hits.append(F.when(cond, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(category).alias("category"))))
    out = calls.withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    return out.select("path", "line", "fn", "resolved", "hit.*")


def _short(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def _is_literal(i: int) -> Column:
    return F.coalesce(F.get(F.col("items"), F.lit(i)), F.lit("<expression>")).rlike(r"^(b?['\"]|-?\d|True$|False$|None$)")


#: Texts of facts that ``dynamic_events`` looks at.
DYNAMIC_TEXTS = ("call:yaml.load",)


def dynamic_events(facts: DataFrame, conservative: bool = False) -> DataFrame:
    """Reflection, dynamic imports and code, deserialisation, metaclasses, patches, dispatch, registrations.

    ``conservative`` keeps what is certain: states EXACT and HIGH_CONFIDENCE.
    """
    has = lambda *n: _short(F.col("resolved")).isin(*n)
    exact = lambda i: F.when(_is_literal(i), "EXACT").otherwise("UNKNOWN")
    event = (
        F.when(has("getattr", "hasattr", "delattr", "setattr") & (F.col("n_args") >= 2), F.struct(F.lit("REFLECTION").alias("event"), exact(1).alias("state")))
        .when(has("globals", "locals", "vars"), F.struct(F.lit("REFLECTION").alias("event"), F.lit("PARTIAL").alias("state")))
        .when(has("__import__", "import_module"), F.struct(F.lit("DYNAMIC_IMPORT").alias("event"), exact(0).alias("state")))
        .when(F.col("name").isin("eval", "exec", "compile") & (F.col("n_args") > 0), F.struct(F.lit("DYNAMIC_EXECUTION").alias("event"), exact(0).alias("state")))
        .when(F.col("resolved").rlike(r"^(c?pickle|marshal)\.(loads?|Unpickler)$") | F.col("resolved").isin("yaml.unsafe_load", "yaml.full_load"), F.struct(F.lit("DESERIALIZATION").alias("event"), F.lit("HIGH_CONFIDENCE").alias("state")))
        .when((F.col("resolved") == "yaml.load") & ~F.coalesce(F.col("kwargs")["Loader"], F.lit("")).rlike("SafeLoader") & ~F.contains("text", F.lit("SafeLoader")), F.struct(F.lit("DESERIALIZATION").alias("event"), F.lit("HIGH_CONFIDENCE").alias("state")))
        .when((F.col("name") == "type") & (F.col("n_args") == 3), F.struct(F.lit("METACLASS").alias("event"), exact(0).alias("state")))
        .when(has("entry_points", "iter_entry_points", "load_entry_point"), F.struct(F.lit("PLUGIN_LOADING").alias("event"), F.lit("PARTIAL").alias("state")))
        .when(has("register", "connect", "add_url_rule", "add_api_route", "register_blueprint"), F.struct(F.lit("RUNTIME_REGISTRATION").alias("event"), exact(0).alias("state")))
    )
    call = F.col("kind") == "call"
    other = (
        F.when((F.col("kind") == "class") & F.col("kwargs")["metaclass"].isNotNull(), "METACLASS")
        .when((F.col("kind") == "assign") & F.contains("name", F.lit(".")) & ~F.col("name").rlike(r"^(self|cls|<dynamic>)\."), "MONKEY_PATCH")
        .when(F.col("kind") == "decorator", "DECORATOR")
        .when(F.col("kind") == "dispatch", "DYNAMIC_DISPATCH")
        .when((F.col("kind") == "function") & (F.col("name") == "__reduce__"), "DESERIALIZATION")
    )
    state = F.when(F.col("kind") == "assign", "HIGH_CONFIDENCE").when((F.col("kind") == "dispatch") & (F.col("text") == "table"), "PARTIAL").when(F.col("kind") == "dispatch", "UNKNOWN").otherwise("EXACT")
    # calls and the rest in one pass over the facts, so files are parsed once
    e = F.when(call, event).otherwise(F.when(other.isNotNull(), F.struct(other.alias("event"), state.alias("state"))))
    out = facts.select("path", "line", "fn", e.alias("e"), F.when(call, F.col("resolved")).otherwise(F.col("name")).alias("target")).where("e is not null").select("path", "line", "fn", "e.event", "e.state", "target")
    return out.where(F.col("state").isin("EXACT", "HIGH_CONFIDENCE")) if conservative else out


CHECKS = ("exists", "access", "isfile", "isdir", "check_permission", "has_perm")
USES = ("open", "remove", "unlink", "chmod", "chown", "withdraw", "update")


def toctou(facts: DataFrame) -> DataFrame:
    """Uses after a check in the same function."""
    c = facts.where("kind = 'call'").withColumn("short", _short(F.col("name"))).where(F.col("short").isin(*CHECKS, *USES))
    w = W.partitionBy("path", "fn").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return c.withColumn("check_line", F.max(F.when(F.col("short").isin(*CHECKS), F.col("line"))).over(w)).where(F.col("short").isin(*USES) & F.col("check_line").isNotNull()).select("path", "fn", "line", "check_line", "resolved")


def lock_edges(facts: DataFrame) -> DataFrame:
    """held -> taken, for every lock taken while another is held; cycles are possible deadlocks."""
    return facts.where("kind = 'lock'").select("path", F.col("items")[0].alias("src"), F.col("items")[1].alias("dst")).distinct()


def lock_cycles(edges: DataFrame) -> DataFrame:
    """(path, cycle): for every edge of a file's lock order that lies on a cycle a shortest cycle through it, from its least lock on.

    Only edges inside strong components can; there each is followed back to where it began, however long the way. So every
    pair of locks in a wrong order is shown, and rows are at most as many as edges.
    """
    e = _cut(edges.select("path", "src", "dst").distinct())  # read more than once: files are parsed once
    name = lambda c: F.concat("path", F.lit("\0"), F.col(c))
    part = strong_components(e.select(name("src").alias("src"), name("dst").alias("dst")))
    inner = e.withColumns({"node": name("src"), "to": name("dst")}).join(part, "node").withColumnRenamed("component", "c")
    inner = _cut(inner.join(part.select(F.col("node").alias("to"), F.col("component").alias("c")), ["to", "c"]).select("path", "src", "dst"))
    at = inner.select("path", F.col("src").alias("first"), F.col("dst").alias("second"), F.col("dst").alias("node"), F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst")).alias("cycle"))
    found, known = at.where("first = node"), None
    at = at.where("first <> node")
    key = ["path", "first", "second", "node"]
    while True:
        known = at.select(*key) if known is None else _cut(known.union(at.select(*key)))
        step = at.join(inner.select("path", F.col("src").alias("node"), F.col("dst").alias("next")), ["path", "node"])
        step = step.select("path", "first", "second", F.col("next").alias("node"), F.when(F.col("next") == F.col("first"), F.col("cycle")).otherwise(F.concat("cycle", F.array("next"))).alias("cycle"))
        at = _cut(step.groupBy(*key).agg(F.min("cycle").alias("cycle")).join(known, key, "left_anti"))
        if at.isEmpty():
            break
        found = found.union(at.where("first = node"))
        at = at.join(found.select("path", "first", "second"), ["path", "first", "second"], "left_anti")
    least = F.array_position("cycle", F.array_min("cycle")).cast("int")
    turned = F.concat(F.slice("cycle", least, F.size("cycle")), F.slice("cycle", F.lit(1), least - 1))
    return found.select("path", turned.alias("cycle")).distinct()


VERBS = ("route", "get", "post", "put", "delete", "patch", "api_route")


def decorated(facts: DataFrame) -> DataFrame:
    """Decorators with ``of``, the place of the function that each stands at (the last one before it, whatever its name), and ``at``, its kind, text and items."""
    w = W.partitionBy("path").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    some = facts.where("kind in ('function', 'class', 'decorator')")
    stands = F.last(F.when(F.col("kind") != "decorator", F.struct("ord", "kind", "text", "items")), True).over(w)
    return some.withColumn("at", stands).withColumn("of", F.col("at.ord")).where("kind = 'decorator'")


def routes(facts: DataFrame) -> DataFrame:
    """Routes from decorators, with keyword evidence from the handler's body.

    A route that changes nothing (GET) needs no protection against forged requests.
    """
    d = decorated(facts).where(_short(F.col("name")).isin(*VERBS) & (F.col("at.kind") == "function"))
    j = d.select("path", "line", F.lower("at.text").alias("body"), F.col("at.items").alias("params"), F.col("items")[0].alias("handler"), F.regexp_replace(F.get(F.col("items"), F.lit(1)), "^['\"]|['\"]$", "").alias("route"), _short(F.col("name")).alias("verb"))
    text = F.col("body")
    return j.select(
        "path", "line", "handler", "route", "verb",
        text.rlike("login_required|current_user|authenticate|depends|authorization").alias("authenticated"),
        text.rlike("owner|user_id ==|belongs_to|current_user.id").alias("checks_owner"),
        F.exists("params", lambda a: a.rlike("(^|_)id$")).alias("takes_id"),
        text.rlike(r"(requests|httpx)\.(get|post|request)\(|urlopen\(").alias("fetches_url"),
        text.rlike("verify_signature['\"]?: false|verify=false").alias("skips_signature"),
        text.rlike("role|is_admin|permission|has_perm").alias("checks_role"),
        (~F.col("verb").isin("post", "put", "delete", "patch")).alias("csrf_safe"),
        (text.rlike("allow_origins?=?.*['\"]\\*['\"]") & text.contains("credentials")).alias("open_cors"),
    )


def web_findings(route_rows: DataFrame) -> DataFrame:
    hits = F.array_compact(
        F.array(
            F.when(F.col("takes_id") & ~F.col("checks_owner"), F.struct(F.lit("WEB-003").alias("rule_id"), F.lit("HIGH").alias("severity"))),
            F.when(F.col("skips_signature"), F.struct(F.lit("WEB-004").alias("rule_id"), F.lit("CRITICAL").alias("severity"))),
            F.when(F.col("fetches_url"), F.struct(F.lit("WEB-008").alias("rule_id"), F.lit("HIGH").alias("severity"))),
        )
    )
    return route_rows.withColumn("hit", F.explode(hits)).select("path", "line", "handler", "route", "hit.*")


def install_events(facts: DataFrame) -> DataFrame:
    """Code that runs at install time, obfuscated execution, and writes to places that persist."""
    c = facts.where("kind = 'call'")
    setup = F.col("path").rlike(r"(^|/)setup\.py$|build")
    kinds = F.array_compact(
        F.array(
            F.when(setup & F.col("resolved").rlike(r"^(os\.system|os\.popen|subprocess\.|eval$|exec$|requests\.|urllib\.)"), "INSTALL_EXECUTION"),
            F.when(F.col("name").isin("eval", "exec") & F.col("text").rlike(r"b64decode|decompress|fromhex|rot13"), "OBFUSCATED_EXECUTION"),
            F.when(F.col("text").rlike(r"\.git/hooks|\.bashrc|\.profile|crontab|/etc/cron|systemd|authorized_keys|LaunchAgents"), "PERSISTENCE"),
        )
    )
    return c.withColumn("event", F.explode(kinds)).select("path", "line", "fn", "resolved", "event")


FRAMEWORKS = (("Flask", "flask"), ("FastAPI", "fastapi"), ("Django", "django"), ("Celery", "celery"), ("SQLAlchemy", "sqlalchemy"), ("Pydantic", "pydantic"), ("Jinja2", "jinja2"), ("HTTP", "requests"), ("HTTP", "httpx"), ("Auth", "jwt"), ("Auth", "bcrypt"), ("Auth", "passlib"))


def frameworks(facts: DataFrame) -> DataFrame:
    """Frameworks that imports tell of, with the number of imports."""
    top = F.split_part(F.col("name"), F.lit("."), F.lit(1))
    name = reduce(lambda acc, f: acc.when(top == f[1], f[0]), FRAMEWORKS[1:], F.when(top == FRAMEWORKS[0][1], FRAMEWORKS[0][0]))
    return facts.where("kind = 'import'").withColumn("framework", name).where("framework is not null").groupBy("path", "framework").agg(F.count("*").alias("imports"))


def call_edges(facts: DataFrame) -> DataFrame:
    """caller -> callee within and across files, by tiers: own file (plain names, self and cls), import, short name.

    Each tier takes only what the ones before left. A short name that several files define, and that nothing
    else resolves, leads to the one node ``*:name`` (tier 4) instead of to each of them; ``name_members`` tells
    which functions that is. So a name like ``get`` never joins all its calls with all its definitions.
    Facts and what each tier leaves are written once: files are parsed once, and no tier is found again for the next. So are
    the edges, whose joins then broadcast what is small as rows only.
    """
    facts = _cut(facts.where("kind in ('function', 'call', 'import')").select("path", "kind", "fn", "name", "resolved", "items"))
    fns = _defined(facts)
    plain = ~F.contains("name", F.lit(".")) | F.col("name").rlike(r"^(self|cls)\.\w+$")
    calls = facts.where("kind = 'call'").select("path", F.when(F.col("fn") == "", "<module>").otherwise(F.col("fn")).alias("fn"), "resolved", _short(F.col("name")).alias("short"), F.split_part("name", F.lit("."), F.lit(1)).alias("head"), plain.alias("plain")).distinct()
    heads = facts.where("kind = 'import'").select("path", F.explode("items").alias("head"), F.lit(True).alias("imported")).distinct()
    calls = _cut(calls.join(heads, ["path", "head"], "left").select("path", "fn", "resolved", "short", "plain", F.coalesce("imported", F.lit(False)).alias("imported")))
    own = calls.where("plain and not imported").join(fns.select(F.col("to_path").alias("path"), "to_fn", "short"), ["path", "short"]).withColumn("to_path", F.col("path")).withColumn("tier", F.lit(1))
    own = _cut(own)
    left = _cut(calls.join(own.select("path", "fn", "resolved").distinct(), ["path", "fn", "resolved"], "left_anti"))
    # whole dotted names meet: a call's name is one of the tails of a function's full name
    tails = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", i, F.size("parts") - i + 1), "."))
    dotted = fns.withColumn("parts", F.split(F.concat_ws(".", "module", "to_fn"), r"\.")).select("to_path", "to_fn", F.explode(tails).alias("resolved"))
    # distinct names meet first: a name that is called everywhere is one row there
    met = _cut(left.select("resolved").where(F.contains("resolved", F.lit("."))).distinct().join(dotted, "resolved"))
    by_import = left.join(met, "resolved").withColumn("tier", F.lit(2))
    left = left.join(met.select("resolved").distinct(), "resolved", "left_anti")
    names = fns.groupBy("short").agg(F.count("*").alias("n"), F.min("to_path").alias("to_path"), F.min("to_fn").alias("to_fn"))
    # what an imported module holds is not ours by its short name alone
    last = left.where("not imported").join(names, "short").withColumn("tier", F.when(F.col("n") == 1, 3).otherwise(4))
    one = F.concat_ws(":", "to_path", "to_fn")
    cols = lambda d, dst: d.select(F.concat_ws(":", "path", "fn").alias("src"), dst.alias("dst"), "tier")
    return _cut(cols(own, one).union(cols(by_import, one)).union(cols(last, F.when(F.col("n") == 1, one).otherwise(F.concat(F.lit("*:"), "short")))).distinct())


def callback_edges(facts: DataFrame) -> DataFrame:
    """caller -> function that is handed over by name: arguments and ``target=`` of calls, and what tasks start."""
    call = F.col("kind") == "call"
    # what is no plain name (a constant, an expression) names no function
    handed = F.array_distinct(F.filter(F.concat("items", F.map_values("kwargs")), lambda v: ~v.rlike(r"^(b?['\"]|[-<\d])")))
    inside = F.concat_ws(".", F.when(F.col("fn") != "", F.col("fn")), F.col("name"))
    rows = facts.where("kind in ('function', 'call')").select("path", F.when(call, F.when(F.col("fn") == "", "<module>").otherwise(F.col("fn"))).alias("caller"), F.when(~call, inside).alias("to_fn"), F.explode(F.when(call, handed).otherwise(F.array("name"))).alias("handed"))
    # both sides of the join by one shuffle: files are parsed once, and nothing is written
    met = rows.groupBy("path", "handed").agg(F.collect_set("caller").alias("callers"), F.collect_set("to_fn").alias("fns")).where((F.size("callers") > 0) & (F.size("fns") > 0))
    return met.select("path", F.explode("callers").alias("fn"), "fns").select(F.concat_ws(":", "path", "fn").alias("src"), "path", F.explode("fns").alias("to_fn")).select("src", F.concat_ws(":", "path", "to_fn").alias("dst")).distinct()


def _defined(facts: DataFrame) -> DataFrame:
    """to_path, to_fn, short, module of every function."""
    module = F.regexp_replace(F.regexp_replace("to_path", r"\.py$", ""), "/", ".")
    fns = facts.where("kind = 'function'").select(F.col("path").alias("to_path"), F.concat_ws(".", F.when(F.col("fn") != "", F.col("fn")), F.col("name")).alias("to_fn"), F.col("name").alias("short"))
    return fns.distinct().withColumn("module", module)


def name_members(facts: DataFrame) -> DataFrame:
    """The functions that a node ``*:name`` of ``call_edges`` stands for."""
    fns = _defined(facts)
    many = fns.groupBy("short").count().where("count > 1").select("short")
    return fns.join(many, "short").select(F.concat(F.lit("*:"), "short").alias("node"), F.concat_ws(":", "to_path", "to_fn").alias("member"))
