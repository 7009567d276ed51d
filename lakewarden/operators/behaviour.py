"""Concurrency, frameworks and exploitability over Python facts: events from lookup tables, and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .code_rules import _short, decorated
from .graph import _cut

#: Event and the short names of the calls that make it.
CONCURRENCY = (
    ("TASK", ("create_task", "ensure_future", "Task")),
    ("GROUP", ("gather", "wait", "as_completed")),
    ("THREAD", ("Thread", "ThreadPoolExecutor")),
    ("PROCESS", ("Process", "ProcessPoolExecutor")),
    ("SYNC", ("Lock", "RLock", "Semaphore", "Event", "Condition", "Queue")),
)


def _cases(c: Column, rows) -> Column:
    return reduce(lambda acc, r: acc.when(c.isin(*r[1]), r[0]), rows[1:], F.when(c.isin(*rows[0][1]), rows[0][0]))


def concurrency_events(facts: DataFrame) -> DataFrame:
    """path, line, fn, event, target: async functions, awaits, tasks, threads, processes, locks, shared names."""
    kind = F.col("kind")
    event = (
        F.when(kind == "call", _cases(_short(F.col("resolved")), CONCURRENCY))
        .when((kind == "function") & (F.col("kwargs")["async"] == "True"), "ASYNC_FUNCTION")
        .when(kind == "await", "AWAIT")
        .when(kind == "global", "SHARED_GLOBAL")
        .when((kind == "assign") & (F.col("kwargs")["scope"] == "class"), "SHARED_ATTRIBUTE")
    )
    return facts.select("path", "line", "fn", event.alias("event"), F.col("resolved").alias("target")).where("event is not null")


def summary(events: DataFrame, *keys: str) -> DataFrame:
    """Counts of an event table: one row for each path and key."""
    return events.groupBy("path", *keys).agg(F.count("*").alias("events"))


def malware_summary(install: DataFrame) -> DataFrame:
    """Per file the kinds of hostile events, and its risk: 90 with any but mere persistence, else 10."""
    hot = F.col("event").isin("INSTALL_EXECUTION", "OBFUSCATED_EXECUTION", "PERSISTENCE")
    return install.groupBy("path").agg(*(F.count_if(F.col("event") == e).alias(e.lower()) for e in ("INSTALL_EXECUTION", "OBFUSCATED_EXECUTION", "PERSISTENCE")), F.max(F.when(hot, 90).otherwise(10)).alias("risk"))


#: Framework, what its extra sources and sinks are called.
FRAMEWORK_SOURCES = (
    ("Flask", ("request.args", "request.form", "request.json", "request.data", "request.values", "request.headers", "request.cookies", "request.files")),
    ("FastAPI", ("Query", "Path", "Header", "Cookie", "Body", "Form", "File")),
    ("Django", ("request.GET", "request.POST", "request.FILES", "request.COOKIES", "request.headers", "request.body")),
    ("Celery", ("task_args",)),
)
FRAMEWORK_SINKS = (
    ("Flask", ("render_template_string", "send_file", "send_from_directory")),
    ("Django", ("raw", "extra", "connection.cursor")),
    ("SQLAlchemy", ("text", "session.execute", "engine.execute")),
    ("HTTP", ("requests.get", "requests.post", "requests.request", "httpx.get", "httpx.post", "urllib.request.urlopen")),
)
SENSITIVE = ("admin", "user", "account", "payment", "delete", "secret", "config")


#: What makes an object that routes hang on.
APPLICATIONS = (("flask.Flask", "Flask"), ("flask.Blueprint", "Flask"), ("fastapi.FastAPI", "FastAPI"), ("fastapi.APIRouter", "FastAPI"))

#: What decorators and calls that make routes are called.
WEB_VERBS, TASK_VERBS, URL_CALLS = ("route", "get", "post", "put", "delete", "patch", "api_route"), ("task", "shared_task"), ("path", "re_path")


def applications(facts: DataFrame) -> DataFrame:
    """path, app, made: variables that hold an application or a group of routes, by framework."""
    made = F.lit(None).cast("string")
    for name, framework in APPLICATIONS:
        made = F.when(F.col("resolved") == name, F.lit(framework)).otherwise(made)
    calls = facts.where("kind = 'call'").select("path", "line", made.alias("made")).where("made is not null")
    return facts.where("kind = 'assign'").select("path", "line", F.col("name").alias("app")).join(calls, ["path", "line"]).groupBy("path", "app").agg(F.min("made").alias("made"))


def framework_routes(facts: DataFrame) -> DataFrame:
    """path, line, framework, handler, route, verb of decorators, Django url tables and Celery tasks.

    The facts that can matter are written once, since joins read them several times: files are parsed once.
    """
    kind, short = F.col("kind"), _short(F.col("name"))
    some = (
        (kind == "assign")
        | ((kind == "decorator") & short.isin(*WEB_VERBS, *TASK_VERBS))
        | ((kind == "import") & F.split_part("name", F.lit("."), F.lit(1)).isin("flask", "fastapi", "celery"))
        | ((kind == "call") & (F.col("resolved").isin(*(name for name, _ in APPLICATIONS)) | short.isin(*URL_CALLS)))
    )
    items = F.when(kind.isin("decorator", "call"), F.col("items"))
    return _framework_routes(_cut(facts.where(some).select("path", "kind", "line", "name", "resolved", items.alias("items"))))


def _framework_routes(facts: DataFrame) -> DataFrame:
    d = facts.where("kind = 'decorator'").withColumn("verb", _short(F.col("name")))
    imports = facts.where("kind = 'import'").select("path", F.split_part("name", F.lit("."), F.lit(1)).alias("top")).where("top in ('flask', 'fastapi', 'celery')").distinct()
    one = imports.where("top in ('flask', 'fastapi')").groupBy("path").agg(F.collect_set("top").alias("tops"))
    web = d.where(F.col("verb").isin(*WEB_VERBS)).join(one, "path").withColumn("app", F.split_part("name", F.lit("."), F.lit(1)))
    # of two frameworks in a file the one that made the route's object counts, else the verb that only Flask has
    guess = F.when(F.size("tops") == 1, F.when(F.col("tops")[0] == "flask", "Flask").otherwise("FastAPI")).otherwise(F.when(F.col("verb") == "route", "Flask").otherwise("FastAPI"))
    web = web.join(applications(facts), ["path", "app"], "left")
    web = web.select("path", "line", F.coalesce("made", guess).alias("framework"), F.col("items")[0].alias("handler"), F.regexp_replace(F.get("items", F.lit(1)), "^['\"]|['\"]$", "").alias("route"), "verb")
    jobs = d.where(F.col("verb").isin(*TASK_VERBS)).join(imports.where("top = 'celery'"), "path").select("path", "line", F.lit("Celery").alias("framework"), F.col("items")[0].alias("handler"), F.concat(F.lit("/"), F.col("items")[0]).alias("route"), "verb")
    urls = facts.where("kind = 'call' and path rlike '(^|/)urls\\.py$'").where(_short(F.col("name")).isin(*URL_CALLS))
    urls = urls.select("path", "line", F.lit("Django").alias("framework"), F.get("items", F.lit(1)).alias("handler"), F.regexp_replace(F.get("items", F.lit(0)), "^['\"]|['\"]$", "").alias("route"), _short(F.col("name")).alias("verb"))
    return web.union(jobs).union(urls)


def framework_uses(facts: DataFrame) -> DataFrame:
    """path, line, framework, role (SOURCE or SINK), name: calls of names that a framework adds."""
    c = facts.where("kind = 'call'")
    whole = F.concat(F.lit("."), "resolved", F.lit("."))
    hits = [F.when(F.contains(whole, F.lit(f".{n}.")), F.struct(F.lit(fw).alias("framework"), F.lit(role).alias("role"), F.lit(n).alias("name"))) for role, rows in (("SOURCE", FRAMEWORK_SOURCES), ("SINK", FRAMEWORK_SINKS)) for fw, names in rows for n in names]
    return c.withColumn("hit", F.explode(F.array_compact(F.array(*hits)))).select("path", "line", "hit.*")


def framework_findings(facts: DataFrame) -> DataFrame:
    """Debug runs, fixed secret keys, exempted views, debug settings, unverified tokens, open sensitive routes.

    As for the routes, the facts are written once.
    """
    facts = _cut(facts.where("kind in ('assign', 'call', 'class', 'decorator', 'function', 'import')").select("path", "kind", "ord", "line", "name", "resolved", "kwargs", "items", "text"))
    kind, item = F.col("kind"), lambda i: F.get("items", F.lit(i))
    rule = (
        F.when((kind == "assign") & F.col("name").rlike(r"(^|\.)(secret_key|SECRET_KEY)$") & (item(0) == "Constant"), "FIXED-SECRET-KEY")
        .when((kind == "decorator") & (_short(F.col("name")) == "csrf_exempt"), "DJANGO-CSRF-EXEMPT")
        .when((kind == "assign") & (F.col("name") == "DEBUG") & (item(1) == "True"), "DJANGO-DEBUG")
        .when((kind == "call") & (F.col("resolved") == "jwt.decode") & ((F.col("kwargs")["verify"] == "False") | F.col("text").rlike(r"verify_signature['\"]: False")), "JWT-UNVERIFIED")
    )
    found = facts.select("path", "line", rule.alias("rule_id")).where("rule_id is not null")
    # a run in debug mode counts for a Flask application, or what is called one in a file that imports Flask
    flask = facts.where("kind = 'import'").where(F.split_part("name", F.lit("."), F.lit(1)) == "flask").select("path").distinct()
    runs = facts.where("kind = 'call'").where(F.col("name").rlike(r"^[^.]+\.run$") & (F.col("kwargs")["debug"] == "True")).withColumn("app", F.split_part("name", F.lit("."), F.lit(1)))
    runs = runs.join(flask, "path", "left_semi").join(applications(facts), ["path", "app"], "left").where(F.coalesce(F.col("made") == "Flask", F.col("app").rlike("(?i)(^|_)app(lication)?$")))
    found = found.union(runs.select("path", "line", F.lit("FLASK-DEBUG").alias("rule_id")))
    of = decorated(facts).select("path", "line", F.col("items")[0].alias("handler"), "of").distinct()
    body = facts.where("kind = 'function'").select("path", F.col("ord").alias("of"), F.lower("text").alias("body"))
    open_ = _framework_routes(facts).where("framework = 'FastAPI'").join(of, ["path", "line", "handler"]).join(body, ["path", "of"]).where(F.lower("route").rlike("|".join(SENSITIVE)) & ~F.col("body").rlike("depends|security|oauth|current_user"))
    return found.union(open_.select("path", "line", F.lit("FASTAPI-OPEN-ROUTE").alias("rule_id")))
