from lakewarden.operators import program_model as P
from lakewarden.operators.lines import exploded

FILES = [
    ("a.go", "func getUser(c *Context) {\n  id := c.Query(\"id\")\n  load(id)\n}\nfunc load(id string) {\n  run(id)\n}\nfunc run(q string) {\n  db.Query(q)\n}\n"),
    ("b.py", "def handler_a(request):\n    v = request.args\n    helper(v)\n\ndef helper(v):\n    v = shlex.quote(v)\n    os.system(v)\n    print(v)\n\ndef offline(x):\n    os.system(x)\n"),
    ("c.php", "function show() {\n  $v = $_GET['x'];\n  response.write($v);\n}\n"),
]


def test_flows(spark):
    lines = exploded(spark.createDataFrame(FILES, "path string, content string"), ["path"], "content")
    edges = {(r.src, r.dst) for r in P.call_edges(P.functions(lines)).collect()}
    assert edges == {("a.go:getUser", "a.go:load"), ("a.go:load", "a.go:run"), ("b.py:handler_a", "b.py:helper")}
    got = {(r.start, r.node, r.category, r.severity) for r in P.flows(lines).collect()}
    assert got == {("a.go:getUser", "a.go:run", "SQL", "CRITICAL"), ("c.php:show", "c.php:show", "HTML_OUTPUT", "HIGH")}


def test_no_flow_is_lost_among_many_paths(spark):
    """Eleven sanitised ways come first, the twelfth isn't sanitised; it stands before a further call."""
    ways = "".join(f"def m{i:02}(v):\n{'' if i == 11 else '    v = shlex.quote(v)' + chr(10)}    last(v)\n\n" for i in range(12))
    calls = "".join(f"    m{i:02}(v)\n" for i in range(12))
    body = f"def start(r):\n    v = request.args\n{calls}\n{ways}def last(v):\n    run(v)\n\ndef run(v):\n    os.system(v)\n    start(v)\n"
    lines = exploded(spark.createDataFrame([("a.py", body)], "path string, content string"), ["path"], "content")
    got = {(r.start, r.node, r.category, r.severity, tuple(r.path)) for r in P.flows(lines).collect()}
    assert got == {("a.py:start", "a.py:run", "SHELL_EXEC", "HIGH", ("a.py:start", "a.py:m11", "a.py:last", "a.py:run"))}


def test_names_that_many_files_define_lead_to_all_of_them(spark):
    """Forty callers and forty definitions are eighty rows, and every flow is found."""
    files = [(f"a{i}.py", f"def handler{i}(r):\n    v = request.args\n    get(v)\n") for i in range(40)] + [(f"b{i}.py", "def get(v):\n    os.system(v)\n") for i in range(40)]
    lines = exploded(spark.createDataFrame(files, "path string, content string"), ["path"], "content")
    fn = P.functions(lines)
    assert P.call_edges(fn).count() == 40 == P.members(fn).count()
    got = {(r.start, r.node, tuple(r.path)) for r in P.flows(lines).where("start <> node").collect()}
    assert {(f"a{i}.py:handler{i}", f"b{j}.py:get", (f"a{i}.py:handler{i}", f"b{j}.py:get")) for i in range(40) for j in range(40)} <= got
