"""Source files derived from the documents, and what the operators must find in them, as SQL.

Each document becomes a Python module (its whole text is a constant there) and, by remainders of its id, some
infrastructure files and manifests. A module is put together from snippets; a snippet is in the modules whose
id has its remainder. ``EXPECTED`` lists by hand what each operator finds in each snippet, by the snippet's own
lines; SQL over the documents places these rows at the lines where the snippet begins. So the same operators
are held against SQL whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import spread, table

#: name, modulus, remainder, lines. The first is in every module, after the line with the text.
SNIPPETS = (
    ("head", 1, 0, "import os, pickle, subprocess, threading, asyncio, jwt\nimport yaml as y\nfrom flask import Flask, request\nimport requests\napp = Flask(__name__)\nlock_a, lock_b = threading.Lock(), threading.Lock()\n"),
    ("shell", 2, 0, "def helper(value):\n    os.system('ls ' + value)\n@app.route('/run')\ndef run():\n    cmd = request.args['cmd']\n    helper(cmd)\n    os.system(cmd)\n    subprocess.run(['ls', cmd], shell=False)\n    subprocess.run(cmd, shell=True)\n"),
    ("files", 3, 0, "@app.get('/file/<id>')\ndef item(id):\n    name = request.args.get('name')\n    if os.path.exists(name):\n        return open(name).read()\n    return pickle.loads(request.data)\n"),
    ("query", 5, 0, "def query(cursor):\n    user = request.form['user']\n    cursor.execute('SELECT 1 WHERE a = ?', (user,))\n    cursor.execute('SELECT 1 WHERE a = ' + user)\n"),
    ("safe", 7, 0, "def safe():\n    import shlex, html\n    v = request.args['v']\n    os.system('ls ' + shlex.quote(v))\n    os.system('ls ' + html.escape(v))\n    eval(int(v))\n"),
    ("locks", 4, 0, "def both():\n    with lock_a:\n        with lock_b:\n            pass\ndef reverse():\n    with lock_b:\n        with lock_a:\n            pass\n"),
    ("order", 4, 1, "def one_way():\n    with lock_a:\n        with lock_b:\n            pass\n"),
    ("odd", 6, 0, "def odd(obj, name):\n    getattr(obj, name)\n    getattr(obj, 'known')\n    y.load(name)\n    eval('1 + 1')\n    obj.run = odd\n    handlers[name](obj)\n    vars()\nclass Meta(type):\n    pass\nclass Model(metaclass=Meta):\n    pass\n"),
    ("fetch", 8, 0, "@app.post('/fetch')\ndef fetch(q):\n    return requests.get(q, verify=False)\n"),
    ("hidden", 9, 0, "exec(base64.b64decode('cHJpbnQoMSk='))\nopen('.git/hooks/post-commit', 'w')\n"),
    ("chain", 10, 0, "def c0(a):\n    c1(a)\ndef c1(a):\n    c2(a)\ndef c2(a):\n    c3(a)\ndef c3(a):\n    c4(a)\ndef c4(a):\n    eval(a)\nc0(request.args['deep'])\n"),
    ("tasks", 11, 0, "shared = {}\nasync def work():\n    global shared\n    shared = await asyncio.gather(step())\nasync def step():\n    await asyncio.sleep(1)\ndef begin():\n    threading.Thread(target=work).start()\n    asyncio.create_task(step())\nclass Counter:\n    total = 0\n"),
    ("token", 12, 0, "def token(t):\n    return jwt.decode(t, options={'verify_signature': False})\napp.run(debug=True)\n"),
)
NAMES = tuple(s[0] for s in SNIPPETS)
#: variants of other files: kind, path before and after the id, modulus, contents by quotient.
FILES = (
    ("docker", "img", "/Dockerfile", 5, ("FROM python:latest AS build\nARG API_TOKEN=x\nFROM build\nFROM alpine:3.20\nENV PATH=/bin\nUSER app\n", "FROM debian\nENV MODE=1 DB_PASSWORD=swordfish\n", "FROM scratch\nUSER 1000\n")),
    ("terraform", "tf", "/main.tf", 6, ('resource "aws_s3_bucket" "logs" {\n  acl = "public-read"\n}\nresource "aws_db_instance" "db" {\n  publicly_accessible = true\n  encrypted = false\n}\n', 'variable "x" {\n  default = "*"\n}\nresource "aws_iam_policy" "p" {\n  action = "*"\n}\n')),
    ("compose", "svc", "/compose.yaml", 7, ("services:\n  db:\n    privileged: true\n    ports: ['5432:5432']\n  web:\n    network_mode: host\n", "services:\n  api:\n    ports: ['127.0.0.1:22:22', '5430-5440:80']\n")),
    ("workflow", "ci", "/.github/workflows/ci.yml", 8, ("on: pull_request_target\njobs:\n  a:\n    steps:\n      - uses: a/b@v1\n      - run: echo ${{ github.event.issue.title }}\n", "on: push\njobs:\n  b:\n    steps:\n      - uses: ./local\n")),
    ("k8s", "k8s", "/pod.yaml", 9, ("kind: Pod\nmetadata: {name: p}\nspec:\n  hostNetwork: true\n  containers:\n    - securityContext: {privileged: true}\n---\nkind: ClusterRole\nmetadata: {name: r}\nrules:\n  - verbs: ['*']\n    resources: ['*']\n", "kind: CronJob\nmetadata: {name: c}\nspec:\n  jobTemplate:\n    spec:\n      template:\n        spec:\n          containers:\n            - securityContext: {runAsNonRoot: true}\n            - name: other\n")),
    ("requirements", "req", "/requirements.txt", 4, ("six==1.16.0\nflask>=2.0\nrequests\n# note\ngit+https://host/org/tool.git@main#egg=tool\nhttps://host/pkg-1.0.tar.gz\nidna==3.7 \\\n  --hash=sha256:aa\n-r other.txt\n", "six==1.15.0\nhelper\n")),
    ("npm", "web", "/package.json", 10, ('{"dependencies": {"left": "1.2.3", "right": "^2.0.0"}, "devDependencies": {"lint": "*"}}', "{")),
    ("go", "go", "/go.mod", 11, ("module x\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d v0.1.0 // indirect\n)\n",)),
)


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of a Python module for every document."""
    d, i = spread(table(spark, sf_dir, "documents")), F.col("doc_id")
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    parts = [F.when(i % m == r, F.lit(code)).otherwise("") if m > 1 else F.lit(code) for _, m, r, code in SNIPPETS]
    return d.select(F.concat(F.lit("svc"), (i % 10).cast("string"), F.lit("/mod"), i.cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("META = "), text, F.lit("\n"), *parts).alias("content"))


def other_files(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """path, content of the other files of some kinds: a variant by the quotient of the id."""
    i, out = F.col("doc_id"), None
    for kind, before, after, m, texts in FILES:
        if kind in kinds:
            content = F.element_at(F.array(*map(F.lit, texts)), (F.floor(i / m) % len(texts) + 1).cast("int"))
            some = table(spark, sf_dir, "documents").where(i % m == 0).select(F.concat(F.lit(before), i.cast("string"), F.lit(after)).alias("path"), content.alias("content"))
            out = some if out is None else out.union(some)
    return out


def literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], cols: list[str]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({', '.join(cols)})"


PATH = "'svc' || (doc_id % 10) || '/mod' || doc_id || '.py'"


def placed(cols: list[str], by_snippet: dict[str, list[tuple]], lines: tuple[str, ...] = ("line",)) -> str:
    """SELECT of path and ``cols`` for every module; columns in ``lines`` are moved to where the snippet begins."""
    out, before = [], "1"
    for name, m, r, code in SNIPPETS:
        if rows := by_snippet.get(name):
            moved = ", ".join(f"(t.{c} + {before})::INT AS {c}" if c in lines else f"t.{c}" for c in cols)
            out.append(f"SELECT {PATH} AS path, {moved} FROM documents, {_values(rows, cols)} WHERE doc_id % {m} = {r}")
        n = code.count("\n")
        before += f" + {n}" if m == 1 else f" + CASE WHEN doc_id % {m} = {r} THEN {n} ELSE 0 END"
    return " UNION ALL ".join(out)


def found(cols: list[str], by_kind: dict[str, list[list[tuple]]]) -> str:
    """SELECT of path and ``cols`` for the other files: rows for each variant of a kind."""
    out = []
    for kind, before, after, m, texts in FILES:
        for k, rows in enumerate(by_kind.get(kind, ())):
            if rows:
                out.append(f"SELECT {literal(before)} || doc_id || {literal(after)} AS path, {', '.join(f't.{c}' for c in cols)} FROM documents, {_values(rows, cols)} WHERE doc_id % {m} = 0 AND (doc_id // {m}) % {len(texts)} = {k}")
    return " UNION ALL ".join(out)
