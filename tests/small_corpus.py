"""A small corpus of source files for tests."""

APP = '''import os, pickle, subprocess, threading
import yaml as y
from flask import Flask, request
from importlib import import_module as load
import requests

app = Flask(__name__)
lock_a, lock_b = threading.Lock(), threading.Lock()

def helper(value):
    os.system("ls " + value)

@app.route("/run")
def run():
    cmd = request.args["cmd"]
    helper(cmd)
    os.system(cmd)
    subprocess.run(["ls", cmd], shell=False)
    subprocess.run(cmd, shell=True)

@app.get("/file/<id>")
def item(id):
    name = request.args.get("name")
    if os.path.exists(name):
        return open(name).read()
    return pickle.loads(request.data)

def query(cursor):
    user = request.form["user"]
    cursor.execute("SELECT 1 WHERE a = ?", (user,))
    cursor.execute("SELECT 1 WHERE a = '" + user + "'")

def safe():
    import shlex, html
    v = request.args["v"]
    os.system("ls " + shlex.quote(v))
    os.system("ls " + html.escape(v))
    eval(int(v))

def both():
    with lock_a:
        with lock_b:
            pass

def reverse():
    with lock_b:
        with lock_a:
            pass

def odd(obj, name):
    load("json")
    getattr(obj, name)
    y.load(name)
    eval("1 + 1")
    obj.run = run

class Meta(type):
    pass

class Model(metaclass=Meta):
    pass
'''
FILES = (
    ("svc/app.py", APP),
    ("svc/other.py", "from svc.app import run\n\ndef entry():\n    run()\n    unknown()\n"),
    ("setup.py", "import os, base64\nfrom setuptools import setup\nos.system('id')\nexec(base64.b64decode('cHJpbnQoMSk='))\nopen('.git/hooks/post-commit', 'w')\nsetup(name='x', install_requires=['six==1.16.0', 'idna'])\n"),
    ("bad.py", "def broken(:\n"),
    ("Dockerfile", "FROM python:latest AS build\nARG API_TOKEN=x\nFROM build\nFROM alpine:3.20\nENV PATH=/bin\nUSER app\n"),
    ("api/Dockerfile.dev", "FROM debian\nENV DB_PASSWORD swordfish\n"),
    ("main.tf", 'resource "aws_s3_bucket" "logs" {\n  acl = "public-read"\n}\nresource "aws_db_instance" "db" {\n  publicly_accessible = true\n  encrypted = false\n}\nvariable "x" {\n  default = "*"\n}\nresource "aws_iam_policy" "p" {\n  action = "*"\n}\n'),
    ("requirements.txt", "six==1.16.0\nflask>=2.0\nrequests\n# note\ngit+https://host/org/tool.git@main#egg=tool\nhttps://host/pkg-1.0.tar.gz\nidna==3.7 \\\n  --hash=sha256:aa\n-r other.txt\n"),
    ("web/package.json", '{"dependencies": {"left": "1.2.3", "right": "^2.0.0"}, "devDependencies": {"lint": "*"}}'),
    ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d v0.1.0 // indirect\n)\n"),
    ("compose.yaml", "services:\n  db:\n    privileged: true\n    ports: ['5432:5432']\n  web:\n    network_mode: host\n"),
    (".github/workflows/ci.yml", "on: pull_request_target\njobs:\n  a:\n    steps:\n      - uses: a/b@v1\n      - run: echo ${{ github.event.issue.title }}\n"),
    ("k8s/pod.yaml", "kind: Pod\nmetadata: {name: p}\nspec:\n  hostNetwork: true\n  containers:\n    - securityContext: {privileged: true}\n---\nkind: ClusterRole\nmetadata: {name: r}\nrules:\n  - verbs: ['*']\n    resources: ['*']\n"),
    ("broken/package.json", "{"),
    ("svc/flask.py", "x = 1\n"),
)


def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")
