"""Source files, infrastructure, manifests: expectations on small fixtures."""

import os

import pytest
import small_corpus as small

from lakewarden.operators import code_rules as C
from lakewarden.operators import iac
from lakewarden.operators.dataflow import taint_flows
from lakewarden.operators.sca import intervals
from lakewarden.sources.manifests import rows_of
from lakewarden.sources.python_facts import facts_of, python_facts
from lakewarden.sources.repo import read_repo


def test_flows_of_the_application(spark):
    got = {(r.fn, r.sink, r.sink_line) for r in taint_flows(small.files(spark).where("path like '%.py'")).collect()}
    assert got == {("run", "os.system", 11), ("run", "os.system", 17), ("run", "subprocess.run", 19), ("item", "open", 25), ("query", "cursor.execute", 31), ("safe", "os.system", 37)}


def test_facts_never_raise():
    assert facts_of("a.py", "def (")[0][6] == "SYNTAX_ERROR"
    assert facts_of("a.py", None)[0][6] == "LOAD_ERROR"
    assert facts_of("a.py", "x = " + "(" * 5000 + ")" * 5000)[0][1] == "error"
    assert facts_of("a.py", "") == []
    assert facts_of("a.py", "a\0b")[0][1] == "error"


def test_call_rules(spark):
    got = sorted((r.rule_id, r.line) for r in C.call_findings(python_facts(small.files(spark).where("path like '%.py'"))).where("path = 'svc/app.py'").collect())
    assert got == [("AST-001", 38), ("AST-001", 54), ("AST-004", 11), ("AST-004", 17), ("AST-004", 36), ("AST-004", 37), ("AST-005", 19), ("AST-006", 26), ("AST-007", 53), ("AST-008", 51)]


def test_events(spark):
    f = python_facts(small.files(spark).where("path like '%.py'")).cache()
    assert {r.event for r in C.dynamic_events(f).collect()} >= {"REFLECTION", "DYNAMIC_IMPORT", "DYNAMIC_EXECUTION", "DESERIALIZATION", "METACLASS", "MONKEY_PATCH", "DECORATOR"}
    assert [(r.line, r.check_line) for r in C.toctou(f).collect()] == [(25, 24)]
    assert {(r.src, r.dst) for r in C.lock_edges(f).collect()} == {("lock_a", "lock_b"), ("lock_b", "lock_a")}
    assert {r.event for r in C.install_events(f).collect()} == {"INSTALL_EXECUTION", "OBFUSCATED_EXECUTION", "PERSISTENCE"}
    assert {(r.handler, r.rule_id) for r in C.web_findings(C.routes(f)).collect()} == {("item", "WEB-003")}
    assert ("svc/other.py:entry", "svc/app.py:run", 2) in set(map(tuple, C.call_edges(f).collect()))


def test_dockerfiles_and_terraform(spark):
    got = {(r.path, r.line_no, r.rule_id) for r in iac.dockerfile_findings(small.files(spark)).collect()}
    assert got == {("Dockerfile", 1, "IAC-002"), ("Dockerfile", 2, "IAC-003"), ("api/Dockerfile.dev", 1, "IAC-001"), ("api/Dockerfile.dev", 1, "IAC-002"), ("api/Dockerfile.dev", 2, "IAC-003")}
    assert {(r.name, r.rule_id) for r in iac.terraform_findings(small.files(spark)).collect()} == {("logs", "IAC-011"), ("db", "IAC-012"), ("db", "IAC-013"), ("p", "IAC-014")}


def test_yaml_files(spark):
    pytest.importorskip("yaml")
    assert {(r.name, r.rule_id) for r in iac.yaml_findings(small.files(spark)).collect()} == {
        ("db", "IAC-004"), ("db", "IAC-006"), ("web", "IAC-005"), ("on", "IAC-016"), ("a", "IAC-015"), ("a", "IAC-017"), ("p", "IAC-007"), ("p", "IAC-008"), ("p", "IAC-009"), ("r", "IAC-010")
    }


@pytest.mark.parametrize(
    "doc,rules",
    [
        ({"services": {"a": {"privileged": True, "ports": ["5432:5432"]}, "b": {"network_mode": "host", "ports": ["127.0.0.1:22:22"]}}}, {"IAC-004", "IAC-005", "IAC-006"}),
        ({"kind": "Pod", "spec": {"hostNetwork": True, "containers": [{"securityContext": {"privileged": True}}]}}, {"IAC-007", "IAC-008", "IAC-009"}),
        ({"kind": "ClusterRole", "rules": [{"verbs": ["*"], "resources": ["*"]}]}, {"IAC-010"}),
        ({True: ["pull_request_target"], "jobs": {"x": {"steps": [{"uses": "a/b@v1"}, {"run": "echo ${{ github.event.issue.title }}"}, {"uses": "a/b@" + "0" * 40}]}}}, {"IAC-015", "IAC-016", "IAC-017"}),
    ],
)
def test_yaml_kinds(doc, rules):
    found = iac._kubernetes(doc) if "kind" in doc else iac._workflow(doc) if "jobs" in doc else iac._compose(doc)
    assert {r for _, r, _ in found} == rules


def test_manifests():
    names = lambda p, c: [(r[2], r[3]) for r in rows_of(p, c)]
    assert names("requirements.txt", "a==1\nb>=2\n# c\n-e .\n") == [("a", "1"), ("b", None)]
    assert names("pyproject.toml", '[project]\ndependencies = ["a==1"]\n[tool.poetry.dependencies]\nb = "^2"\n') == [("a", "1"), ("b", None)]
    assert names("poetry.lock", '[[package]]\nname = "a"\nversion = "1"\n') == [("a", "1")]
    assert names("Pipfile.lock", '{"default": {"a": {"version": "==1"}}}') == [("a", "1")]
    assert names("setup.cfg", "[options]\ninstall_requires =\n    a==1\n") == [("a", "1")]
    assert names("package-lock.json", '{"packages": {"": {}, "node_modules/a": {"version": "1"}}}') == [("a", "1")]
    assert names("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>") == [("g:a", "1")]
    assert names("build.gradle", "  implementation 'g:a:1'\n") == [("g:a", "1")]
    assert names("Gemfile", "gem 'a', '~> 1'\n") == [("a", None)]
    assert names("composer.json", '{"require": {"x/a": "1", "php": "8"}}') == [("x/a", None)]
    assert rows_of("requirements.txt", "git+ssh://git@h/o/t.git@main#egg=t")[0][2:] == ("t", None, "", True, False, "vcs", "main", 0)
    assert names("package.json", "{") == [] and names("pyproject.toml", "=") == []


def test_advisory_intervals(spark):
    e = spark.createDataFrame([("A", "p", 0, "introduced", "1"), ("A", "p", 1, "fixed", "2"), ("A", "p", 2, "introduced", "3"), ("B", "p", 0, "introduced", "0"), ("B", "p", 1, "last_affected", "4")], "id string, package string, ord int, kind string, version string")
    got = sorted((r.id, r.introduced, r.until, r.inclusive) for r in intervals(e).na.fill("-").collect())
    assert got == [("A", "1", "2", False), ("A", "3", "-", None), ("B", "0", "4", True)]


def test_repo_reads_hidden_files(spark, tmp_path):
    for p, text in {"a.py": "x", ".env": "K=1", "pkg/__init__.py": "", ".github/w.yml": "on: push", ".git/config": "no", "node_modules/m.js": "no", "pkg/deep/b.md": "# b"}.items():
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text(text)
    os.symlink("/etc", tmp_path / "pkg/link")
    got = {r.path: r for r in read_repo(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", ".env", "pkg/__init__.py", ".github/w.yml", "pkg/deep/b.md"}
    assert got[".env"].is_hidden and got["a.py"].is_python and got["a.py"].content == "x"
    assert [r.path for r in read_repo(spark, str(tmp_path / "a.py")).collect()] == ["a.py"]


def test_long_calls_and_bodies_count_whole(spark):
    from lakewarden.operators import code_rules
    from lakewarden.sources.python_facts import python_facts

    fill = "".join(f"    x{i} = {i}\n" for i in range(2500))
    web = f"@app.get('/a')\ndef a(item_id):\n{fill}    check_owner(item_id)\n\n@app.get('/b')\ndef b(q):\n{fill}    requests.get(q, verify=False)\n"
    files = [("web.py", web), ("run.py", f"exec(bytes.fromhex('{'61' * 3000}'.strip()) + b64decode(x))\nwrite('{'y' * 3000} /etc/cron.d/x')\nexec('{'z' * 3000}' + rot13(s))\n")]
    facts = python_facts(spark.createDataFrame(files, "path string, content string"))
    assert {(r.handler, r.rule_id) for r in code_rules.web_findings(code_rules.routes(facts)).collect()} == {("b", "WEB-004"), ("b", "WEB-008")}
    got = {(r.line, r.event) for r in code_rules.install_events(facts).collect()}
    assert {(1, "OBFUSCATED_EXECUTION"), (2, "PERSISTENCE"), (3, "OBFUSCATED_EXECUTION")} <= got
    assert max(len(r.text) for r in facts.where("kind = 'constant'").collect()) == 6000
