"""Dependency manifests to rows (name, version, constraint, direct, dev, source); unreadable files give none."""

from __future__ import annotations

import configparser
import json
import os
import re
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, ecosystem string, name string, version string, spec string, is_direct boolean, is_dev boolean, source_type string, vcs_ref string, hashes int"
_REQ = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$")


def _row(eco, name, version=None, spec="", direct=True, dev=False, source="registry", ref=None, hashes=0):
    return (eco, name, version, spec, direct, dev, source, ref, hashes)


def requirement(line: str, dev: bool = False):
    hashes = line.count("--hash")
    text = re.split(r"\s--|\s#", f"{line} ")[0].partition(";")[0].strip()
    if not text or text[0] in "#-":
        return None
    if m := re.match(r"^(?:[\w.-]+\s*@\s*)?(git|hg|svn|bzr)\+(\S+)", text):
        url, _, frag = m[2].partition("#")
        egg = re.search(r"egg=([\w.-]+)", frag)
        tail = url.rpartition("/")[2]
        name = egg[1] if egg else text.partition("@")[0].strip() if re.match(r"^[\w.-]+\s*@\s", text) else "unknown-vcs-pkg"
        return _row("pypi", name, source="vcs", ref=tail.partition("@")[2] or None, dev=dev, hashes=hashes)
    if m := re.match(r"^(?:([\w.-]+)\s*@\s*)?(https?|ftp)://(\S+)", text):
        return _row("pypi", m[1] or re.split(r"[-.]", m[3].rpartition("/")[2])[0], source="url", dev=dev, hashes=hashes)
    m = _REQ.match(text)
    if not m:
        return None
    spec = m[2].strip().strip("()").replace(" ", "")
    exact = re.fullmatch(r"={2,3}([^,*]+)", spec)
    return _row("pypi", m[1], exact[1] if exact else None, spec, dev=dev, hashes=hashes)


def _requirements(path, content):
    dev = bool(re.search(r"dev|test|ci", os.path.basename(path)))
    for line in re.sub(r"\\\r?\n", " ", content).splitlines():
        if r := requirement(line.strip(), dev):
            yield r


def _poetry(table, dev):
    for name, v in (table or {}).items():
        if name == "python":
            continue
        if isinstance(v, dict):
            source = "vcs" if "git" in v else "url" if "url" in v else "registry"
            yield _row("pypi", name, None, str(v.get("version", "")), dev=dev, source=source, ref=v.get("rev") or v.get("tag") or v.get("branch"))
        else:
            yield _row("pypi", name, None, str(v), dev=dev)


def _pyproject(path, content):
    d = tomllib.loads(content)
    p = d.get("project", {})
    lists = [(p.get("dependencies", ()), False), *((v, k in ("dev", "test")) for k, v in p.get("optional-dependencies", {}).items())]
    for items, dev in lists:
        yield from filter(None, (requirement(x, dev) for x in items))
    t = d.get("tool", {}).get("poetry", {})
    yield from _poetry(t.get("dependencies"), False)
    yield from _poetry(t.get("dev-dependencies"), True)
    for k, g in t.get("group", {}).items():
        yield from _poetry(g.get("dependencies"), k in ("dev", "test"))


def _toml_lock(path, content):
    eco = "cargo" if path.endswith("Cargo.lock") else "pypi"
    for p in tomllib.loads(content).get("package", ()):
        yield _row(eco, p["name"], p.get("version"), direct=False, hashes=len(p.get("files", ())) or int("checksum" in p))


def _pipfile(path, content):
    d = tomllib.loads(content)
    yield from _poetry(d.get("packages"), False)
    yield from _poetry(d.get("dev-packages"), True)


def _pipfile_lock(path, content):
    d = json.loads(content)
    for key, dev in (("default", False), ("develop", True)):
        for name, v in d.get(key, {}).items():
            yield _row("pypi", name, str(v.get("version", "")).lstrip("=") or None, direct=False, dev=dev, hashes=len(v.get("hashes", ())))


def _setup_cfg(path, content):
    c = configparser.ConfigParser()
    c.read_string(content)
    for line in c.get("options", "install_requires", fallback="").splitlines():
        if r := requirement(line.strip()):
            yield r
    for group, text in c.items("options.extras_require") if c.has_section("options.extras_require") else ():
        for line in text.splitlines():
            if r := requirement(line.strip(), group in ("dev", "test", "tests")):
                yield r


def _setup_py(path, content):
    import ast

    for node in ast.walk(ast.parse(content)):
        if isinstance(node, ast.Call) and getattr(node.func, "id", getattr(node.func, "attr", "")) == "setup":
            for k in node.keywords:
                if k.arg == "install_requires" and isinstance(k.value, (ast.List, ast.Tuple)):
                    yield from filter(None, (requirement(e.value) for e in k.value.elts if isinstance(e, ast.Constant)))
                if k.arg == "extras_require" and isinstance(k.value, ast.Dict):
                    for g, v in zip(k.value.keys, k.value.values, strict=True):
                        if isinstance(g, ast.Constant) and isinstance(v, (ast.List, ast.Tuple)):
                            yield from filter(None, (requirement(e.value, g.value in ("dev", "test", "tests")) for e in v.elts if isinstance(e, ast.Constant)))


def _npm(path, content):
    d = json.loads(content)
    for key, dev in (("dependencies", False), ("devDependencies", True)):
        for name, v in d.get(key, {}).items():
            yield _row("npm", name, v if re.fullmatch(r"\d[\w.+-]*", str(v)) else None, str(v), dev=dev)


def _npm_lock(path, content):
    d = json.loads(content)
    for key, v in (d.get("packages") or {}).items():
        if key:
            yield _row("npm", key.rpartition("node_modules/")[2], v.get("version"), direct=key.count("node_modules/") == 1, dev=bool(v.get("dev")), hashes=int("integrity" in v))
    if not d.get("packages"):
        for name, v in (d.get("dependencies") or {}).items():
            yield _row("npm", name, v.get("version"), direct=False, dev=bool(v.get("dev")), hashes=int("integrity" in v))


def _go_sum(path, content):
    seen = set()
    for m in re.finditer(r"(?m)^(\S+)\s+v([\w.+-]+?)(?:/go\.mod)?\s+h1:", content):
        if m[0] and (m[1], m[2]) not in seen:
            seen.add((m[1], m[2]))
            yield _row("go", m[1], m[2], direct=False, hashes=1)


def _gemfile_lock(path, content):
    specs, _, rest = content.partition("DEPENDENCIES")
    direct = set(re.findall(r"(?m)^  ([\w.-]+)", rest.partition("\n\n")[0]))
    for m in re.finditer(r"(?m)^    ([\w.-]+) \(([\w.-]+)\)$", specs):
        yield _row("rubygems", m[1], m[2], direct=m[1] in direct)


def _composer_lock(path, content):
    d = json.loads(content)
    for key, dev in (("packages", False), ("packages-dev", True)):
        for p in d.get(key) or ():
            yield _row("packagist", p["name"], str(p.get("version", "")).lstrip("v") or None, direct=False, dev=dev, ref=(p.get("source") or {}).get("reference"), hashes=int(bool((p.get("dist") or {}).get("shasum"))))


def _go_mod(path, content):
    for m in re.finditer(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+v([\w.+-]+)(\s*// indirect)?", content):
        yield _row("go", m[1], m[2], direct=not m[3])


def _cargo(path, content):
    d = tomllib.loads(content)
    for key, dev in (("dependencies", False), ("dev-dependencies", True)):
        for name, v in d.get(key, {}).items():
            yield _row("cargo", name, None, str(v.get("version", "") if isinstance(v, dict) else v), dev=dev)


def _gemfile(path, content):
    for m in re.finditer(r"""(?m)^\s*gem\s+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?""", content):
        yield _row("rubygems", m[1], None, m[2] or "")


def _composer(path, content):
    d = json.loads(content)
    for key, dev in (("require", False), ("require-dev", True)):
        for name, v in d.get(key, {}).items():
            if "/" in name:
                yield _row("packagist", name, None, str(v), dev=dev)


def _pom(path, content):
    for b in re.finditer(r"(?s)<dependency>(.*?)</dependency>", content):
        tag = lambda t, b=b: (re.search(rf"<{t}>\s*([^<\s]+)\s*</{t}>", b[1]) or [None, None])[1]
        yield _row("maven", f"{tag('groupId')}:{tag('artifactId')}", tag("version"), dev=tag("scope") == "test")


def _gradle(path, content):
    for m in re.finditer(r"""(?m)^\s*(\w*[iI]mplementation|api|compileOnly|runtimeOnly)\s*\(?['"]([\w.-]+):([\w.-]+):([\w.+-]+)['"]""", content):
        yield _row("maven", f"{m[2]}:{m[3]}", m[4], dev=m[1].lower().startswith("test"))


PARSERS = (
    (r"(^|/)[^/]*requirements[^/]*\.txt$|\.req$", _requirements), (r"(^|/)pyproject\.toml$", _pyproject), (r"(^|/)(poetry|uv|Cargo)\.lock$", _toml_lock), (r"(^|/)Pipfile$", _pipfile), (r"(^|/)Pipfile\.lock$", _pipfile_lock),
    (r"(^|/)setup\.cfg$", _setup_cfg), (r"(^|/)setup\.py$", _setup_py), (r"(^|/)package\.json$", _npm), (r"(^|/)(package-lock|npm-shrinkwrap)\.json$", _npm_lock), (r"(^|/)go\.mod$", _go_mod),
    (r"(^|/)Cargo\.toml$", _cargo), (r"(^|/)Gemfile$", _gemfile), (r"(^|/)go\.sum$", _go_sum), (r"(^|/)Gemfile\.lock$", _gemfile_lock), (r"(^|/)composer\.lock$", _composer_lock), (r"(^|/)composer\.json$", _composer), (r"(^|/)pom\.xml$", _pom), (r"(^|/)build\.gradle(\.kts)?$", _gradle),
)


def rows_of(path: str, content: str | None) -> list[tuple]:
    for pattern, parse in PARSERS:
        if re.search(pattern, path):
            try:
                return [(path, *r) for r in parse(path, content or "")]
            except (ValueError, SyntaxError, KeyError, AttributeError, TypeError, configparser.Error):
                return []
    return []


_S = pa.string()
_ARROW = pa.schema([("path", _S), ("ecosystem", _S), ("name", _S), ("version", _S), ("spec", _S), ("is_direct", pa.bool_()), ("is_dev", pa.bool_()), ("source_type", _S), ("vcs_ref", _S), ("hashes", pa.int32())])


def manifest_dependencies(files: DataFrame) -> DataFrame:
    from .python_facts import _rows

    return _rows(files, rows_of, SCHEMA, _ARROW)


def lock_edges(files: DataFrame) -> DataFrame:
    """path, src, dst: which package needs which, of poetry.lock, uv.lock, Cargo.lock and package-lock.json files."""
    from .python_facts import _rows

    return _rows(files, edges_of, "path string, src string, dst string", pa.schema([("path", _S), ("src", _S), ("dst", _S)]))


def edges_of(path: str, content: str | None) -> list[tuple]:
    try:
        if re.search(r"(^|/)(poetry|uv|Cargo)\.lock$", path):
            names = lambda d: d.keys() if isinstance(d, dict) else (x["name"] if isinstance(x, dict) else str(x).split()[0] for x in d)
            return [(path, p["name"], n) for p in tomllib.loads(content or "").get("package", ()) for n in names(p.get("dependencies", ()))]
        if re.search(r"(^|/)(package-lock|npm-shrinkwrap)\.json$", path):
            packages = json.loads(content or "").get("packages") or {}
            return [(path, k.rpartition("node_modules/")[2] or ".", n) for k, v in packages.items() for n in v.get("dependencies") or ()]
    except (ValueError, KeyError, AttributeError, TypeError):
        pass
    return []
