"""Which strings a variable may hold: sets of constants through concatenations and formatted strings."""

from __future__ import annotations

import ast
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame

from .python_facts import LIMIT, _rows, dotted

#: A set of more values, or one reached through more names, is unknown.
MOST, DEPTH = 10, 5


def values(e: ast.expr, env: dict[str, list[ast.expr]], depth: int = 0) -> frozenset[str] | None:
    """All values of an expression, or None where they can't be told."""
    if depth > DEPTH:
        return None
    if isinstance(e, ast.Constant):
        return frozenset([str(e.value)])
    if isinstance(e, ast.Name):
        parts = [values(x, env, depth + 1) for x in env.get(e.id, ())]
        out = None if not parts or None in parts else frozenset().union(*parts)
    elif isinstance(e, ast.IfExp):
        a, b = values(e.body, env, depth + 1), values(e.orelse, env, depth + 1)
        out = None if a is None or b is None else a | b
    elif isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
        out = _product([values(e.left, env, depth + 1), values(e.right, env, depth + 1)])
    elif isinstance(e, ast.JoinedStr):
        out = _product([values(v.value if isinstance(v, ast.FormattedValue) else v, env, depth + 1) for v in e.values])
    else:
        out = None
    return None if out is None or len(out) > MOST else out


def _product(parts: list) -> frozenset[str] | None:
    if None in parts:
        return None
    size = 1
    for p in parts:
        size *= len(p)
    return frozenset(map("".join, itertools.product(*parts))) if size <= MOST else None


def sets_of(path: str, content: str | None) -> list[tuple]:
    """(path, line, call, values, state) of the first argument of dynamic imports and of getattr's name."""
    if content is None or len(content) > LIMIT:
        return []
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    env: dict[str, list[ast.expr]] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Assign):
            for t in n.targets:
                if isinstance(t, ast.Name):
                    env.setdefault(t.id, []).append(n.value)
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            name = dotted(n.func)
            at = {"__import__": 0, "import_module": 0, "getattr": 1}.get(name.rpartition(".")[2])
            if at is not None and len(n.args) > at:
                got = values(n.args[at], env)
                out.append((path, n.lineno, name, sorted(got or ()), "UNKNOWN" if got is None else "EXACT" if len(got) == 1 else "PARTIAL"))
    return out


def constant_sets(files: DataFrame) -> DataFrame:
    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("call", pa.string()), ("values", pa.list_(pa.string())), ("state", pa.string())])
    return _rows(files, sets_of, "path string, line int, call string, values array<string>, state string", schema)
