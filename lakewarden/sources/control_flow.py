"""Control flow of Python functions as rows: blocks, edges, and the lines of their statements.

Every outcome of a branch is a block of its own that carries the condition, so what dominates a block says under which
conditions it runs. Outcomes that constants rule out have no edge. Functions and the module's body are told apart by number.

Rows (path, fn, unit, kind, block, to, line, last, text):

    block  a block; text is the condition that it is the outcome of, block 0 the entry
    edge   block -> to
    lines  a statement of the block, from line to last
"""

from __future__ import annotations

import ast
import operator

import pyarrow as pa
from pyspark.sql import DataFrame

from .python_facts import LIMIT, _rows, dotted

ROWS = "path string, fn string, unit int, kind string, block int, to int, line int, last int, text string"
_S, _I = pa.string(), pa.int32()
_ROWS = pa.schema([("path", _S), ("fn", _S), ("unit", _I), ("kind", _S), ("block", _I), ("to", _I), ("line", _I), ("last", _I), ("text", _S)])
#: Names taken as false, and calls that don't come back.
FALSE_NAMES, EXITS = ("DEBUG", "TYPE_CHECKING"), ("sys.exit", "os._exit", "exit", "quit")
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def folded(e: ast.expr) -> bool | None:
    """What a condition of constants is; None where it depends on more."""
    if isinstance(e, ast.Constant):
        return bool(e.value)
    if isinstance(e, ast.Name):
        return False if e.id in FALSE_NAMES else None
    if isinstance(e, (ast.List, ast.Tuple, ast.Set)) and not any(isinstance(x, ast.Starred) for x in e.elts):
        return bool(e.elts)
    if isinstance(e, ast.Dict) and not e.keys:
        return False
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
        inner = folded(e.operand)
        return None if inner is None else not inner
    if isinstance(e, ast.BoolOp):
        parts, end = [folded(x) for x in e.values], isinstance(e.op, ast.Or)
        return end if end in parts else None if None in parts else not end
    if isinstance(e, ast.Compare) and len(e.ops) == 1 and type(e.ops[0]) in _COMPARE and isinstance(e.left, ast.Constant) and isinstance(e.comparators[0], ast.Constant):
        try:
            return bool(_COMPARE[type(e.ops[0])](e.left.value, e.comparators[0].value))
        except TypeError:
            return None
    return None


class Graph:
    """Blocks and edges of one function."""

    def __init__(self, body, path: str, fn: str, unit: int):
        self.path, self.fn, self.unit, self.rows, self.n, self.inner = path, fn, unit, [], 0, []
        self.loops: list[tuple[int, int]] = []
        self.walk(body, self.block())

    def add(self, kind, block, to=None, line=None, last=None, text=None) -> None:
        self.rows.append((self.path, self.fn, self.unit, kind, block, to, line, last, text))

    def block(self, text: str | None = None, *before: int | None) -> int:
        at, self.n = self.n, self.n + 1
        self.add("block", at, text=text)
        for b in before:
            self.link(b, at)
        return at

    def link(self, a: int | None, b: int) -> None:
        if a is not None:
            self.add("edge", a, b)

    def walk(self, body, at: int | None) -> int | None:
        for s in body:
            if at is None:
                at = self.block()  # nothing leads here
            at = self.statement(s, at)
        return at

    def branch(self, test: ast.expr, at: int) -> tuple[int, int]:
        """Blocks of both outcomes."""
        known, text = folded(test), ast.unparse(test)
        yes = self.block(text if known is None else None, *([at] if known is not False else []))
        no = self.block(f"not ({text})" if known is None else None, *([at] if known is not True else []))
        return yes, no

    def join(self, *ends: int | None) -> int | None:
        live = [e for e in ends if e is not None]
        return self.block(None, *live) if live else None

    def statement(self, s, at: int) -> int | None:
        head = [s] if not getattr(s, "body", None) else [x for x in (getattr(s, "test", None), getattr(s, "iter", None), *(i.context_expr for i in getattr(s, "items", ())), getattr(s, "subject", None)) if x is not None]
        for x in head:
            self.add("lines", at, line=x.lineno, last=x.end_lineno)
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.inner.append((s.body, s.name))
        elif isinstance(s, ast.ClassDef):
            mine, self.inner = self.inner, []
            at = self.walk(s.body, at)
            self.inner = mine + [(b, f"{s.name}.{n}") for b, n in self.inner]
        elif isinstance(s, ast.If):
            yes, no = self.branch(s.test, at)
            return self.join(self.walk(s.body, yes), self.walk(s.orelse, no))
        elif isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            top = self.block(None, at)
            if isinstance(s, ast.While):
                known, text = folded(s.test), ast.unparse(s.test)
                yes, no = self.block(text if known is None else None, *([top] if known is not False else [])), self.block(None, *([top] if known is not True else []))
            else:
                yes, no = self.block(None, top), self.block(None, top)
            after = self.block()
            self.loops.append((after, top))
            self.link(self.walk(s.body, yes), top)
            self.loops.pop()
            self.link(self.walk(s.orelse, no), after)
            return after
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            return self.walk(s.body, at)
        elif isinstance(s, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            first = self.n
            end = self.walk(s.body, self.block(None, at))
            inside = [at, *range(first, self.n)]
            ends = [self.walk(s.orelse, end) if end is not None else None]
            ends += [self.walk(h.body, self.block(None, *inside)) for h in s.handlers]
            if not s.finalbody:
                return self.join(*ends)
            after = self.join(*ends)
            if after is None:
                self.walk(s.finalbody, self.block(None, *inside, *range(first, self.n)))
                return None
            return self.walk(s.finalbody, after)
        elif isinstance(s, ast.Match):
            ends, open_ = [], True
            for c in s.cases:
                bare = isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None
                text = None if bare else f"case {ast.unparse(c.pattern)}" + (f" if {ast.unparse(c.guard)}" if c.guard is not None else "")
                ends.append(self.walk(c.body, self.block(text, at)))
                open_ = open_ and not bare
            return self.join(*ends, at if open_ else None)
        elif isinstance(s, (ast.Return, ast.Raise)):
            return None
        elif isinstance(s, (ast.Break, ast.Continue)):
            if self.loops:
                self.link(at, self.loops[-1][isinstance(s, ast.Continue)])
            return None
        elif isinstance(s, ast.Assert):
            return self.branch(s.test, at)[0]
        elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and dotted(s.value.func) in EXITS:
            return None
        return at


def control_flow_of(path: str, content: str | None) -> list[tuple]:
    if content is None or len(content) > LIMIT:
        return []
    try:
        todo, rows, unit = [(ast.parse(content).body, "<module>")], [], 0
        while todo:
            body, fn = todo.pop()
            g = Graph(body, path, fn, unit)
            rows += g.rows
            unit += 1
            todo += [(b, name if fn == "<module>" else f"{fn}.{name}") for b, name in g.inner]
        return rows
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []  # the facts have an error row for it


def control_flow(files: DataFrame) -> DataFrame:
    """Blocks, edges and lines of ``files(path, content)``."""
    return _rows(files, control_flow_of, ROWS, _ROWS)
