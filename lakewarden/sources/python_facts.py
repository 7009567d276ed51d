"""Python source files to fact rows: parse once, then everything else is relational.

One row per fact: kind (import, function, class, call, assign, constant, decorator, lock, global, await, dispatch,
error), its place, the enclosing function, a name as written and with import aliases resolved, details, and the
conditions of the enclosing ``if`` branches. Nothing is
executed; a file that can't be parsed gives an ``error`` row, as does one over ``LIMIT`` characters. Texts of
calls, functions and constants are whole. A caller that needs some kinds or texts only names them, and the others
aren't made; ``ord`` stays what it is among all facts. Only who names it gets the kind ``module``, a row for each file
that has facts of any kind; texts of ``decorated`` are those of functions with decorators, of ``call:x.y`` those of calls
that resolve to ``x.y``.
"""

from __future__ import annotations

import ast
import functools
import gc
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

FACTS = "path string, kind string, ord int, line int, col int, fn string, name string, resolved string, n_args int, kwargs map<string,string>, items array<string>, text string, guards array<string>"
LIMIT = 2_000_000
#: A batch of rows is sent when its texts have so many characters.
BATCH = 2_000_000


#: Names of tables of functions.
DISPATCH = ("handlers", "dispatch", "routes", "callbacks", "commands", "actions")


def dotted(node: ast.AST) -> str:
    """The written chain of names; ``<dynamic>`` where its base isn't a name."""
    parts = []
    while isinstance(node, (ast.Attribute, ast.Subscript)):
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "<dynamic>")
    return ".".join(reversed(parts))


def shown(node: ast.AST) -> str:
    if isinstance(node, ast.Constant):
        return repr(node.value)
    return node.id if isinstance(node, ast.Name) else "<expression>"


#: Fields of nodes that hold nothing to be visited.
_BARE = ("ctx", "op", "ops", "id", "attr")
#: Functions that a worker remembers the text of, and the longest such one in characters.
KNOWN, LONGEST = 20_000, 4_000


class Facts:
    def __init__(self, path: str, content: str, kinds: frozenset | None = None, texts: frozenset | None = None):
        self.content, self.lines, self.tests = content, None, {}
        self.kinds, self.texts, self.n = kinds, texts, 0
        self.path, self.rows, self.stack, self.alias, self.locks, self.guards, self.scope = path, [], [], {}, [], [], "module"

    def visit(self, node: ast.AST) -> None:
        kind = node.__class__
        if kind in HANDLERS:
            HANDLERS[kind](self, node)
        else:
            self.generic_visit(node)

    def generic_visit(self, node: ast.AST) -> None:
        for name in WALKED.get(node.__class__, ()):
            x = getattr(node, name, None)
            kind = x.__class__
            if kind is list:
                for y in x:
                    if y.__class__ in WALKED:
                        self.visit(y)
            elif kind in WALKED:
                self.visit(x)

    def resolved(self, name: str) -> str:
        head, dot, rest = name.partition(".")
        return self.alias.get(head, head) + dot + rest

    def wants(self, kind: str) -> bool:
        """Whether facts of a kind are asked for; one that isn't takes its place in the order all the same."""
        if self.kinds is None or kind in self.kinds:
            return True
        self.n += 1
        return False

    def text(self, kind: str, node: ast.AST) -> str | None:
        if self.texts is None or kind in self.texts:
            return node.value if kind == "constant" else self.function_text(node) if kind == "function" else ast.unparse(node)
        return None

    def function_text(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        """A function's text; its source lines decide it, so the same lines are written anew once."""
        if self.lines is None:
            self.lines = re.split("\r\n|\r|\n", self.content)  # lines as the parser counts them
        source = "\n".join(self.lines[min(node.lineno, *(d.lineno for d in node.decorator_list), node.lineno) - 1 : node.end_lineno])
        if len(source) > LONGEST:
            return ast.unparse(node)
        if (out := _TEXTS.get(source)) is None:
            if len(_TEXTS) >= KNOWN:
                _TEXTS.clear()
            out = _TEXTS[source] = ast.unparse(node)
        return out

    def conditions(self) -> list[str]:
        """The tests around; one is written out when the first fact under it is."""
        out = []
        for test, form in self.guards:
            if (text := self.tests.get(id(test))) is None:
                text = self.tests[id(test)] = ast.unparse(test)
            out.append(form.format(text))
        return out

    def add(self, kind: str, node: ast.AST, name: str, n_args: int = 0, kwargs=None, items=(), text=None) -> None:
        if not self.wants(kind):
            return
        self.n += 1
        self.rows.append((self.path, kind, self.n - 1, getattr(node, "lineno", 0), getattr(node, "col_offset", 0), ".".join(self.stack), name, self.resolved(name), n_args, kwargs or {}, list(items), text, self.conditions() if self.guards else []))

    def visit_Import(self, node):
        for a in node.names:
            if a.asname:
                self.alias[a.asname] = a.name
            self.add("import", node, a.name, items=[a.asname or a.name])

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.alias[a.asname or a.name] = f"{module}.{a.name}"
            self.add("import", node, f"{module}.{a.name}", items=[a.asname or a.name])

    def _function(self, node):
        if self.wants("function"):
            args = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
            text = self.function_text(node) if self.texts and "decorated" in self.texts and node.decorator_list else self.text("function", node)
            self.add("function", node, node.name, len(args), items=args, text=text, kwargs={"async": str(isinstance(node, ast.AsyncFunctionDef))})
        self._decorators(node)
        self.stack.append(node.name)
        outer, self.locks, self.guards, self.scope = (self.locks, self.guards, self.scope), [], [], "function"
        for x in node.body:
            self.visit(x)
        self.locks, self.guards, self.scope = outer
        self.stack.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node):
        self.add("class", node, node.name, items=[dotted(b) for b in node.bases], kwargs={k.arg: shown(k.value) for k in node.keywords if k.arg})
        self._decorators(node)
        self.stack.append(node.name)
        outer, self.scope = self.scope, "class"
        for x in node.body:
            self.visit(x)
        self.scope = outer
        self.stack.pop()

    def visit_If(self, node):
        self.visit(node.test)
        for body, form in ((node.body, "{}"), (node.orelse, "not ({})")):
            self.guards.append((node.test, form))
            for x in body:
                self.visit(x)
            self.guards.pop()

    def visit_Global(self, node):
        for name in node.names:
            self.add("global", node, name)

    visit_Nonlocal = visit_Global

    def visit_Await(self, node):
        self.add("await", node, dotted(node.value.func if isinstance(node.value, ast.Call) else node.value))
        self.generic_visit(node)

    def visit_Subscript(self, node):
        if isinstance(node.ctx, ast.Load) and any(w in (name := dotted(node.value)) for w in DISPATCH):
            self.add("dispatch", node, name, text="table")
        self.generic_visit(node)

    def _decorators(self, node):
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            self.add("decorator", d, dotted(call.func if call else d), len(call.args) if call else 0, items=[node.name, *(shown(a) for a in (call.args if call else ()))])
            self.generic_visit(d)

    def visit_Call(self, node):
        if self.wants("call"):
            name = dotted(node.func)
            text = ast.unparse(node) if self.texts and f"call:{self.resolved(name)}" in self.texts else self.text("call", node)
            self.add("call", node, name, len(node.args), {k.arg: shown(k.value) for k in node.keywords if k.arg}, [shown(a) for a in node.args], text)
        if isinstance(node.func, ast.Call) and (name := dotted(node.func.func)) in ("getattr", "globals", "locals"):
            self.add("dispatch", node, name, text="call")
        self.generic_visit(node)

    def visit_Assign(self, node):
        for t in node.targets:
            if isinstance(t, (ast.Name, ast.Attribute, ast.Subscript)):
                self.add("assign", node, dotted(t), items=[type(node.value).__name__, shown(node.value)], kwargs={"scope": self.scope})
        self.generic_visit(node)

    def visit_Constant(self, node):
        if isinstance(node.value, str) and self.wants("constant"):
            self.add("constant", node, "str", text=self.text("constant", node))

    def _with(self, node):
        names = [dotted(i.context_expr.func if isinstance(i.context_expr, ast.Call) else i.context_expr) for i in node.items]
        for n in names:
            for held in self.locks:
                self.add("lock", node, n, items=[held, n])
            self.locks.append(n)
        for i in node.items:
            self.visit(i)
        for x in node.body:
            self.visit(x)
        del self.locks[len(self.locks) - len(names) :]

    visit_With = visit_AsyncWith = _with


HANDLERS = {getattr(ast, name.removeprefix("visit_")): f for name, f in vars(Facts).items() if name.startswith("visit_")}
#: Nodes that are visited, with the fields that may hold such: leaves (names, contexts, operators) are passed over.
WALKED = {k: tuple(f for f in k._fields if f not in _BARE) for k in vars(ast).values() if isinstance(k, type) and issubclass(k, ast.AST)}
WALKED = {k: fields for k, fields in WALKED.items() if fields or k in HANDLERS}
_TEXTS: dict[str, str] = {}


def facts_of(path: str, content: str | None, kinds: frozenset | None = None, texts: frozenset | None = None) -> list[tuple]:
    def error(kind, e):
        return [] if kinds is not None and "error" not in kinds else [(path, "error", 0, getattr(e, "lineno", None) or 0, 0, "", kind, kind, 0, {}, [], str(e)[:500], [])]

    if content is None or len(content) > LIMIT:
        return error("LOAD_ERROR", "no content" if content is None else "too long")
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as e:
        return error("SYNTAX_ERROR", e)
    except (RecursionError, MemoryError) as e:
        return error("PARSER_ERROR", e)
    try:
        f = Facts(path, content, kinds, texts)
        f.visit(tree)
    except RecursionError as e:
        return error("PARSER_ERROR", e)
    if kinds and "module" in kinds and f.n:
        f.rows.append((path, "module", f.n, 0, 0, "", "", "", 0, {}, [], None, []))
    return f.rows


def _rows(files: DataFrame, fn, schema: str, arrow: pa.Schema) -> DataFrame:
    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if pa.types.is_map(f.type) else c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def own(batches):
        # trees hold no cycles, and the collector would walk each of them several times: it runs once a batch
        gc.disable()
        try:
            for b in batches:
                rows, size = [], 0
                for p, c in zip(b["path"], b["content"], strict=True):
                    for r in fn(p.as_py() or "", c.as_py()):
                        rows.append(r)
                        size += 200 + sum([len(x) for x in r if x.__class__ is str])
                        if size > BATCH:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)
                gc.collect()
        finally:
            gc.enable()

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(own, schema)


_S, _I = pa.string(), pa.int32()
_FACTS = pa.schema([("path", _S), ("kind", _S), ("ord", _I), ("line", _I), ("col", _I), ("fn", _S), ("name", _S), ("resolved", _S), ("n_args", _I), ("kwargs", pa.map_(_S, _S)), ("items", pa.list_(_S)), ("text", _S), ("guards", pa.list_(_S))])


def python_facts(files: DataFrame, kinds: Iterable[str] | None = None, texts: Iterable[str] | None = None) -> DataFrame:
    """Facts of ``files(path, content)``: of some kinds only, with the texts of some of those (None: of all)."""
    some = lambda names: None if names is None else frozenset(names)
    return _rows(files, functools.partial(facts_of, kinds=some(kinds), texts=some(texts)), FACTS, _FACTS)
