"""Definitions and uses in Python files as rows: what flows where inside each function, and what crosses calls.

One syntactic pass over a file gives nodes (parameters, reads of dotted names, results of calls, checked values, fields,
globals) and edges between them. A variable is the set of nodes that its current version may hold, so copies and
concatenations give no nodes of their own; branches merge by union, loop bodies repeat until no version changes. Nothing is
decided here: neither what is a source, a sink or safe, nor which function a call means beyond its written name. Those
are joins over all files (``operators.dataflow``).

Rows (path, kind, fn, id, src, name, line, pos, text), where ``fn`` is the qualified name of the function around it:

    module  the file's dotted name
    def     a function: name its module's dotted name and its own
    param   node id is the parameter name at position pos (-1 *args, -2 **kwargs, -3 keyword only)
    read    node id is the dotted name as read, aliases resolved
    result  node id is what the call of name gives; text its shape: "const" (a constant first of several arguments), "list" (a sequence that no shell sees)
    check   node id is what call name has looked at in a condition
    field   node id is an attribute of a class's objects, or a global
    flow    src -> id
    arg     src -> argument of call id, at pos or by the keyword name (-1 starred, -2 double starred)
    recv    src -> receiver of call id
    ret     src -> what fn returns
    target  call id may mean function name: of this file (text = "here") or by its dotted name; pos is how many parameters come before the arguments
    bind    dotted name name of this module is another dotted name, text; a star import has name "module.*"
"""

from __future__ import annotations

import ast
import collections
import gc
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .python_facts import BATCH, LIMIT, _rows, dotted

FACTS = "path string, kind string, fn string, id int, src int, name string, line int, pos int, text string"
_S, _I = pa.string(), pa.int32()
_FACTS = pa.schema([("path", _S), ("kind", _S), ("fn", _S), ("id", _I), ("src", _I), ("name", _S), ("line", _I), ("pos", _I), ("text", _S)])
#: A file as one row: see ``file_facts``.
FILES = "path string, root string, a long, b long, owns array<string>, asks array<string>, facts array<struct<kind: string, fn: string, id: int, src: int, name: string, line: int, pos: int, text: string>>"
_FILES = pa.schema([("path", _S), ("root", _S), ("a", pa.int64()), ("b", pa.int64()), ("owns", pa.list_(_S)), ("asks", pa.list_(_S)), ("facts", pa.list_(pa.struct(list(_FACTS)[1:])))])
#: Stands for the root at the beginning of a dotted name; no source text can hold it.
OWN = "\0"
#: Kinds whose name is dotted and can begin with the root; of "target" those without a text.
_DOTTED = frozenset(("module", "def", "bind", "read", "result", "check"))
#: Contents of up to so many characters, and so many of them, that a worker keeps the facts of.
_SHORT, _KEPT, _TOLD = 8_192, 512, 100_000
_kept: dict[tuple[str, str], tuple] = {}
MODULE = "<module>"
Origins = frozenset
NONE: Origins = frozenset()
Env = dict[str, Origins] | None  # None: not reached


def module_of(path: str) -> tuple[str, bool]:
    """Dotted module name of a file, and whether it is a package."""
    name = path.removesuffix(".py").strip("/")
    package = name == "__init__" or name.endswith("/__init__")
    return name.removesuffix("__init__").rstrip("/").replace("/", "."), package


def merge(*envs: Env) -> Env:
    live = [e for e in envs if e is not None]
    if len(live) < 2:
        return dict(live[0]) if live else None
    out = dict(live[0])
    for e in live[1:]:
        for k, v in e.items():
            old = out.get(k)
            out[k] = v if old is None or old is v else old | v
    return out


def changed(a: Env, b: Env) -> bool:
    return a != b


#: Fields of statements, handlers and cases that hold those inside them, in the order of ``ast``.
_BODIES = ("body", "handlers", "cases", "orelse", "finalbody")


def _inside(n) -> list:
    return [x for f in _BODIES for x in getattr(n, f, ())]


class Scope:
    """A function, class or module that is walked: its names and what it may call."""

    def __init__(self, fn: str, outer: Scope | None = None, cls: str | None = None):
        self.fn, self.outer, self.cls = fn, outer, cls
        self.functions: dict[str, set[str]] = {}
        self.classes: dict[str, str] = {}
        self.kinds: dict[str, str] = {}  # variable -> class that made it
        self.all: dict[str, Origins] = {}  # every version of each name, for the functions inside
        self.globals: set[str] = set()
        self.me: str | None = None  # the receiver's parameter in a method

    def chain(self):
        s = self
        while s:
            yield s
            s = s.outer


class DefUse:
    def __init__(self, path: str, tree: ast.Module):
        self.path, self.module, self.package = path, *module_of(path)
        self.rows: dict[tuple, None] = {}
        self.nodes: dict[object, int] = {}
        self.alias: dict[str, str] = {}
        self.bases: dict[str, list[str]] = {}
        self.methods: dict[str, int] = {}  # qualified name -> parameters before the arguments, called on an object
        self.of_class: set[str] = set()
        self.quals: dict[int, str] = {}
        self.shared: set[str] = set()
        self.breaks: list[tuple[list, list]] = []
        self.todo: list[tuple] = []
        self.queued: set[int] = set()
        self.keep: list[ast.AST] = []  # nodes are known by identity, so they must live
        self._names(tree)
        top = Scope(MODULE)
        self._functions(tree.body, top)
        self.block(tree.body, {}, top)
        while self.todo:
            self.function(*self.todo.pop())

    # --- names ------------------------------------------------------------------------------------

    def add(self, kind, scope, id=None, src=None, name=None, line=None, pos=None, text=None) -> None:
        self.rows[(self.path, kind, scope.fn if scope else MODULE, id, src, name, line, pos, text)] = None

    def node(self, key, kind, scope, name, line, pos=None, text=None) -> int:
        if key not in self.nodes:
            self.nodes[key] = len(self.nodes)
            self.add(kind, scope, self.nodes[key], None, name, line, pos, text)
        return self.nodes[key]

    def absolute(self, module: str, level: int) -> str:
        if not level:
            return module
        parts = self.module.split(".") if self.module else []
        up = level - (1 if self.package else 0)
        parts = parts[: len(parts) - up] if up else parts
        return ".".join([*parts, *([module] if module else [])])

    def _names(self, tree) -> None:
        self.add("module", None, name=self.module, line=0)
        own = f"{self.module}." if self.module else ""
        top = set(map(id, tree.body))
        todo = collections.deque([tree])
        while todo:  # as ast.walk does, without expressions
            n = todo.popleft()
            todo += _inside(n)
            if isinstance(n, ast.Import):
                for a in n.names:
                    if a.asname:
                        self.alias[a.asname] = a.name
                    else:
                        self.alias.setdefault(a.name.partition(".")[0], a.name.partition(".")[0])
            elif isinstance(n, ast.ImportFrom):
                module = self.absolute(n.module or "", n.level)
                for a in n.names:
                    target = f"{module}.{a.name}" if module else a.name
                    if a.name != "*":
                        self.alias[a.asname or a.name] = target
                    if id(n) in top:
                        self.add("bind", None, name=f"{own}{'*' if a.name == '*' else a.asname or a.name}", text=module if a.name == "*" else target, line=n.lineno)
            elif isinstance(n, ast.Global):
                self.shared.update(n.names)

    def _functions(self, body, scope: Scope) -> None:
        """Functions and classes that a body defines, in any branch; those of equal names are told apart."""
        for n in self._statements(body):
            named = n.targets[0].id if isinstance(n, ast.Assign) and isinstance(n.value, ast.Lambda) and isinstance(n.targets[0], ast.Name) else getattr(n, "name", None)
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) or isinstance(n, ast.Assign) and named:
                n = n.value if isinstance(n, ast.Assign) else n
                qual = named if scope.fn == MODULE else f"{scope.fn}.{named}"
                taken = set(self.quals.values())
                k = 2
                while (name := qual if k == 2 and qual not in taken else f"{qual}#{k}") in taken:
                    k += 1
                self.quals[id(n)] = name
                self.keep.append(n)
                if isinstance(n, ast.ClassDef):
                    scope.classes[named] = name
                    self.bases[name] = [dotted(b) for b in n.bases]
                else:
                    scope.functions.setdefault(named, set()).add(name)
                    marks = {dotted(d) for d in getattr(n, "decorator_list", ())}
                    if scope.cls:
                        self.methods[name] = 0 if "staticmethod" in marks else 1
                        if "classmethod" in marks:
                            self.of_class.add(name)
                    self.add("def", None, name=f"{self.module}.{name}" if self.module else name, line=n.lineno, text=name)

    @staticmethod
    def _statements(body):
        todo = list(body)
        while todo:
            n = todo.pop(0)
            yield n
            if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                todo += _inside(n)

    def resolved(self, name: str) -> str:
        head, dot, rest = name.partition(".")
        return self.alias.get(head, head) + dot + rest

    # --- what a call may mean ---------------------------------------------------------------------

    def class_of(self, scope: Scope, name: str) -> str | None:
        for s in scope.chain():
            if name in s.classes:
                return s.classes[name]
        return None

    def method(self, scope: Scope, cls: str, name: str, bound: bool, seen=()) -> list[tuple[str, int, str | None]]:
        """Methods of a class of this file, or of its bases: (function, parameters before the arguments, "here")."""
        own = [q for q in self.methods if q == f"{cls}.{name}" or q.startswith(f"{cls}.{name}#")]
        if own:
            return [(q, self.methods[q] if bound or q in self.of_class else 0, "here") for q in own]
        out = []
        for b in self.bases.get(cls, ()):
            if b in seen:
                continue
            if here := self.class_of(scope, b):
                out += self.method(scope, here, name, bound, (*seen, b))
            elif b.partition(".")[0] in self.alias:
                out.append((f"{self.resolved(b)}.{name}", int(bound), None))
        return out

    def targets(self, f: ast.expr, scope: Scope) -> list[tuple[str, int, str | None]]:
        if isinstance(f, ast.Name):
            for s in scope.chain():
                if s.cls and s is not scope:
                    continue  # a class's names aren't seen by its methods
                if f.id in s.functions:
                    return [(q, 0, "here") for q in sorted(s.functions[f.id])]
                if f.id in s.classes:
                    return self.method(scope, s.classes[f.id], "__init__", True)
            if f.id in self.alias:
                return [(self.alias[f.id], 0, None), (f"{self.alias[f.id]}.__init__", 1, None)]
        elif isinstance(f, ast.Attribute):
            base = f.value
            if isinstance(base, ast.Call) and isinstance(base.func, ast.Name) and base.func.id == "super":
                cls = next((s.cls for s in scope.chain() if s.cls), None)
                return [t for b in self.bases.get(cls, ()) for t in ([(f"{self.resolved(b)}.{f.attr}", 1, None)] if not self.class_of(scope, b) else self.method(scope, self.class_of(scope, b), f.attr, True))]
            made = base.func if isinstance(base, ast.Call) else None
            if isinstance(made, ast.Name) and (cls := self.class_of(scope, made.id)):
                return self.method(scope, cls, f.attr, True)
            if isinstance(base, ast.Name):
                for s in scope.chain():
                    if s.me == base.id:
                        return self.method(scope, s.cls, f.attr, True)
                    if base.id in s.kinds:
                        kind = s.kinds[base.id]
                        return self.method(scope, kind, f.attr, True) if kind in self.bases else [(f"{kind}.{f.attr}", 1, None)]
                if cls := self.class_of(scope, base.id):
                    return self.method(scope, cls, f.attr, False)
            name = dotted(f)
            if name.partition(".")[0] in self.alias:
                return [(self.resolved(name), 0, None), (f"{self.resolved(name)}.__init__", 1, None)]
        return []

    # --- functions and statements -----------------------------------------------------------------

    def function(self, n, scope: Scope, outer: Scope, defaults: dict[str, Origins]) -> None:
        env: Env = {}
        a = n.args
        plain = [*a.posonlyargs, *a.args]
        for i, p in [*enumerate(plain), (-1, a.vararg), (-2, a.kwarg), *((-3, k) for k in a.kwonlyargs)]:
            if p is not None:
                at = self.node(("param", scope.fn, p.arg), "param", scope, p.arg, n.lineno, i)
                env[p.arg] = scope.all[p.arg] = Origins([at])
                for src in defaults.get(p.arg, NONE):
                    self.add("flow", scope, at, src)
        if outer.cls and plain and self.methods.get(scope.fn):
            scope.me, scope.cls_of_me = plain[0].arg, outer.cls
            scope.cls, inner = outer.cls, scope
        else:
            inner = scope
        if isinstance(n, ast.Lambda):
            for src in self.value(n.body, env, scope):
                self.add("ret", scope, None, src)
            return
        self._functions(n.body, inner if not scope.me else self._inner(scope))
        self.block(n.body, env, scope)

    def later(self, n, scope: Scope, defaults: dict[str, Origins]) -> None:
        """A function is walked once, when all around it is known."""
        if id(n) in self.quals and id(n) not in self.queued:
            self.queued.add(id(n))
            self.todo.append((n, Scope(self.quals[id(n)], scope), scope, defaults))

    def _inner(self, scope: Scope) -> Scope:
        """A method's own functions are not methods."""
        plain = Scope(scope.fn)
        plain.functions, plain.classes = scope.functions, scope.classes
        return plain

    def block(self, body, env: Env, scope: Scope) -> Env:
        """What holds at the end. Statements that nothing leads to are walked too: what flows there is told apart by control flow."""
        before, ended = env, env is None
        for s in body:
            if ended and before is None:
                break
            after = self.statement(s, dict(before) if ended else before, scope)
            ended = ended or after is None
            before = after if after is not None else before
        return None if ended else before

    def put(self, env: Env, scope: Scope, name: str, v: Origins) -> None:
        env[name] = v
        if not v <= (old := scope.all.get(name, NONE)):
            scope.all[name] = old | v
        if name in scope.globals:
            at = self.node(("global", name), "field", None, name, 0)
            for src in v:
                self.add("flow", scope, at, src)

    def assign(self, target, v: Origins, env: Env, scope: Scope, value=None) -> None:
        if isinstance(target, ast.Name):
            self.put(env, scope, target.id, v)
        elif isinstance(target, (ast.Tuple, ast.List)):
            same = isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts) and not any(isinstance(x, ast.Starred) for x in (*value.elts, *target.elts))
            for i, t in enumerate(target.elts):
                self.assign(t, self.value(value.elts[i], env, scope) if same else v, env, scope, value.elts[i] if same else None)
        elif isinstance(target, ast.Starred):
            self.assign(target.value, v, env, scope)
        elif isinstance(target, (ast.Attribute, ast.Subscript)):
            if isinstance(target, ast.Subscript):
                self.value(target.slice, env, scope)
            if field := self.field(target, scope):
                for src in v:
                    self.add("flow", scope, field, src)
                return
            base = target
            while isinstance(base, (ast.Attribute, ast.Subscript)):
                base = base.value
            if isinstance(base, ast.Name):
                self.put(env, scope, base.id, env.get(base.id, NONE) | v)

    def field(self, e, scope: Scope) -> int | None:
        """The node of an attribute of the object that a method is called on."""
        while isinstance(e, ast.Subscript):
            e = e.value
        while isinstance(e, ast.Attribute) and isinstance(e.value, (ast.Attribute, ast.Subscript)):
            e = e.value
            while isinstance(e, ast.Subscript):
                e = e.value
        if isinstance(e, ast.Attribute) and isinstance(e.value, ast.Name):
            for s in scope.chain():
                if s.me and s.me == e.value.id:
                    return self.node(("field", s.cls_of_me, e.attr), "field", None, f"{s.cls_of_me}.{e.attr}", 0)
        return None

    def statement(self, s, env: Env, scope: Scope) -> Env:
        v = self.value
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in s.decorator_list:
                v(d, env, scope)
            plain = [*s.args.posonlyargs, *s.args.args]
            defaults = dict(zip([p.arg for p in plain[len(plain) - len(s.args.defaults) :]], [v(d, env, scope) for d in s.args.defaults], strict=True))
            defaults |= {p.arg: v(d, env, scope) for p, d in zip(s.args.kwonlyargs, s.args.kw_defaults, strict=True) if d is not None}
            self.later(s, scope, defaults)
        elif isinstance(s, ast.ClassDef):
            for x in (*s.decorator_list, *s.bases, *(k.value for k in s.keywords)):
                v(x, env, scope)
            if id(s) in self.quals:
                own = Scope(self.quals[id(s)], scope, self.quals[id(s)])
                self._functions(s.body, own)
                self.block(s.body, dict(env), own)
        elif isinstance(s, ast.Return):
            for src in v(s.value, env, scope) if s.value else ():
                self.add("ret", scope, None, src)
            return None
        elif isinstance(s, ast.Raise):
            for x in (s.exc, s.cause):
                if x is not None:
                    v(x, env, scope)
            return None
        elif isinstance(s, (ast.Break, ast.Continue)):
            if self.breaks:
                self.breaks[-1][isinstance(s, ast.Continue)].append(env)
            return None
        elif isinstance(s, ast.Assign):
            got = v(s.value, env, scope)
            if isinstance(s.value, ast.Lambda):
                self.later(s.value, scope, {})
            for t in s.targets:
                if isinstance(t, ast.Name) and isinstance(s.value, ast.Call):
                    self.kind(t.id, s.value.func, scope)
                self.assign(t, got, env, scope, s.value)
        elif isinstance(s, ast.AnnAssign):
            if s.value is not None:
                self.assign(s.target, v(s.value, env, scope), env, scope, s.value)
        elif isinstance(s, ast.AugAssign):
            self.assign(s.target, v(s.value, env, scope) | v(s.target, env, scope), env, scope)
        elif isinstance(s, ast.If):
            v(s.test, env, scope)
            checked = self.checked(s.test, env, scope)
            yes, no = dict(env), dict(env)
            (no if isinstance(s.test, ast.UnaryOp) and isinstance(s.test.op, ast.Not) else yes).update(checked)
            return merge(self.block(s.body, yes, scope), self.block(s.orelse, no, scope))
        elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            return self.loop(s, env, scope)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for i in s.items:
                got = v(i.context_expr, env, scope)
                if i.optional_vars is not None:
                    self.assign(i.optional_vars, got, env, scope)
            return self.block(s.body, env, scope)
        elif isinstance(s, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            seen, at = [dict(env)], dict(env)
            for x in s.body:
                if at is None:
                    break
                at = self.statement(x, at, scope)
                if at is not None:
                    seen.append(dict(at))
            ends = [self.block(s.orelse, at, scope) if at is not None else None]
            for h in s.handlers:
                if h.type is not None:
                    v(h.type, env, scope)
                start = merge(*seen)
                if h.name:
                    start[h.name] = NONE
                ends.append(self.block(h.body, start, scope))
            after = merge(*ends)
            if s.finalbody:
                if after is None:
                    self.block(s.finalbody, merge(*seen), scope)
                    return None
                return self.block(s.finalbody, after, scope)
            return after
        elif isinstance(s, ast.Match):
            got, ends = v(s.subject, env, scope), [env]
            for c in s.cases:
                own = dict(env)
                for x in ast.walk(c.pattern):
                    name = getattr(x, "name", None) or getattr(x, "rest", None)
                    if isinstance(x, (ast.MatchAs, ast.MatchStar, ast.MatchMapping)) and name:
                        self.put(own, scope, name, got)
                if c.guard is not None:
                    v(c.guard, own, scope)
                    own |= self.checked(c.guard, own, scope)
                ends.append(self.block(c.body, own, scope))
            return merge(*ends)
        elif isinstance(s, (ast.Global, ast.Nonlocal)):
            if isinstance(s, ast.Global):
                scope.globals.update(s.names)
        else:
            for x in ast.iter_child_nodes(s):
                if isinstance(x, ast.expr):
                    v(x, env, scope)
        return env

    def kind(self, name: str, f: ast.expr, scope: Scope) -> None:
        """Remember the class that made a variable's object."""
        if isinstance(f, ast.Name) and (cls := self.class_of(scope, f.id)):
            scope.kinds[name] = cls
        elif dotted(f).partition(".")[0] in self.alias and dotted(f).rpartition(".")[2][:1].isupper():
            scope.kinds[name] = self.resolved(dotted(f))

    def loop(self, s, env: Env, scope: Scope) -> Env:
        head = dict(env)
        while True:
            at = dict(head)
            if isinstance(s, ast.While):
                self.value(s.test, at, scope)
                at |= self.checked(s.test, at, scope)
            else:
                self.assign(s.target, self.value(s.iter, at, scope), at, scope)
            self.breaks.append(([], []))
            end = self.block(s.body, at, scope)
            left, again = self.breaks.pop()
            back = merge(head, end, *again)
            if not changed(back, head):
                break
            head = back
        return merge(self.block(s.orelse, dict(head), scope), *left)

    def checked(self, test, env: Env, scope: Scope) -> dict[str, Origins]:
        """Names that calls in a condition look at, as checked values."""
        out = {}
        for c in ast.walk(test):
            if isinstance(c, ast.Call):
                names = {x.id for part in (*c.args, c.func) for x in ast.walk(part) if isinstance(x, ast.Name) and x.id in env and env[x.id]}
                for x in sorted(names):
                    at = self.node(("check", id(c), x), "check", scope, self.resolved(dotted(c.func)), c.lineno)
                    self.keep.append(c)
                    for src in out.get(x, env[x]):
                        self.add("flow", scope, at, src)
                    out[x] = Origins([at])
        return out

    # --- expressions ------------------------------------------------------------------------------

    def value(self, e, env: Env, scope: Scope) -> Origins:
        if isinstance(e, ast.Constant):
            return NONE
        if isinstance(e, ast.Name):
            return self.name(e, env, scope)
        if isinstance(e, (ast.Attribute, ast.Subscript)):
            return self.chain(e, env, scope)
        if isinstance(e, ast.Call):
            return self.call(e, env, scope)
        if isinstance(e, ast.NamedExpr):
            got = self.value(e.value, env, scope)
            self.assign(e.target, got, env, scope)
            return got
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            own = dict(env)
            for g in e.generators:
                self.assign(g.target, self.value(g.iter, own, scope), own, scope)
                for c in g.ifs:
                    self.value(c, own, scope)
            return self.value(e.elt, own, scope) if not isinstance(e, ast.DictComp) else self.value(e.key, own, scope) | self.value(e.value, own, scope)
        if isinstance(e, ast.Lambda):
            own = {k: x for k, x in env.items() if k not in {a.arg for a in ast.walk(e.args) if isinstance(a, ast.arg)}}
            return self.value(e.body, own, scope)
        if isinstance(e, (ast.Yield, ast.YieldFrom)):
            got = self.value(e.value, env, scope) if e.value else NONE
            for src in got:
                self.add("ret", scope, None, src)
            return NONE
        if isinstance(e, ast.IfExp):
            self.value(e.test, env, scope)
            return self.value(e.body, {**env, **self.checked(e.test, env, scope)}, scope) | self.value(e.orelse, env, scope)
        out = NONE
        for x in ast.iter_child_nodes(e):
            if isinstance(x, ast.expr):
                out |= self.value(x, env, scope)
        return out

    def name(self, e: ast.Name, env: Env, scope: Scope) -> Origins:
        if e.id in env:
            return env[e.id]
        out, found = NONE, False
        for s in scope.chain():
            if s is not scope and not s.cls and e.id in s.all:
                out, found = s.all[e.id], True
                break
        if e.id in self.shared:
            out |= Origins([self.node(("global", e.id), "field", None, e.id, 0)])
        if not found and "." in self.alias.get(e.id, ""):
            out |= Origins([self.node(("read", id(e)), "read", scope, self.alias[e.id], e.lineno)])
            self.keep.append(e)
        return out

    def chain(self, e, env: Env, scope: Scope) -> Origins:
        name, base, out = self.resolved(dotted(e)), e, NONE
        while isinstance(base, (ast.Attribute, ast.Subscript)):
            if isinstance(base, ast.Subscript):
                out |= self.value(base.slice, env, scope)
            base = base.value
        if (field := self.field(e, scope)) is not None:
            out |= Origins([field])
        if isinstance(base, ast.Name):
            out |= env.get(base.id) or (self.name(base, env, scope) if base.id not in self.alias else NONE)
        else:
            out |= self.value(base, env, scope)
        if "." in name:
            out |= Origins([self.node(("read", id(e)), "read", scope, name, e.lineno)])
            self.keep.append(e)
        return out

    def call(self, e: ast.Call, env: Env, scope: Scope) -> Origins:
        f, first = e.func, e.args[0] if e.args else next((k.value for k in e.keywords if k.arg == "args"), None)
        shell = any(k.arg == "shell" and not (isinstance(k.value, ast.Constant) and not k.value.value) for k in e.keywords)
        shape = "const" if len(e.args) >= 2 and isinstance(first, ast.Constant) else "list" if isinstance(first, (ast.List, ast.Tuple)) and not shell else None
        at = self.node(("call", id(e)), "result", scope, self.resolved(dotted(f)), e.lineno, text=shape)
        self.keep.append(e)
        for i, a in enumerate(e.args):
            star = isinstance(a, ast.Starred)
            for src in self.value(a.value if star else a, env, scope):
                self.add("arg", scope, at, src, None, e.lineno, -1 if star else i)
        for k in e.keywords:
            for src in self.value(k.value, env, scope):
                self.add("arg", scope, at, src, k.arg, e.lineno, -2 if k.arg is None else -3)
        if isinstance(f, ast.Attribute):
            for src in self.value(f.value, env, scope):
                self.add("recv", scope, at, src)
        elif not isinstance(f, ast.Name):
            for src in self.value(f, env, scope):
                self.add("recv", scope, at, src)
        for name, shift, here in self.targets(f, scope):
            self.add("target", scope, at, None, name, e.lineno, shift, here)
        return Origins([at])


def def_use_of(path: str, content: str | None) -> list[tuple]:
    """Rows of one file; none where it can't be parsed (the facts have an error row for it)."""
    if content is None or len(content) > LIMIT:
        return []
    try:
        return list(DefUse(path, ast.parse(content)).rows)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def def_use(files: DataFrame) -> DataFrame:
    """Definitions and uses of ``files(path, content)``."""
    return _rows(files, def_use_of, FACTS, _FACTS)


# --- files as rows that don't name their package --------------------------------------------------


def root_of(path: str) -> str:
    """First part of a file's module where its path begins with it and it is a plain identifier, else ""."""
    root = module_of(path)[0].partition(".")[0]
    return root if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", root) and path.startswith(root) else ""


def _relative(path: str, content: str, root: str) -> tuple:
    """Facts with the root taken out of dotted names, what they own and ask for, other roots' names that they bind, a digest."""
    own = lambda name: OWN + name[len(root) :] if root and name is not None and (name == root or name.startswith(f"{root}.")) else name
    facts, owns, asks, bound = [], set(), set(), []
    for _, kind, fn, id, src, name, line, pos, text in def_use_of(path, content):
        if kind in _DOTTED or kind == "target" and text is None:
            name = own(name)
        if kind == "bind":
            text = own(text)
            if text[:1] != OWN:
                bound.append(text)
        if kind in ("module", "def", "bind"):
            owns.add(name.partition(".")[0])
        if kind == "bind" or kind == "target" and text is None:
            asks.add((text if kind == "bind" else name).partition(".")[0])
        facts.append((kind, fn, id, src, name, line, pos, text))
    digest = hashlib.blake2b(repr((path[len(root) :], facts)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return facts, sorted(owns - {OWN}), sorted(asks - {OWN}), bound, digest


def file_of(path: str, content: str | None) -> tuple | None:
    """The row of a file; None if it has no facts."""
    root = root_of(path)
    if content is not None and root and len(content) <= _SHORT and root not in content:
        key = (path[len(root) :], content)
        if key not in _kept:
            if len(_kept) >= _KEPT:
                _kept.clear()
            _kept[key] = _relative(path, content, root)
        facts, owns, asks, bound, digest = _kept[key]
    else:
        facts, owns, asks, bound, digest = _relative(path, content, root)
    if not facts:
        return None
    # of several targets the smallest stands: whether those of other roots come before this one's own is told as well
    if root:
        digest = hashlib.blake2b(digest + bytes(2 * (t < root) + (t < f"{root}.") for t in bound), digest_size=16).digest()
    a, b = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
    return path, root, a, b, owns, asks, facts


def file_facts(files: DataFrame) -> DataFrame:
    """Definitions and uses of ``files(path, content)``, a row for each file that has any: path, root, a, b, owns, asks, facts.

    ``root`` is the first part of its module ("": it has no plain one). In ``facts`` names that begin with the root begin with OWN
    instead, so files of packages that differ by name only have equal facts; a and b are 128 bits of their digest, with the path
    after the root. ``owns`` are first parts of names that it defines besides the root's, ``asks`` those that it binds or calls.
    Of files with equal digests in a task only the first has its facts, others null: ``facts_again`` gives them back.
    """

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FILES)], schema=_FILES)

    def own(batches):
        gc.disable()  # as in python_facts
        told: set[tuple[int, int]] = set()
        try:
            for b in batches:
                rows, size = [], 0
                for p, c in zip(b["path"], b["content"], strict=True):
                    if (r := file_of(p.as_py() or "", c.as_py())) is None:
                        continue
                    size += 200 + len(r[0])
                    if r[2:4] in told:
                        r = (*r[:6], None)
                    else:
                        if len(told) >= _TOLD:
                            told.clear()
                        told.add(r[2:4])
                        size += sum([100 + len(f[1]) + len(f[4] or "") + len(f[7] or "") for f in r[6]])
                    rows.append(r)
                    if size > BATCH:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)
                gc.collect()
        finally:
            gc.enable()

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(own, FILES)


def led(name: Column, root: Column) -> Column:
    """A name of ``file_facts`` with the root put back."""
    return F.when(name.startswith(OWN), F.concat(root, F.substr(name, F.lit(2)))).otherwise(name)


def facts_again(some: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``def_use`` for ``some`` of the rows that ``file_facts`` gave for ``files``; both are written tables."""
    lack = some.where("facts is null").select("path", "root", "a", "b")
    like = files.where("facts is not null").select("a", "b", "facts").join(lack.select("a", "b").distinct(), ["a", "b"], "left_semi")
    lack = lack.join(like.groupBy("a", "b").agg(F.first("facts").alias("facts")), ["a", "b"])
    rows = some.where("facts is not null").select("path", "root", "facts").union(lack.select("path", "root", "facts"))
    rows = rows.select("path", "root", F.explode("facts").alias("f")).select("path", "root", "f.*")
    text = F.when(F.col("kind") == "bind", led(F.col("text"), F.col("root"))).otherwise(F.col("text"))
    return rows.select("path", "kind", "fn", "id", "src", led(F.col("name"), F.col("root")).alias("name"), "line", "pos", text.alias("text"))
