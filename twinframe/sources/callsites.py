"""How the results of callable factories are used: called at once, stored and reused, registered, piped or cached. One walk over a file with lexical scopes."""

from __future__ import annotations

import ast

from .python_code import words

KINDS = ("immediate", "stored_reuse", "registered", "pipeline", "cached")
#: Words of callees and targets that tell a kind.
REGISTER, PIPELINE, CACHE = {"register", "add", "append", "subscribe", "connect", "route", "bind"}, {"map", "filter", "reduce", "pipe", "compose", "apply", "chain"}, {"cache", "caches", "memo", "registry", "lookup", "table"}


def is_factory(return_type: str) -> bool:
    """Whether a declared return type is callable."""
    return any(w in return_type for w in ("Callable", "=>", "Function")) and return_type != "UNKNOWN"


class Tracker(ast.NodeVisitor):
    """Collects (kind, factory, line) of uses; names bound to a factory's result are known in their scope and inner ones, until bound anew."""

    def __init__(self, factories: set[str]):
        self.factories, self.found = factories, []
        self.scopes: list[dict[str, str | None]] = [{}]

    def made_by(self, node: ast.AST | None) -> str | None:
        """The factory that an expression's value comes from."""
        if isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            return name if name in self.factories else None
        if isinstance(node, ast.Name):
            return next((s[node.id] for s in reversed(self.scopes) if node.id in s), None)
        return None

    def inner(self, node: ast.AST, bound: list[str]) -> None:
        self.scopes.append(dict.fromkeys(bound))
        self.generic_visit(node)
        self.scopes.pop()

    def visit_function(self, node) -> None:
        self.scopes[-1][node.name] = None
        self.inner(node, [a.arg for a in ast.walk(node.args) if isinstance(a, ast.arg)])

    visit_FunctionDef = visit_AsyncFunctionDef = visit_function

    def visit_Lambda(self, node: ast.Lambda) -> None:
        self.inner(node, [a.arg for a in ast.walk(node.args) if isinstance(a, ast.arg)])

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.inner(node, [])

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        factory = self.made_by(node.value)
        for t in node.targets:
            if isinstance(t, ast.Name):
                self.scopes[-1][t.id] = factory
            elif factory and isinstance(t, ast.Subscript | ast.Attribute):
                named = set(words(ast.unparse(t.value if isinstance(t, ast.Subscript) else t)))
                self.add("cached" if named & CACHE else "registered" if isinstance(t, ast.Subscript) else "stored_reuse", factory, node)

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Call) and (f := self.made_by(node.func)):
            self.add("immediate", f, node)
        elif isinstance(node.func, ast.Name) and (f := self.made_by(node.func)):
            self.add("stored_reuse", f, node)
        callee = set(words(node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")))
        for a in (*node.args, *(k.value for k in node.keywords)):
            if f := self.made_by(a):
                kind = "registered" if callee & REGISTER else "pipeline" if callee & PIPELINE else None
                if kind:
                    self.add(kind, f, node)
        self.generic_visit(node)

    def add(self, kind: str, factory: str, node: ast.AST) -> None:
        self.found.append({"kind": kind, "factory": factory, "line": node.lineno})


def callsites(source: str, factories: set[str]) -> list[dict]:
    """Uses of factories in a source text, in order; none if it doesn't parse."""
    if not factories:
        return []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    t = Tracker(factories)
    t.visit(tree)
    return sorted(t.found, key=lambda x: (x["line"], x["kind"], x["factory"]))


def factories_of(tree_rows: list[dict]) -> set[str]:
    return {r["symbol"] for r in tree_rows if is_factory(r["return_type"])}


__all__ = ["KINDS", "callsites", "factories_of", "is_factory"]
