"""Symbols and calls of one Python file, from its syntax tree.

One walk notes the symbols of all scopes; a second one resolves calls against them. A call that
may mean several things, or something outside the file that no import names, makes no edge.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

Row = tuple[str, str, str, str, int, str, str, str | None]


@dataclass
class Symbols:
    """What a file defines: kinds by id, base names of classes, and what imported names stand for."""

    kind: dict[str, str] = field(default_factory=dict)
    bases: dict[str, list[str]] = field(default_factory=dict)
    imported: dict[str, tuple[str, str]] = field(default_factory=dict)


FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _safe(name: str) -> str:
    return name.replace(".", "_").replace("-", "_")


def symbols(tree: ast.AST, module: str, path: str) -> tuple[Symbols, list[tuple], list[tuple]]:
    """Symbols, node rows (id, label, type, line) and edge rows (src, dst, relation) of a tree."""
    found, nodes, edges = Symbols(), [], []
    todo = [(tree, module)]
    while todo:
        at, scope = todo.pop()
        for child in ast.iter_child_nodes(at):
            if isinstance(child, (ast.ClassDef, *FUNCTIONS)):
                own = f"{scope}.{child.name}"
                found.kind[own] = "class" if isinstance(child, ast.ClassDef) else "function"
                if isinstance(child, ast.ClassDef):
                    found.bases[own] = [b.id for b in child.bases if isinstance(b, ast.Name)]
                nodes.append((own, child.name, found.kind[own], child.lineno))
                edges.append((scope, own, "contains"))
                todo.append((child, own))
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                prefix = child.module or "" if isinstance(child, ast.ImportFrom) else None
                for alias in child.names:
                    if alias.name == "*":
                        continue
                    name = alias.asname or alias.name
                    own = f"{scope}.import_{_safe(name if prefix is None else f'{prefix}_{name}')}"
                    meaning = f"{prefix}.{alias.name}" if prefix else alias.name
                    found.imported[name] = (own, meaning)
                    nodes.append((own, meaning, "import", child.lineno))
                    edges.append((scope, own, "imports_from"))
            else:
                todo.append((child, scope))
    return found, nodes, edges


class Calls:
    """Edges (src, dst, pending symbol) of the calls of a tree."""

    def __init__(self, found: Symbols, module: str):
        self.found, self.module = found, module
        self.edges: dict[tuple[str, str, str | None], None] = {}

    def member(self, cls: str, name: str) -> str | None:
        """A method of a class or of the first of its bases in this file, breadth first."""
        queue, seen = [cls], set()
        for c in queue:
            if c not in seen:
                seen.add(c)
                if self.found.kind.get(f"{c}.{name}") == "function":
                    return f"{c}.{name}"
                queue += [b for x in self.found.bases.get(c, []) if self.found.kind.get(b := f"{self.module}.{x}") == "class"]
        return None

    def plain(self, name: str, scopes: list[tuple[str, str]]) -> str | None:
        """A bare name, in the enclosing scopes; those of classes are not seen from within."""
        return next((f"{s}.{name}" for s, kind in reversed(scopes) if kind != "class" and f"{s}.{name}" in self.found.kind), None)

    def target(self, func: ast.expr, scopes: list, cls: str | None, types: dict[str, str]) -> tuple[str, str | None] | None:
        if isinstance(func, ast.Name):
            own = self.plain(func.id, scopes)
            return (own, None) if own else self.found.imported.get(func.id)
        if not (isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name)):
            return None
        on = func.value.id
        holder = cls if on in ("self", "cls") and cls else types.get(on)
        if holder:
            own = self.member(holder, func.attr)
            return (own, None) if own else None
        if on in self.found.imported:
            node, meaning = self.found.imported[on]
            return node, f"{meaning}.{func.attr}"
        return None

    def walk(self, at: ast.AST, scopes: list, cls: str | None, types: dict[str, str]) -> None:
        if isinstance(at, FUNCTIONS):
            # Decorators and defaults belong to the scope that defines the function.
            for outer in (*at.decorator_list, *at.args.defaults, *filter(None, at.args.kw_defaults)):
                self.walk(outer, scopes, cls, types)
            inner, own = {}, [*scopes, (f"{scopes[-1][0]}.{at.name}", "function")]
            for x in at.body:
                self.walk(x, own, cls, inner)
            return
        if isinstance(at, ast.ClassDef):
            for outer in at.decorator_list:
                self.walk(outer, scopes, cls, types)
            own = f"{scopes[-1][0]}.{at.name}"
            for x in at.body:
                self.walk(x, [*scopes, (own, "class")], own, types)
            return
        if isinstance(at, ast.Call) and (to := self.target(at.func, scopes, cls, types)):
            self.edges[(scopes[-1][0], *to)] = None
        for child in ast.iter_child_nodes(at):
            self.walk(child, scopes, cls, types)
        if isinstance(at, (ast.Assign, ast.AnnAssign)):
            self._bind(at, scopes, types)

    def _bind(self, at: ast.Assign | ast.AnnAssign, scopes: list, types: dict[str, str]) -> None:
        """A name bound to a new object of a class here has its type until it is bound again."""
        named = [at.annotation] if isinstance(at, ast.AnnAssign) else []
        made = [at.value.func] if isinstance(at.value, ast.Call) else []
        options = [self.plain(x.id, scopes) for x in named + made if isinstance(x, ast.Name)]
        of = next((c for c in options if c and self.found.kind[c] == "class"), None)
        for t in at.targets if isinstance(at, ast.Assign) else [at.target]:
            if isinstance(t, ast.Name):
                types.pop(t.id, None)
                if of:
                    types[t.id] = of


def parse(path: str, content: str, module: str) -> tuple[list[tuple], list[tuple]]:
    """(id, label, type, line) and (src, dst, relation, symbol) rows; none at all on a syntax error."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return [], []
    name = path.rpartition("/")[2]
    found, nodes, edges = symbols(tree, module, path)
    calls = Calls(found, module)
    for x in tree.body:
        calls.walk(x, [(module, "module")], None, calls.__dict__.setdefault("top", {}))
    known = {module, *(n[0] for n in nodes)}
    made = [(s, d, "calls", symbol) for s, d, symbol in calls.edges if s in known and d in known]
    return [(module, name.rpartition(".")[0], "module", 1), *nodes], [(*e, None) for e in edges] + made
