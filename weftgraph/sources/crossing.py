"""Names by which Java, Rust and TypeScript files offer their symbols, and call those of others.

A call that leaves its file is written as choices, ``=group;group``: the groups in order of
preference, each of names (``,`` between them) of which exactly one may exist. Every file also
lists the names of its own symbols, so resolving is one join, whatever the language.

* Java: fully qualified names. A simple class name means the imported class, else one of its own
  package, else one of a wildcard import; a bare call is of a static import.
* Rust: paths within a crate (the folder above ``src``). ``crate``, ``self`` and ``super`` start from
  the file's place in the module tree; other paths are a child module's, else another crate's.
  Globs are asked last, all of them at once.
* TypeScript: paths relative to the importing file. An ``index`` file answers to its folder's name
  too, and a module with one symbol to ``default``.

Variables count by their declared or constructed type.
"""

from __future__ import annotations

import posixpath
import re

#: Types that a name in a call can mean.
CALLABLE = {"function", "method", "class", "constructor", "struct", "def"}
_SUFFIX = re.compile(r"\.(?:[cm]?[jt]sx?|java|rs)$")
_DECLARED = {
    "java": (r"\b(?P<type>[A-Z]\w*)(?:<[^<>;(){}]*>)?\s+(?P<var>[a-z_]\w*)\s*(?=[=;,):])",),
    "rust": (
        r"\b(?P<var>[a-z_]\w*)\s*:\s*&?\s*(?:mut\s+)?(?P<type>(?:\w+::)*[A-Z]\w*)",
        r"\blet\s+(?:mut\s+)?(?P<var>\w+)\s*=\s*(?P<type>(?:\w+::)*[A-Z]\w*)(?=::\w+\s*\(|\s*\{)",
    ),
    "typescript": (
        r"\b(?P<var>[a-z_$][\w$]*)\??\s*:\s*(?P<type>[A-Z]\w*)",
        r"\b(?:const|let|var)\s+(?P<var>[\w$]+)\s*=\s*new\s+(?P<type>[A-Z]\w*)",
    ),
}
_DECLARED = {name: tuple(re.compile(p) for p in patterns) for name, patterns in _DECLARED.items()}


def _plain(part: str) -> str:
    return re.sub(r"[.,;=\s]", "_", part)


def _ts_name(path: str) -> str:
    return "ts." + ".".join(_plain(p) for p in _SUFFIX.sub("", path).split("/"))


def _rust_home(path: str) -> tuple[str, list[str]]:
    """The crate's folder and the file's modules below it."""
    parts = [_plain(p) for p in _SUFFIX.sub("", path).split("/")]
    at = len(parts) - 1 - parts[::-1].index("src") if "src" in parts else -1
    modules = parts[at + 1 :]
    if modules[-1] in ("mod", "lib", "main"):
        modules.pop()
    return "/".join(parts[: max(at, 0)]), modules


def exports(name: str, path: str, module: str, nodes: list[tuple]) -> list[tuple[str, str]]:
    """(id, name) of the symbols that other files can call."""
    found = [(id_, id_[len(module) + 1 :]) for id_, _, type_, _ in nodes if type_ in CALLABLE]
    if name == "java":
        package = next((label for _, label, type_, _ in nodes if type_ == "package"), "")
        return [(id_, f"java.{package}.{own}") for id_, own in found]
    if name == "rust":
        crate, modules = _rust_home(path)
        names = [(id_, ".".join([*modules, own])) for id_, own in found]
        outside = _plain(crate.rpartition("/")[2]).replace("-", "_")
        return [(i, f"rust.{crate}:{n}") for i, n in names] + [(i, f"crate.{outside}.{n}") for i, n in names if outside]
    if name == "typescript":
        whole = _ts_name(path)
        folder, _, last = whole.rpartition(".")
        out = [(id_, f"{whole}.{own}") for id_, own in found]
        top = [id_ for id_, own in found if "." not in own]
        if len(top) == 1:
            out.append((top[0], f"{whole}.default"))
        if last == "index":
            out += [(id_, folder + n[len(whole) :]) for id_, n in out]
        return out
    return []


def relative_module(path: str, target: str) -> str | None:
    """The name of the module that a relative import of ``path`` means."""
    if not target.startswith("."):
        return None
    found = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
    return None if found.startswith("..") else "=" + _ts_name(found)


def variable_types(name: str, text: str) -> dict[str, str]:
    """Type by variable; one that is declared with several types has none."""
    out: dict[str, set[str]] = {}
    for pattern in _DECLARED.get(name, ()):
        for m in pattern.finditer(text):
            out.setdefault(m["var"], set()).add(m["type"])
    return {k: next(iter(v)) for k, v in out.items() if len(v) == 1}


def written(groups: list[list[str]]) -> str | None:
    groups = [list(dict.fromkeys(g)) for g in groups if g]
    return "=" + ";".join(",".join(g) for g in groups) if groups else None


class JavaNames:
    """What simple names mean in a Java file."""

    def __init__(self, package: str):
        self.package = package
        self.classes: dict[str, str] = {}
        self.members: dict[str, str] = {}
        self.packages: list[str] = []
        self.owners: list[str] = []

    def add(self, path: str, static: bool) -> None:
        head, _, last = path.rpartition(".")
        if last == "*":
            (self.owners if static else self.packages).append(head)
        else:
            (self.members if static else self.classes)[last] = path

    def of_class(self, simple: str, member: str = "") -> list[list[str]]:
        tail = f".{member}" if member else ""
        if simple in self.classes:
            return [[f"java.{self.classes[simple]}{tail}"]]
        return [[f"java.{self.package}.{simple}{tail}"], [f"java.{p}.{simple}{tail}" for p in self.packages]]

    def bare(self, called: str, new: bool) -> list[list[str]]:
        if new:
            return self.of_class(called)
        if called in self.members:
            return [[f"java.{self.members[called]}"]]
        return [[f"java.{o}.{called}" for o in self.owners]]


class RustNames:
    """What paths mean in a Rust file."""

    def __init__(self, path: str):
        self.crate, self.modules = _rust_home(path)
        self.bound: dict[str, list[str]] = {}
        self.globs: list[list[str]] = []

    def add(self, local: str, parts: list[str]) -> None:
        if parts[-1] == "*":
            self.globs.append(parts[:-1])
        else:
            self.bound[local] = parts

    def _whole(self, parts: list[str], within: list[str]) -> list[list[str]]:
        start = 0
        if parts[0] == "crate":
            within, start = [], 1
        while start < len(parts) and parts[start] in ("self", "super"):
            within, start = within[:-1] if parts[start] == "super" else within, start + 1
        inside = [f"rust.{self.crate}:{'.'.join([*within, *parts[start:]])}"]
        return [inside] if start else [inside, ["crate." + ".".join(parts)]]

    def choices(self, parts: list[str], inner: list[str]) -> list[list[str]]:
        """Of a path called in the inline modules ``inner`` of the file."""
        within = [*self.modules, *inner]
        if parts[0] in self.bound:
            return self._whole([*self.bound[parts[0]], *parts[1:]], within)
        groups = self._whole(parts, within) if len(parts) > 1 else []
        return groups + [[n for g in self.globs for n in self._whole([*g, *parts], within)[0]]]
