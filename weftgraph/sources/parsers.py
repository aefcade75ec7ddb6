"""Symbols and calls of source files, by declaration tables.

Every language but Python is read by one scanner: comments and strings are blanked in place, the
declarations of the language's table are matched, and the text that each of them spans (braces,
indentation, or to its ``end``) nests them. A row of a table is a pattern with a group ``name``,
the node type, and which declarations it may stand in.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property

from weftgraph.sources import crossing, python_parser
from weftgraph.sources.code import language
from weftgraph.sources.crossing import CALLABLE


@dataclass(frozen=True)
class Declaration:
    type: str
    pattern: str
    #: Types of enclosing declarations that it needs (none: anywhere outside of functions).
    within: tuple[str, ...] = ()
    scope: bool = True

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.M)

    @cached_property
    def words(self) -> tuple[str, ...]:
        """What a match holds one of; nothing for a pattern without a fixed word."""
        fixed = self.pattern.replace(_MODS, "").replace(_NOT_WORDS, "")
        if fixed.startswith("(?i)"):
            return ()
        one = re.match(r"(?:\^?(?:\\s|\[ \\t\])\*|\\b|\^)*(?:\(\?:([a-z|]+)\)|([a-z]+))\\s", fixed)
        return tuple((one[1] or one[2]).split("|")) if one else ()


@dataclass(frozen=True)
class Language:
    declarations: tuple[Declaration, ...]
    #: Patterns with groups ``path`` and, where one import brings several names, ``names``.
    imports: tuple[str, ...] = ()
    relation: str = "imports_from"
    #: Group patterns of supertypes, searched in the head of a declaration.
    supers: tuple[tuple[str, str], ...] = ()
    spans: str = "brace"
    line_comment: str = "//"
    block_comment: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'"
    calls: bool = False
    package: str = ""
    own: tuple[str, ...] = ("this",)

    @cached_property
    def hidden(self) -> re.Pattern:
        """Strings and comments."""
        q = "|".join(rf"{c}(?:\\.|[^{c}\\\n])*{c}" if c != "`" else r"`(?:\\.|[^`\\])*`" for c in self.quotes)
        parts = [q] + ([re.escape(self.block_comment[0]) + r".*?(?:" + re.escape(self.block_comment[1]) + r"|\Z)"] if self.block_comment else []) + [re.escape(self.line_comment) + r"[^\n]*"]
        # A block comment may begin with what begins a line comment: it is tried first.
        return re.compile("|".join(parts), re.S)


D = Declaration
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|async|override|virtual|partial|readonly|open|data|inner|inline|suspend|lateinit|case|implicit|lazy|unsafe|extern|default|synchronized|native|export|declare|indirect|mutating|convenience|required|fileprivate|const|pub(?:\([^)]*\))?)\s+)*"
_TYPES = ("class", "interface", "struct", "trait", "enum", "object", "extension", "protocol", "impl", "record")
_NOT_WORDS = r"(?!(?:if|for|while|switch|catch|return|new|else|do|try|throw|await|typeof|using|lock|foreach|match|when|super|sizeof)\b)"
_C_FAMILY = Language(
    (D("macro", r"^[ \t]*#[ \t]*define[ \t]+(?P<name>\w+)", scope=False), D("namespace", r"^\s*namespace\s+(?P<name>\w+)"), D("struct", r"^\s*(?:typedef\s+)?(?:template\s*<[^;{]*>\s*)?(?:struct|union)\s+(?P<name>\w+)(?=[^;()]*\{)"), D("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>\w+)(?=[^;]*\{)"), D("class", r"^\s*(?:template\s*<[^;{]*>\s*)?class\s+(?P<name>\w+)(?=[^;]*\{)"), D("typedef", r"^\s*typedef\b[^;{]*?\b(?P<name>\w+)\s*;", scope=False), D("function", rf"^[ \t]*{_NOT_WORDS}(?:[\w:<>,*&~]+[ \t*&]+)+(?:\w+::)?(?P<name>~?\w+)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?=\{{)")),
    (r"^[ \t]*#[ \t]*include[ \t]*[<\"](?P<path>[^>\"]+)[>\"]",),
)
TABLES: dict[str, Language] = {
    "typescript": Language(
        (D("class", rf"\b{_MODS}class\s+(?P<name>[\w$]+)"), D("interface", rf"\b{_MODS}interface\s+(?P<name>[\w$]+)"), D("function", r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>]*>)?\s*\("), D("function", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"), D("function", rf"^[ \t]*{_MODS}(?:get\s+|set\s+|\*\s*)?{_NOT_WORDS}(?P<name>[\w$]+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{{;=]+)?(?=\{{)", ("class",))),
        (r"\bimport\s+(?P<names>[^'\";]+?)\s+from\s*['\"](?P<path>[^'\"]+)['\"]", r"\bimport\s*['\"](?P<path>[^'\"]+)['\"]"), supers=(("extends", r"\bextends\s+([\w$.]+)"), ("implements", r"\bimplements\s+([\w$.,\s]+)")), quotes="\"'`", calls=True,
    ),
    "go": Language(
        (D("class", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"), D("interface", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"), D("function", r"^func\s+(?:\(\s*(?P<var>\w+)?\s*\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(")),
        (r"^import\s+(?:(?P<names>[\w.]+)\s+)?\"(?P<path>[^\"]+)\"", r"^\s+(?:(?P<names>[\w.]+)\s+)?\"(?P<path>[^\"\s]+)\"\s*$"), quotes="\"`'", calls=True, package=r"^package\s+(\w+)",
    ),
    "java": Language(
        (D("class", rf"\b{_MODS}(?:class|record)\s+(?P<name>\w+)"), D("interface", rf"\b{_MODS}@?interface\s+(?P<name>\w+)"), D("enum", rf"\b{_MODS}enum\s+(?P<name>\w+)"), D("constructor", rf"^[ \t]*(?:(?:public|private|protected)\s+)?{_NOT_WORDS}(?P<name>[A-Z]\w*)\s*\([^)]*\)\s*(?:throws[^{{]+)?(?=\{{)", _TYPES), D("method", rf"^[ \t]*{_MODS}(?:<[^>]+>\s*)?{_NOT_WORDS}[\w.<>\[\],?]+(?:\s+|(?<=[>\]])\s*){_NOT_WORDS}(?P<name>\w+)\s*\([^)]*\)\s*(?:throws[^{{;]+)?(?=[{{;])", _TYPES)),
        (r"^\s*import\s+(?P<static>static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;",), supers=(("extends", r"\bextends\s+([\w.]+)"), ("implements", r"\bimplements\s+([\w.,\s]+)")), calls=True, package=r"^\s*package\s+([\w.]+)",
    ),
    "rust": Language(
        (D("module", rf"^\s*{_MODS}mod\s+(?P<name>\w+)"), D("struct", rf"^\s*{_MODS}(?:struct|union)\s+(?P<name>\w+)"), D("enum", rf"^\s*{_MODS}enum\s+(?P<name>\w+)"), D("trait", rf"^\s*{_MODS}trait\s+(?P<name>\w+)"), D("macro", r"^\s*macro_rules!\s*(?P<name>\w+)"), D("impl", r"^\s*(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>\s*)?(?:(?P<trait>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<name>\w+)"), D("function", rf"^\s*{_MODS}fn\s+(?P<name>\w+)")),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<path>[^;]+);",), quotes="\"", calls=True, own=("self", "Self"),
    ),
    "csharp": Language(
        (D("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)"), D("class", rf"\b{_MODS}(?:class|record)\s+(?P<name>\w+)"), D("interface", rf"\b{_MODS}interface\s+(?P<name>\w+)"), D("enum", rf"\b{_MODS}enum\s+(?P<name>\w+)"), D("struct", rf"\b{_MODS}struct\s+(?P<name>\w+)"), D("constructor", rf"^[ \t]*(?:public|private|protected|internal)\s+(?P<name>[A-Z]\w*)\s*\([^)]*\)[^{{;]*(?=\{{)", _TYPES), D("method", rf"^[ \t]*{_MODS}{_NOT_WORDS}[\w.<>\[\],?]+\s+(?P<name>\w+)\s*(?:<[^>]*>)?\([^)]*\)[^{{;=]*(?=[{{;=])", _TYPES), D("property", rf"^[ \t]*{_MODS}[\w.<>\[\],?]+\s+(?P<name>\w+)\s*(?=\{{\s*(?:get|set))", _TYPES)),
        (r"^\s*using\s+(?:static\s+)?(?P<path>[\w.]+)\s*;",), supers=((":", r":\s*([\w.,\s<>]+)"),),
    ),
    "ruby": Language(
        (D("module", r"^\s*module\s+(?P<name>[\w:]+)"), D("class", r"^\s*class\s+(?P<name>[\w:]+)"), D("method", r"^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+)"), D("accessor", r"^\s*attr_(?:reader|writer|accessor)\s+:(?P<name>\w+)", scope=False), D("constant", r"^\s*(?P<name>[A-Z][A-Z0-9_]*)\s*=(?!=)", scope=False), D("proc", r"^\s*(?P<name>\w+)\s*=\s*(?:proc|lambda|->)", scope=False)),
        (r"^\s*require(?:_relative)?\s*\(?['\"](?P<path>[^'\"]+)['\"]",), supers=(("extends", r"<\s*([\w:]+)"), ("mixin", r"^\s*(?:include|extend|prepend)\s+([\w:]+)")), spans="indent", line_comment="#", block_comment=None,
    ),
    "php": Language(
        (D("namespace", r"^\s*namespace\s+(?P<name>[\w\\]+)", scope=False), D("class", rf"^\s*{_MODS}class\s+(?P<name>\w+)"), D("interface", r"^\s*interface\s+(?P<name>\w+)"), D("trait", r"^\s*trait\s+(?P<name>\w+)"), D("enum", r"^\s*enum\s+(?P<name>\w+)"), D("method", rf"^\s*{_MODS}function\s+&?(?P<name>\w+)\s*\(", _TYPES), D("function", r"^\s*function\s+&?(?P<name>\w+)\s*\("), D("property", r"^\s*(?:public|private|protected|static|readonly|\s)+(?:\??[\w\\|]+\s+)?\$(?P<name>\w+)", _TYPES, False)),
        (r"^\s*use\s+(?P<path>[\w\\]+)(?:\s+as\s+(?P<names>\w+))?\s*;",), supers=(("extends", r"\bextends\s+([\w\\]+)"), ("implements", r"\bimplements\s+([\w\\,\s]+)"), ("mixin", r"^\s+use\s+([\w\\,\s]+);")), own=("$this",),
    ),
    "kotlin": Language(
        (D("class", rf"\b{_MODS}(?:enum\s+|annotation\s+)?class\s+(?P<name>\w+)"), D("interface", rf"\b{_MODS}interface\s+(?P<name>\w+)"), D("object", r"\b(?:companion\s+)?object\s+(?P<name>\w+)"), D("function", rf"\b{_MODS}fun\s+(?:<[^>]+>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)\s*\(")),
        (r"^\s*import\s+(?P<path>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<names>\w+))?",), supers=(("extends", r"\)?\s*:\s*([\w.,\s()<>]+)"),), package=r"^\s*package\s+([\w.]+)",
    ),
    "scala": Language(
        (D("object", rf"^\s*{_MODS}object\s+(?P<name>\w+)"), D("class", rf"^\s*{_MODS}class\s+(?P<name>\w+)"), D("trait", rf"^\s*{_MODS}trait\s+(?P<name>\w+)"), D("def", rf"^\s*{_MODS}def\s+(?P<name>\w+)"), D("val", rf"^\s*{_MODS}val\s+(?P<name>\w+)", scope=False), D("var", rf"^\s*{_MODS}var\s+(?P<name>\w+)", scope=False)),
        (r"^\s*import\s+(?P<path>[\w.]+(?:\.(?:_|\*|\{[^}]*\}))?)",), supers=(("extends", r"\bextends\s+([\w.]+)"), ("with", r"\bwith\s+([\w.]+)")), package=r"^\s*package\s+([\w.]+)",
    ),
    "swift": Language(
        (D("class", rf"\b{_MODS}(?:class|actor)\s+(?!func|var|let)(?P<name>\w+)"), D("struct", rf"\b{_MODS}struct\s+(?P<name>\w+)"), D("enum", rf"\b{_MODS}enum\s+(?P<name>\w+)"), D("protocol", rf"\b{_MODS}protocol\s+(?P<name>\w+)"), D("extension", rf"\b{_MODS}extension\s+(?P<name>\w+)"), D("function", rf"\b{_MODS}func\s+(?P<name>\w+)"), D("property", rf"^\s*{_MODS}(?:var|let)\s+(?P<name>\w+)", _TYPES, False)),
        (r"^\s*import\s+(?P<path>\w+)",), supers=(("conforms_to", r":\s*([\w.,\s]+)"),), own=("self",),
    ),
    "c": _C_FAMILY,
    "cpp": _C_FAMILY,
    "lua": Language((D("module", r"^\s*(?:local\s+)?(?P<name>\w+)\s*=\s*\{\s*\}", scope=False), D("method", r"^\s*function\s+(?P<owner>\w+):(?P<name>\w+)", scope=False), D("function", r"^\s*(?:local\s+)?function\s+(?:(?P<owner>\w+)\.)?(?P<name>\w+)", scope=False), D("function", r"^\s*(?:local\s+)?(?P<name>\w+)\s*=\s*function\b", scope=False)), (r"\brequire\s*\(?\s*['\"](?P<path>[^'\"]+)['\"]",), line_comment="--", block_comment=("--[[", "]]")),
    "elixir": Language((D("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"), D("struct", r"^\s*defstruct\b(?P<name>)", scope=False), D("macro", r"^\s*defmacrop?\s+(?P<name>[\w?!]+)"), D("function", r"^\s*defp?\s+(?P<name>[\w?!]+)")), (r"^\s*(?P<relation>use|import|alias|require)\s+(?P<path>[\w.]+)",), spans="indent", line_comment="#", block_comment=None),
    "powershell": Language((D("class", r"(?i)^\s*class\s+(?P<name>\w+)"), D("function", r"(?i)^\s*function\s+(?P<name>[\w-]+)"), D("method", r"^\s*(?:\[[\w.\[\]]+\]\s*)(?:static\s+|hidden\s+)?(?P<name>\w+)\s*\([^)]*\)\s*(?=\{)", ("class",))), (r"(?i)^\s*(?:Import-Module|using\s+module|#requires\s+-modules?)\s+(?P<path>[\w.\\/-]+)",), relation="requires", line_comment="#", block_comment=("<#", "#>")),
}
_CALL = re.compile(
    r"(?<![\w$.:>])(?:(?P<on>[A-Za-z_$][\w$]*(?:::[A-Za-z_]\w*)*)\s*(?:\.|::|->)\s*)?(?P<name>[A-Za-z_$][\w$]*)\s*(?:::<[^>]*>)?\("
)


_DEFINES = re.compile(r"\b(?:func|function|fn|class|new\s+class|def)\s*$")


@dataclass
class Span:
    id: str
    label: str
    type: str
    start: int
    end: int
    supers: list[tuple[str, str]] = field(default_factory=list)


def blank(text: str, lang: Language) -> str:
    """``text`` with comments and the inside of strings as blanks; offsets and lines stay."""
    hollow = lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] in lang.quotes and len(m[0]) > 1 else re.sub(r"[^\n]", " ", m[0])
    return lang.hidden.sub(hollow, text)


def _body_end(text: str, at: int, lang: Language) -> int:
    """Where the declaration that begins at ``at`` ends."""
    if lang.spans == "indent":
        line = text.rfind("\n", 0, at + 1) + 1
        while line < len(text) and text[line] == "\n":
            line += 1
        depth = len(text[line : at + 80]) - len(text[line : at + 80].lstrip(" \t"))
        m = re.compile(rf"\n(?=[ \t]{{0,{depth}}}[^\s])").search(text, text.find("\n", at) if "\n" in text[at:] else len(text))
        while m and re.match(r"[ \t]*end\b", text[m.end() :]) is None and len(text[m.end() :]) and depth < len(text[m.end() :]) - len(text[m.end() :].lstrip(" \t")):
            m = re.compile(rf"\n(?=[ \t]{{0,{depth}}}[^\s])").search(text, m.end())
        return m.start() if m else len(text)
    open_, stop = text.find("{", at), text.find(";", at)
    if open_ < 0 or 0 <= stop < open_:
        return stop if stop >= 0 else len(text)
    level = 0
    for m in _BRACES.finditer(text, open_):
        level += 1 if m[0] == "{" else -1
        if level == 0:
            return m.end()
    return len(text)


_BRACES = re.compile(r"[{}]")


def import_stem(path: str) -> str:
    """The dotted module of a TypeScript import, without what leads to it."""
    return re.sub(r"^(?:\.\.?\.|@\.)+", "", re.sub(r"\.(?:[jt]sx?|mjs|cjs)$", "", path).replace("/", ".")).lstrip(".@")


def import_pairs(name: str, m: re.Match) -> list[tuple[str, str]]:
    """(local name, dotted symbol) pairs that an import binds."""
    path, names = m["path"].strip(), (m.groupdict().get("names") or "").strip()
    if name == "rust":
        return use_pairs(path)
    if name == "go":
        package = re.sub(r"/v\d+$", "", path)
        return [(names or package.rpartition("/")[2], package.replace("/", "."))]
    dotted = re.sub(r"[\\/]+", ".", path).replace("::", ".")
    if name == "typescript":
        dotted = import_stem(path)
        if not path.startswith((".", "@/")):
            return [(x.strip().split(" as ")[-1].strip(" {}*"), "") for x in names.split(",") if x.strip()] or [(dotted.rpartition(".")[2], "")]
        out = []
        for group in re.findall(r"\{([^}]*)\}", names):
            for x in filter(None, (y.strip() for y in group.split(","))):
                a, _, b = x.removeprefix("type ").partition(" as ")
                out.append(((b or a).strip(), f"{dotted}.{a.strip()}"))
        rest = re.sub(r"\{[^}]*\}", "", names).strip(" ,")
        if star := re.match(r"\*\s+as\s+([\w$]+)", rest):
            out.append((star[1], dotted))
        elif rest:
            out.append((rest, f"{dotted}.default"))
        return out or [(dotted.rpartition(".")[2], dotted)]
    last = dotted.rpartition(".")[2]
    return [(names or last, dotted)]


def use_pairs(path: str) -> list[tuple[str, str]]:
    """(local, dotted path) of a Rust ``use`` with nested braces."""
    plain = [(local, [p for p in parts if p not in ("crate", "self", "super")]) for local, parts in use_paths(path)]
    return [(local, ".".join(parts)) for local, parts in plain if parts and parts[-1] != "*"]


def use_paths(path: str) -> list[tuple[str, list[str]]]:
    """(local, parts of the path) of all that a Rust ``use`` brings; a glob's last part is ``*``."""
    path = re.sub(r"\s+", " ", path.strip())
    if "{" not in path:
        whole, _, alias = path.partition(" as ")
        parts = [p.strip() for p in whole.split("::") if p.strip()]
        return [(alias.strip() or parts[-1], parts)] if parts else []
    head, _, rest = path.partition("{")
    inner, level, items, start = rest.rpartition("}")[0], 0, [], 0
    for i, c in enumerate(inner + ","):
        level += (c == "{") - (c == "}")
        if c == "," and level == 0:
            items.append(inner[start:i].strip())
            start = i + 1
    stem = head.rstrip(": ").strip()
    return [pair for x in items if x for pair in use_paths(re.sub(r"^self\b", stem, x) if re.match(r"self(?: as |$)", x) else head + x)]


def scan(name: str, path: str, content: str, module: str) -> tuple[list[tuple], list[tuple]]:
    """(id, label, type, line) and (src, dst, relation, symbol) rows of a file."""
    lang, text = TABLES[name], blank(content, TABLES[name])
    breaks = [m.start() for m in re.finditer("\n", content)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    package = re.search(lang.package, text, re.M) if lang.package else None
    file = path.rpartition("/")[2]
    label = package[1] if name == "go" and package else file if name == "typescript" else file.rpartition(".")[0]
    nodes, edges = [(module, label, "module", 1)], []
    if package and name in ("java", "kotlin", "scala"):
        nodes.append((f"{module}.package_{package[1].replace('.', '_')}", package[1], "package", line(package.start())))
        edges.append((module, nodes[-1][0], "contains", None))
    taken, raw = set(), []
    for d in lang.declarations:
        if d.words and not any(w in text for w in d.words):
            continue
        for m in d.regex.finditer(text):
            raw.append((m.start() + len(m[0]) - len(m[0].lstrip()), m, d))
    spans: list[Span] = []
    known: dict[str, str] = {}
    receivers: dict[str, str] = {}
    for at, m, d in sorted(raw, key=lambda x: x[0]):
        if at in taken:
            continue
        end = _body_end(text, at if lang.spans == "indent" else m.end(), lang) if d.scope else m.end()
        around = [s for s in spans if s.start < at < s.end]
        inside = around[-1] if around else None
        if inside and inside.type in ("function", "method", "constructor", "def", "property") and not d.within and name not in ("ruby", "elixir"):
            continue
        if d.within and (not inside or inside.type not in d.within):
            continue
        taken.add(at)
        own = m.groupdict()
        name_ = own["name"] or "__struct__"
        parent = inside.id if inside else module
        if own.get("owner"):
            parent = f"{module}.{own['owner']}" if f"{module}.{own['owner']}" in known else module
        if d.type == "impl":
            target = f"{parent}.{name_}"
            spans.append(Span(target, name_, "impl", at, end))
            if own.get("trait"):
                edges.append((target, own["trait"].replace("::", "."), "implements", None))
            continue
        id_ = f"{parent}.{name_.replace('.', '_') if name == 'elixir' else name_}"
        type_ = "method" if d.type == "function" and inside and inside.type in ("class", "struct", "enum", "protocol", "extension") and name in ("cpp", "c") else d.type
        span = Span(id_, name_, type_, at, end if d.scope else m.end())
        if own.get("var"):
            receivers[id_] = own["var"]
        head = text[m.start() : text.find("{", m.end()) if 0 <= text.find("{", m.end()) < m.end() + 400 else text.find("\n", m.end()) if text.find("\n", m.end()) > 0 else len(text)]
        for relation, pattern in lang.supers if d.scope and type_ in _TYPES else ():
            where = content[at:end] if pattern.startswith("^") else head[head.find(name_) + len(name_) :]
            for got in re.findall(pattern, where, re.M):
                for x in re.split(r"[,\s]+", re.sub(r"<[^>]*>|\([^)]*\)", "", got)):
                    if x:
                        edges.append((id_, x.replace("\\", ".").replace("::", "."), ("implements" if re.match(r"I[A-Z]", x) else "extends") if relation == ":" else relation, None))
        spans.append(span)
        if id_ not in known:
            known[id_] = type_
            nodes.append((id_, name_, type_, line(at)))
            edges.append((parent, id_, "contains", None))
    bound: dict[str, tuple[str, str]] = {}
    java, rust = crossing.JavaNames(package[1] if package else ""), crossing.RustNames(path)
    for pattern in lang.imports:
        for m in re.finditer(pattern, content, re.M):
            if text[m.start() : m.end()].strip() == "" or (lang.line_comment in content[content.rfind("\n", 0, m.start()) + 1 : m.start() + 1]):
                continue
            relation = m.groupdict().get("relation") or lang.relation
            if name == "java":
                java.add(m["path"], bool(m["static"]))
            for local, parts in use_paths(m["path"]) if name == "rust" else ():
                rust.add(local, parts)
            near = crossing.relative_module(path, m["path"]) if name == "typescript" else None
            stem = import_stem(m["path"]) if near else ""
            for local, symbol in import_pairs(name, m):
                tail = re.sub(r"\W+", "_", m["path"].strip("./")).strip("_").rpartition("_")[2] if name == "typescript" else re.sub(r"\W+", "_", local if name in ("go", "rust") else m["path"])
                id_ = f"{module}.import_{tail}"
                bound[local] = (id_, near + symbol[len(stem) :] if near and symbol else symbol)
                if id_ not in known:
                    known[id_] = "import"
                    nodes.append((id_, symbol or m["path"], "import", line(m.start())))
                    edges.append((module, id_, relation, None))
    if lang.calls:
        edges += _calls(lang, name, text, module, spans, known, bound, receivers, java, rust)
    return nodes, edges


def _calls(lang: Language, name: str, text: str, module: str, spans: list[Span], known: dict[str, str], bound: dict[str, tuple[str, str]], receivers: dict[str, str], java: crossing.JavaNames, rust: crossing.RustNames) -> list[tuple]:
    bodies = [s for s in spans if s.type in ("function", "method", "constructor")]
    fields = crossing.variable_types(name, text)
    types: dict[str, dict[str, str]] = {}
    out: dict[tuple, None] = {}
    for m in _CALL.finditer(text):
        around = [s for s in bodies if s.start < m.start() < s.end]
        if not around or _DEFINES.search(text[max(0, m.start() - 20) : m.start()]):
            continue
        caller = min(around, key=lambda s: s.end - s.start)
        if m.start("name") < caller.start + 200 and re.search(rf"\b{re.escape(m['name'])}\s*\($", text[caller.start : m.end()]) and text.find("{", caller.start) > m.start():
            continue  # its own head
        owner = caller.id.rpartition(".")[0]
        on, called, symbol = m["on"], m["name"], None
        if on and on not in lang.own and on not in bound and receivers.get(caller.id) != on:
            if caller.id not in types:
                types[caller.id] = fields | crossing.variable_types(name, text[caller.start : caller.end])
            on = types[caller.id].get(on, on)
        within = on.replace("::", ".") if on else None
        if on is None:
            options = [f"{owner}.{called}"] if name in ("java", "rust") else []
            to = next((c for c in [*options, f"{module}.{called}"] if known.get(c) in CALLABLE), None)
            if to is None and called in bound:
                to, symbol = bound[called]
        elif on in lang.own or receivers.get(caller.id) == on:
            to = f"{owner}.{called}" if known.get(f"{owner}.{called}") in CALLABLE else None
        elif known.get(f"{module}.{within}.{called}") in CALLABLE:
            to = f"{module}.{within}.{called}"
        elif on in bound:
            to, symbol = bound[on][0], f"{bound[on][1]}.{called}" if bound[on][1] else ""
        else:
            to = None
        if name in ("java", "rust") and (to is None or symbol is not None) and on not in lang.own:
            new = re.search(r"\bnew\s+$", text[max(0, m.start() - 12) : m.start()]) is not None
            if name == "rust":
                choices = rust.choices([*(on.split("::") if on else []), called], _inner_modules(caller.id, module, known))
            else:
                choices = java.of_class(on, called) if on else java.bare(called, new)
            symbol = crossing.written(choices)
            to = module if symbol else None
        if to and to != caller.id and symbol != "":
            out[(caller.id, to, "calls", symbol)] = None
    return list(out)


def _inner_modules(id_: str, module: str, known: dict[str, str]) -> list[str]:
    """The inline modules of a file that ``id_`` stands in, from the outermost."""
    out, at = [], module
    for part in id_[len(module) + 1 :].split("."):
        at = f"{at}.{part}"
        if known.get(at) != "module":
            break
        out.append(part)
    return out


def parse(path: str, content: str, module: str) -> tuple[list[tuple], list[tuple]]:
    name = language(path)
    if name is None:
        return [], []
    return python_parser.parse(path, content, module) if name == "python" else scan(name, path, content, module)


def exported(path: str, module: str, nodes: list[tuple]) -> list[tuple[str, str]]:
    """(id, name) of a file's symbols, as other files of its language name them."""
    return crossing.exports(language(path) or "", path, module, nodes)
