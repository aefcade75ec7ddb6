"""Reports and context blocks of small results: bounded frames are collected and written as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.graph import PropertyGraph

NODES_HEAD = "## Nodes"
FORMATS = ("markdown", "json", "yaml")
TARGETS = ("claude", "chatgpt", "claudemd")
#: Words that YAML would read as something else than text.
_YAML_WORDS = {"true", "false", "null", "yes", "no", "on", "off", "~", ""}


#: Most nodes and edges of a selection that is written as text.
MOST_NODES, MOST_EDGES = 20_000, 100_000


class TooLarge(ValueError):
    """A selection that is no report any more."""


def collected(g: PropertyGraph, scores: DataFrame | None = None) -> dict:
    """Nodes by falling score, then id, and edges of a selection, as plain values; an error if they are too many."""
    for part, most in ((g.nodes, MOST_NODES), (g.edges, MOST_EDGES)):
        if len(part.limit(most + 1).select(F.lit(1)).collect()) > most:
            raise TooLarge(f"more than {most} rows: choose a smaller budget, or write the graph to files")
    nodes = g.nodes if scores is None else g.nodes.join(scores.select("id", "score"), "id", "left")
    order = [F.col("id")] if scores is None else [F.desc_nulls_last("score"), F.col("id")]
    rows = [r.asDict() for r in nodes.orderBy(*order).collect()]
    out = []
    for r in rows:
        one = {"id": r["id"]} | {k: r[k] for k in ("label", "type", "description", "importance") if r.get(k) is not None}
        if file := r.get("source_file") or r.get("file_path"):
            one["file_path"] = file
        if r.get("score") is not None:
            one["score"] = round(r["score"], 4)
        if r.get("code_block"):
            one["code_block"] = r["code_block"]
        out.append(one)
    edges = [{"source": e["src"], "target": e["dst"]} | ({"relation": e["relation"]} if e["relation"] else {}) | ({"weight": e["weight"]} if e["weight"] is not None else {}) for e in g.edges.orderBy("src", "dst").collect()]
    return {"nodes": out, "edges": edges}


def box(*lines: str) -> str:
    width = max(map(len, lines)) + 2
    return "\n".join(["╭" + "─" * width + "╮", *(f"│ {x.ljust(width - 1)}│" for x in lines), "╰" + "─" * width + "╯"])


def yaml_scalar(v: object) -> str:
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, (int, float)):
        return str(v)
    text = str(v)
    plain = text.lower() not in _YAML_WORDS and text == text.strip() and not any(c in text for c in ":#\n\"'{}[],&*!|>%@`\\") and text[0] not in "-?"
    try:
        float(text)
        plain = False
    except ValueError:
        pass
    return text if plain else json.dumps(text, ensure_ascii=False)


def _yaml(data: dict) -> str:
    lines = ["stats:", *(f"  {k}: {yaml_scalar(v)}" for k, v in data["stats"].items())]
    for part in ("nodes", "edges"):
        lines.append(f"{part}:")
        for row in data[part]:
            lines += [f"{'    ' if i else '  - '}{k}: {yaml_scalar(v)}" for i, (k, v) in enumerate(row.items())]
        if part == "edges" and not data[part]:
            lines.append("  []")
    return "\n".join(lines)


def _markdown(data: dict, query: str, language) -> str:
    s = data["stats"]
    asked = f'Chosen for "{query}"' if query else "Chosen nodes"
    counts = f"{s['nodes_selected']} of {s['nodes_total']} nodes ({s['coverage_pct']}%), {s['tokens_used']:,} of {s['tokens_budget']:,} tokens"
    lines = [box(asked, counts), "", NODES_HEAD, ""]
    for n in data["nodes"]:
        kind = f" ({n['type']})" if n.get("type") else ""
        score = f", score {n['score']:.2f}" if "score" in n else ""
        lines.append(f"### {n.get('label', n['id'])}{kind}{score}")
        if n.get("description"):
            lines.append(n["description"])
        if n.get("file_path"):
            lines.append(f"In {n['file_path']}")
        if n.get("code_block"):
            lines += [f"```{language(n.get('file_path', '')) or ''}", n["code_block"], "```"]
        lines.append("")
    if data["edges"]:
        lines += ["## Links", *(f"- {e['source']} {e.get('relation', '→')} {e['target']}" for e in data["edges"]), ""]
    if (more := s["nodes_total"] - s["nodes_selected"]) > 0:
        lines += ["---", f"{more} nodes are not shown; a larger budget takes more of them in."]
    return "\n".join(lines)


def subgraph(g: PropertyGraph, stats: dict, how: str = "markdown", scores: DataFrame | None = None, query: str = "") -> str:
    """A selection as markdown, JSON or YAML."""
    from weftgraph.sources.code import language

    if how not in FORMATS:
        raise ValueError(f"unknown format {how!r}; one of {', '.join(FORMATS)}")
    data = {"stats": stats} | collected(g, scores)
    if how == "markdown":
        return _markdown(data, query, language)
    for n in data["nodes"]:
        n.pop("code_block", None)
    return json.dumps(data, indent=2, ensure_ascii=False) if how == "json" else _yaml(data)


def context(g: PropertyGraph, stats: dict, query: str, target: str = "claude", scores: DataFrame | None = None) -> str:
    """A selection as a context block for one of ``TARGETS``."""
    if target not in TARGETS:
        raise ValueError(f"unknown target {target!r}; one of {', '.join(TARGETS)}")
    body = subgraph(g, stats, "markdown", scores, query)
    nodes, tokens = f"{stats['nodes_selected']}/{stats['nodes_total']}", f"{stats['tokens_used']}/{stats['tokens_budget']}"
    if target == "claude":
        return f'<context query={json.dumps(query)} nodes="{nodes}" tokens="{tokens}" coverage="{stats["coverage_pct"]}%">\n\n{body}\n\n</context>'
    bare = body[body.index(NODES_HEAD) :]
    about = f"query {json.dumps(query)}, nodes {nodes}, tokens {tokens}, coverage {stats['coverage_pct']}%"
    if target == "chatgpt":
        return f"[CONTEXT]\n{about}\n\n{bare}\n\n[END OF CONTEXT]"
    return f"## Context of the code base\n\n<!-- {about} -->\n\n{bare}"


def table(df: DataFrame, limit: int = 50, order: list | None = None) -> str:
    """A report as a markdown table: the first ``limit`` rows by ``order`` (else by all columns), and how many more there are."""
    rows = df.orderBy(*(order or df.columns)).limit(limit + 1).collect()
    cells = [list(df.columns), *[["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in rows[:limit]]]
    head, *rest = ["| " + " | ".join(c) + " |" for c in cells]
    more = [f"\n{df.count() - limit} more rows are not shown."] if len(rows) > limit else []
    return "\n".join([head, "|" + "---|" * len(df.columns), *rest, *more])
