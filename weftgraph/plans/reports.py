"""Text reports of small results: differences, impact, explanations, suggestions, advice, parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import analytics, relational, traverse
from weftgraph.plans import render
from weftgraph.plans.graph import PropertyGraph
from weftgraph.plans.materialize import cut

MOST_FOLLOW_UPS = 3


def _counted(n: int, what: str) -> str:
    return f"{n:,} {what}" + ("" if n == 1 else "s")


def diff(old: PropertyGraph, new: PropertyGraph, most: int = 50) -> str:
    """What changed between two graphs, what to review first, and what lies next to it."""
    old, new = old.written(), new.written()
    marks = cut(relational.diff_nodes(old, new).where("status <> 'unchanged'"))
    counts = {r["status"]: r["count"] for r in marks.groupBy("status").count().collect()}
    score = relational.diff_impact(old, new).first()
    lines = [render.box("Changes between two graphs", ", ".join(f"{counts.get(k, 0)} {k}" for k in ("added", "removed", "modified")), f"severity {score['severity']} ({score['impact_score']:.3f})")]
    if counts:
        order = [F.when(F.col("status") == "removed", 0).when(F.col("status") == "modified", 1).otherwise(2), F.col("id")]
        lines += ["", render.table(marks.select("status", "id"), most, order)]
    edges = relational.diff_edges(old, new)
    if not edges.isEmpty():
        lines += ["", "## Links", render.table(edges.select("status", "src", "dst"), most, ["status", "src", "dst"])]
    first = relational.review_shortlist(old, new).select("id", F.round("centrality", 4).alias("centrality"))
    if not first.isEmpty():
        lines += ["", "## To be reviewed first", render.table(first, order=[F.desc("centrality"), F.col("id")])]
    near = relational.at_risk(old, new).select("id", F.round("centrality", 4).alias("centrality"))
    if not near.isEmpty():
        lines += ["", "## Unchanged, but next to a change", render.table(near, 10, [F.desc("centrality"), F.col("id")])]
    return "\n".join(lines)


def impact_record(g: PropertyGraph, path: str, hops: int = 2) -> dict:
    """What a change of a file reaches, as plain values."""
    owned = cut(traverse.nodes_in_file(g, path))
    found = cut(traverse.impact(g, owned, hops))
    out = traverse.impact_summary(g, found).first().asDict() | {"file": path, "hops": hops}
    worst = traverse.highest_risk(g, owned).first()
    out["highest_risk"] = worst.asDict() if worst else None
    out["files"] = [r.asDict() for r in traverse.impact_files(g, found, path).collect()]
    return out


def impact(g: PropertyGraph, path: str, hops: int = 2) -> str:
    r = impact_record(g, path, hops)
    lines = [render.box(f"Impact of {path}", f"risk {r['risk']}, {r['impact_score']:.1%} of the graph within {_counted(r['hops'], 'hop')}")]
    lines += ["", f"{_counted(r['owned'], 'node')} in the file, {r['direct']} direct and {r['transitive']} further dependents, {r['safe']} that nothing calls."]
    if r["highest_risk"] and r["highest_risk"]["dependents"]:
        lines.append(f"Depended on most: {r['highest_risk']['id']} ({_counted(r['highest_risk']['dependents'], 'dependent')}).")
    lines.append(f"Advice: {r['advice']}.")
    if r["files"]:
        lines += ["", "## Files it reaches", *(f"- {x['source_file']} ({x['dependents']})" for x in r["files"])]
    return "\n".join(lines)


def relation(g: PropertyGraph, a: str, b: str) -> str:
    """The label of the link between two nodes, in either direction; ``related`` where there is none."""
    way = F.when((F.col("src") == a) & (F.col("dst") == b), 0).when((F.col("src") == b) & (F.col("dst") == a), 1)
    hit = g.edges.withColumn("way", way).where("way is not null and relation <> ''").orderBy("way", "relation").select("relation").first()
    return hit["relation"] if hit else "related"


def follow_ups(about: dict) -> list[str]:
    """Up to three commands that look further from a node."""
    names = [about["id"].rpartition(".")[2], *[x.rpartition(".")[2] for x in (about["callers_list"] or [])[:1]]]
    out = [f"explain {n}" for n in names[1:]]
    if about.get("source_file"):
        out.append(f"impact {about['source_file']}")
    out.append(f'run "{names[0]}"')
    return out[:MOST_FOLLOW_UPS]


def explain(g: PropertyGraph, name: str, scores: DataFrame | None = None, hops: int = 2) -> str | None:
    """Everything about one node; null if nothing matches."""
    r = analytics.explain(g, name, scores, hops)
    if r is None:
        return None
    where = g.nodes.where(F.col("id") == r["id"]).first().asDict()
    r["source_file"] = where.get("source_file")
    lines = [render.box(str(r["label"] or r["id"]), f"{r['role']}, risk {r['risk']}")]
    lines += ["", *(x for x in (where.get("description"), f"In {r['source_file']}" if r["source_file"] else None) if x)]
    lines.append(f"{r['production']} callers, {r['tests']} tests, {r['callees']} callees; {r['dependents_share']}% of the graph depends on it.")
    for title, key in (("Callers", "callers_list"), ("Callees", "callees_list")):
        if r[key]:
            lines += ["", f"## {title}", *(f"- {x}" for x in r[key])]
    if r["neighbourhood"]:
        lines += ["", "## Around it", *(f"- {i} ({_counted(d, 'hop')})" for i, d in r["neighbourhood"])]
    lines += ["", f"Advice: {r['advice']}.", "", "## Further", *(f"- {x}" for x in follow_ups(r))]
    return "\n".join(lines)


def suggestions(found: list[dict]) -> str:
    if not found:
        return "Nothing is left to be asked around this selection."
    return "\n".join(f"{n}. {s['query']}: {s['reason']} ({s['relevance_score']:.3f}), such as {', '.join(s['expected_nodes'][:3])}" for n, s in enumerate(found, 1))


def advice(row: dict, query: str) -> str:
    """A budget that similar queries of the log speak for."""
    lines = [render.box(f'Budget for "{query}"', f"{row['budget']:,} tokens, confidence {row['confidence']}")]
    if row["similar"]:
        lines += ["", f"{_counted(row['similar'], 'similar query')[:-1] + 'ies' if row['similar'] != 1 else '1 similar query'}; expected coverage {row['expected_coverage']}%, savings {row['expected_savings']}%."]
    else:
        lines += ["", "The log holds no similar query yet; this is the default."]
    lines.append(f"It costs about {row['cost_usd']:.6f} USD of input.")
    return "\n".join(lines)


def parsers(summary: DataFrame) -> str:
    """Languages with their numbers of files: up to four in one line, else three a line."""
    every = [f"{r['language']} ({r['files']})" for r in summary.orderBy(F.desc("files"), "language").collect()]
    if len(every) <= 4:
        return "Parsers: " + (", ".join(every) or "none")
    return "Parsers:\n" + "\n".join("  " + ", ".join(every[at : at + 3]) for at in range(0, len(every), 3))
