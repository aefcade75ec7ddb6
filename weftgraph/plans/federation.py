"""Several graph files as one: their labels, and the merged graph."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import SparkSession

from weftgraph.operators.relational import federate
from weftgraph.plans.graph import PropertyGraph
from weftgraph.sources.graphs import load



def names_nothing(folder: str) -> bool:
    """Whether a folder's name says nothing of a project: an indexer's output, or a relative step."""
    return folder in (".", "..") or folder.endswith("-out")


def labels_of(paths: list[str]) -> list[str]:
    """One label per path, all different: the file's stem, or where stems are alike the nearest folder that is still free."""
    parts = [[p for p in path.replace("\\", "/").split("/") if p and not p.endswith(":")] for path in paths]
    stems = [(p[-1].rpartition(".")[0] or p[-1]) if p else "" for p in parts]
    often = Counter(stems)
    out: list[str] = []
    for n, (stem, path) in enumerate(zip(stems, parts), 1):
        names = ([stem] if often[stem] == 1 else []) + [f for f in reversed(path[:-1]) if often[stem] == 1 or f != stem]
        free = [x for x in names if x and not names_nothing(x) and x not in out]
        while not free:
            free, n = [x for x in (f"graph{n}",) if x not in out], n + 1
        out.append(free[0])
    return out


def checked_labels(count: int, labels: list[str] | None) -> list[str]:
    """Labels given for ``count`` graphs, or numbered ones; a wrong number or a repeated label is an error."""
    if labels is None:
        return [f"graph{n + 1}" for n in range(count)]
    if len(labels) != count:
        raise ValueError(f"{count} graphs need {count} labels, {len(labels)} are given")
    if twice := sorted(x for x, n in Counter(labels).items() if n > 1):
        raise ValueError(f"labels prefix the ids, so they must differ: {', '.join(twice)}")
    return list(labels)


def merge(graphs: list[PropertyGraph], labels: list[str] | None = None) -> PropertyGraph:
    return federate(dict(zip(checked_labels(len(graphs), labels), graphs)))


def load_merged(spark: SparkSession, paths: list[str], labels: list[str] | None = None) -> PropertyGraph:
    """One graph of files; a single one stays as it is."""
    return merge([load(spark, p) for p in paths], labels or labels_of(paths))
