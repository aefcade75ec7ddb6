"""The operators behind a JSON-RPC 2.0 interface: one request, one response, tool failures as results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import analytics, rank
from weftgraph.operators import select as selection
from weftgraph.plans import render, reports
from weftgraph.plans.graph import PropertyGraph
from weftgraph.plans.materialize import cut

#: Error codes of the protocol.
INVALID_REQUEST, NO_METHOD, BAD_PARAMS, INTERNAL, UNPARSABLE = -32600, -32601, -32602, -32603, -32700
PROTOCOL = "2024-11-05"
MIN_SCORE, DECAY = 0.15, 0.7
#: Queries whose scores are kept.
SCORED = 8


class BadParams(ValueError):
    """Arguments that a tool can't take."""


def _text(args: dict, key: str, default: str | None = None) -> str:
    v = args.get(key, default)
    if not isinstance(v, str) or not v.strip():
        raise BadParams(f"{key} must be a text that isn't blank")
    return v


def _whole(args: dict, key: str, default: int, least: int = 1) -> int:
    v = args.get(key, default)
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    if not isinstance(v, int) or isinstance(v, bool) or v < least:
        raise BadParams(f"{key} must be a whole number of {least} at least")
    return v


class Service:
    """Answers for one graph; ``load`` gives it anew when ``version`` changes, the old one stays if that fails."""

    def __init__(self, load: Callable[[], PropertyGraph], version: Callable[[], object] = lambda: None):
        self.load, self.version = load, version
        self.graph, self.at = load(), version()
        self.scores: dict[str, DataFrame] = {}
        self.ranks: DataFrame | None = None
        #: Told of each query that is served; a log, for one.
        self.on_query: Callable[[str, int, dict], object] = lambda query, budget, stats: None
        self.tools = {"query": self.query, "explain": self.explain, "diff": self.diff, "suggest": self.suggest, "impact": self.impact}

    def refresh(self) -> None:
        if (now := self.version()) != self.at:
            try:
                self.graph = self.load()
            except Exception:  # the old graph goes on serving, whatever broke the new one
                return
            for old in self.scores.values():
                old.unpersist()
            self.at, self.scores, self.ranks = now, {}, None

    def scored(self, query: str) -> DataFrame:
        """Scores of a query; those of the latest ``SCORED`` queries are kept, of the ranks one copy."""
        if self.ranks is None:
            self.ranks = cut(rank.pagerank(self.graph))
        if query not in self.scores:
            while len(self.scores) >= SCORED:
                self.scores.pop(next(iter(self.scores))).unpersist()
            self.scores[query] = rank.combine(self.graph, self.ranks, rank.tfidf(self.graph.nodes, query)).persist()
        return self.scores[query]

    def selected(self, query: str, budget: int, min_score: float = MIN_SCORE, decay: float = DECAY) -> tuple[PropertyGraph, dict, DataFrame]:
        spark = self.graph.nodes.sparkSession
        scores = self.scored(query)
        budgets = spark.createDataFrame([(query, budget)], "query string, budget int")
        chosen = cut(selection.select(self.graph, scores.withColumn("query", F.lit(query)), budgets, decay, min_score))
        rows = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).alias("t")).first()
        total = self.graph.nodes.count()
        stats = {"nodes_selected": rows["n"], "nodes_total": total, "tokens_used": int(rows["t"]), "tokens_budget": budget, "coverage_pct": round(100 * rows["n"] / total, 1) if total else 0.0}
        return self.graph.induced(chosen.select("id")).written(), stats, scores

    def query(self, args: dict) -> str:
        query, budget = _text(args, "query"), _whole(args, "budget", 4000)
        sub, stats, scores = self.selected(query, budget)
        self.on_query(query, budget, stats)
        return render.subgraph(sub, stats, args.get("format", "markdown"), scores, query)

    def explain(self, args: dict) -> str:
        found = analytics.explain(self.graph, _text(args, "node"), hops=_whole(args, "hops", 1))
        if found is None:
            raise LookupError(f"no node like {args['node']!r}")
        return json.dumps(found, indent=2, default=str)

    def impact(self, args: dict) -> str:
        return reports.impact(self.graph, _text(args, "file"), _whole(args, "hops", 2))

    def suggest(self, args: dict) -> str:
        query = _text(args, "query")
        sub, _, scores = self.selected(query, _whole(args, "budget", 4000))
        return json.dumps(analytics.suggest(self.graph, query, scores, sub.nodes.select("id"), _whole(args, "count", 3)), indent=2, default=str)

    def diff(self, args: dict) -> str:
        from weftgraph.sources.graphs import load

        spark = self.graph.nodes.sparkSession
        old, new = load(spark, _text(args, "old")), load(spark, _text(args, "new"))
        return reports.diff(old, new)

    def answer(self, line: str) -> dict | None:
        """The response to one request line; null for a notification."""
        try:
            request = json.loads(line)
        except ValueError:
            return self._error(None, UNPARSABLE, "not JSON")
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            return self._error(request.get("id") if isinstance(request, dict) else None, INVALID_REQUEST, "not a request")
        if "id" not in request:
            return None
        method, params = request["method"], request.get("params") or {}
        plain = {"initialize": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "weftgraph", "version": "1"}}, "ping": {}, "tools/list": {"tools": [{"name": n} for n in self.tools]}, "resources/list": {"resources": []}, "resources/templates/list": {"resourceTemplates": []}, "prompts/list": {"prompts": []}}
        if method in plain:
            return {"jsonrpc": "2.0", "id": request["id"], "result": plain[method]}
        if method != "tools/call":
            return self._error(request["id"], NO_METHOD, f"no method {method}")
        if not isinstance(params, dict) or params.get("name") not in self.tools or not isinstance(params.get("arguments", {}), dict):
            return self._error(request["id"], BAD_PARAMS, "no such tool, or arguments that are no object")
        self.refresh()
        try:
            result = {"content": [{"type": "text", "text": self.tools[params["name"]](params.get("arguments", {}))}], "isError": False}
        except BadParams as e:
            return self._error(request["id"], BAD_PARAMS, str(e))
        except Exception as e:  # a tool that fails answers so; the service goes on
            result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
        return {"jsonrpc": "2.0", "id": request["id"], "result": result}

    @staticmethod
    def _error(id_: object, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}

    def serve(self, lines: Iterable[str], write: Callable[[str], object]) -> None:
        for line in lines:
            if line.strip() and (out := self.answer(line)) is not None:
                write(json.dumps(out) + "\n")


def of_path(spark: SparkSession, path: str) -> Service:
    """A service for a graph file, read anew when its modification time changes."""
    from weftgraph.sources.graphs import load

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return Service(lambda: load(spark, path), lambda: where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime())
