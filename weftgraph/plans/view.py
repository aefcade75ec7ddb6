"""A graph as one self-contained HTML page: a force layout on a canvas, no outside resources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import relational, traverse
from weftgraph.plans.graph import PropertyGraph, inside

#: Most nodes of a page; what lies beyond is counted in its title.
MOST_NODES = 50
PALETTE = {"function": "#4f8fba", "class": "#c0784a", "module": "#6d9b54", "method": "#8a6fb0", "default": "#7d8791", "added": "#3f9d5a", "removed": "#c4483c", "modified": "#c99a2e", "owned": "#c4483c", "direct": "#c99a2e", "transitive": "#4f8fba", "safe": "#3f9d5a"}
#: Scores of the rings of an impact view.
RINGS = {"owned": 1.0, "direct": 0.6, "transitive": 0.3, "safe": 1.0}


def shown_nodes(scores: DataFrame, n: int = MOST_NODES) -> DataFrame:
    """(id, score): the nodes a view shows, best first, equals by id."""
    return scores.select("id", "score").orderBy(F.desc("score"), "id").limit(n)


def _styled(nodes: DataFrame, scores: DataFrame, kind: str | None) -> DataFrame:
    """(id, label, kind, size, score, about) of shown nodes."""
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in nodes.columns else F.lit("")
    rows = nodes.drop("score").join(F.broadcast(scores), "id")
    bounds = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    guess = F.col(kind) if kind else X.viz_type(col("type"), col("file_type"), col("label"), tuple(PALETTE))
    about = F.concat_ws("\n", F.nullif(col("description"), F.lit("")), F.nullif(col("source_file"), F.lit("")))
    return rows.join(F.broadcast(bounds)).select("id", F.coalesce(F.nullif(col("label"), F.lit("")), F.col("id")).alias("label"), guess.alias("kind"), X.viz_size(F.col("score"), F.col("lo"), F.col("hi")).alias("size"), "score", about.alias("about"))


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>@TITLE@</title><style>
body{margin:0;font:14px sans-serif;background:#14181d;color:#e6e9ec}header{padding:10px 16px;border-bottom:1px solid #2b323a}
#legend span{margin-right:14px}#legend i{display:inline-block;width:10px;height:10px;border-radius:5px;margin-right:5px}
#about{position:fixed;right:12px;bottom:12px;max-width:340px;white-space:pre-wrap;background:#1f252cdd;padding:8px 12px;border-radius:6px;display:none}canvas{display:block}
</style></head><body><header><b>@TITLE@</b> <span id="count"></span><div id="legend"></div></header><canvas id="c"></canvas><div id="about"></div>
<script type="application/json" id="data">@DATA@</script>
<script>
const data=JSON.parse(document.getElementById('data').textContent),nodes=data.nodes,by=new Map(nodes.map(n=>[n.id,n])),c=document.getElementById('c'),x=c.getContext('2d'),about=document.getElementById('about');
const links=data.edges.map(e=>({a:by.get(e.src),b:by.get(e.dst),t:e.relation})).filter(l=>l.a&&l.b);
function fit(){c.width=innerWidth;c.height=innerHeight-document.querySelector('header').offsetHeight}fit();addEventListener('resize',fit);
nodes.forEach((n,i)=>{const t=i*2.39996,r=24*Math.sqrt(i);n.x=c.width/2+r*Math.cos(t);n.y=c.height/2+r*Math.sin(t);n.u=n.v=0});
document.getElementById('count').textContent=nodes.length+' nodes, '+links.length+' links'+(data.left?', '+data.left+' nodes not shown':'');
for(const k of new Set(nodes.map(n=>n.kind))){const s=document.createElement('span'),i=document.createElement('i');i.style.background=data.palette[k]||data.palette.default;s.append(i,k);document.getElementById('legend').append(s)}
let heat=1;
function step(){for(const p of nodes)for(const q of nodes)if(p!==q){const dx=p.x-q.x,dy=p.y-q.y,d=dx*dx+dy*dy+40;p.u+=900*dx/d/8;p.v+=900*dy/d/8}
for(const l of links){const dx=l.b.x-l.a.x,dy=l.b.y-l.a.y;l.a.u+=dx*.01;l.a.v+=dy*.01;l.b.u-=dx*.01;l.b.v-=dy*.01}
for(const p of nodes){p.u+=(c.width/2-p.x)*.004;p.v+=(c.height/2-p.y)*.004;if(p!==held){p.x+=p.u*heat*.2;p.y+=p.v*heat*.2}p.u*=.6;p.v*=.6}heat=Math.max(.02,heat*.992)}
function draw(){x.clearRect(0,0,c.width,c.height);x.strokeStyle='#46505a';for(const l of links){x.beginPath();x.moveTo(l.a.x,l.a.y);x.lineTo(l.b.x,l.b.y);x.stroke()}
for(const n of nodes){x.fillStyle=data.palette[n.kind]||data.palette.default;x.beginPath();x.arc(n.x,n.y,n.size/2,0,7);x.fill();x.fillStyle='#e6e9ec';x.fillText(n.label.slice(0,40),n.x+n.size/2+3,n.y+4)}}
let held=null;const at=e=>nodes.find(n=>Math.hypot(n.x-e.offsetX,n.y-e.offsetY)<n.size/2+2);
c.onmousedown=e=>{held=at(e)};onmouseup=()=>{held=null};c.onmousemove=e=>{if(held){held.x=e.offsetX;held.y=e.offsetY;heat=.5}const n=at(e);about.style.display=n?'block':'none';if(n)about.textContent=n.id+'\\n'+n.kind+' \\u00b7 '+n.score.toFixed(2)+'\\n'+n.about};
(function loop(){step();draw();requestAnimationFrame(loop)})();
</script></body></html>
"""


def page(g: PropertyGraph, scores: DataFrame, title: str, kind: str | None = None, most: int = MOST_NODES) -> str:
    """The best ``most`` nodes by ``scores`` (id, score) and the edges between them; ``kind`` names a column of their colour."""
    shown = shown_nodes(scores, most).collect()
    spark = g.nodes.sparkSession
    top = spark.createDataFrame([(r["id"], float(r["score"])) for r in shown], "id string, score double")
    nodes = [r.asDict() for r in _styled(g.nodes, top, kind).orderBy(F.desc("score"), "id").collect()]
    edges = [r.asDict() for r in inside(g.edges, top.select("id")).select("src", "dst", "relation").distinct().orderBy("src", "dst", "relation").collect()]
    data = {"nodes": nodes, "edges": edges, "palette": PALETTE, "left": max(0, scores.count() - len(shown))}
    # Neither a tag nor a line that JavaScript ends may stand in the data.
    packed = json.dumps(data, ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return _PAGE.replace("@TITLE@", safe).replace("@DATA@", packed)


def diff_page(old: PropertyGraph, new: PropertyGraph, hops: int = 2) -> str:
    """What changed between two graphs, and what lies within ``hops`` of it."""
    nodes, edges = relational.diff_view(old, new)
    whole = PropertyGraph(nodes, edges).written()
    changed = whole.nodes.where("status <> 'unchanged'").select("id")
    part = whole.induced(traverse.around(whole, changed, hops).select("id")).written()
    return page(part, part.nodes.select("id", "score"), "Changes between two graphs", "status")


def impact_scores(found: DataFrame) -> DataFrame:
    """(id, kind, score) of an impact's rings; of several the strongest."""
    ring = F.element_at(F.create_map(*[F.lit(v) for kv in RINGS.items() for v in kv]), F.col("kind"))
    order = F.when(F.col("kind") == "owned", 0).when(F.col("kind") == "direct", 1).when(F.col("kind") == "transitive", 2).otherwise(3)
    return found.groupBy("id").agg(F.min_by("kind", order).alias("kind")).withColumn("score", ring)


def impact_page(g: PropertyGraph, found: DataFrame, path: str) -> str:
    """A file's nodes and their dependents, in rings."""
    rings = impact_scores(found)
    part = g.induced(rings)
    marked = PropertyGraph(part.nodes.join(rings.select("id", F.col("kind").alias("ring")), "id"), part.edges)
    return page(marked, rings, f"Impact of {path}", "ring")
