"""Graph exports: DOT text, images by an external layout program, and a self-contained HTML page.

Lines and attributes are made in Spark; what is drawn is a bounded subgraph.
"""

from __future__ import annotations

import html
import json
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fill, border and font of node types on pages.
PAGE_COLOURS = {
    "PERSON": ("#1d4ed8", "#60a5fa", "#ffffff"), "ORGANIZATION": ("#b91c1c", "#f87171", "#ffffff"), "TECHNOLOGY": ("#047857", "#34d399", "#ffffff"), "CONCEPT": ("#6d28d9", "#a78bfa", "#ffffff"),
    "LOCATION": ("#c2410c", "#fb923c", "#ffffff"), "EVENT": ("#b45309", "#fbbf24", "#ffffff"), "PRODUCT": ("#0f766e", "#2dd4bf", "#ffffff"), "DOCUMENT": ("#374151", "#9ca3af", "#ffffff"),
}
# Fill, border and font of node types in images.
IMAGE_COLOURS = {
    "PERSON": ("#1e3a8a", "#60a5fa", "#ffffff"), "ORGANIZATION": ("#881337", "#fb7185", "#ffffff"), "TECHNOLOGY": ("#064e3b", "#34d399", "#ffffff"), "CONCEPT": ("#4c1d95", "#a78bfa", "#ffffff"),
    "LOCATION": ("#7c2d12", "#fb923c", "#ffffff"), "EVENT": ("#713f12", "#fde047", "#ffffff"), "PRODUCT": ("#134e4a", "#2dd4bf", "#ffffff"), "DOCUMENT": ("#1e293b", "#94a3b8", "#ffffff"),
}
# Those of all other types, on either.
OTHER_COLOURS = ("#334155", "#64748b", "#ffffff")
#: Nodes or edges that a drawing takes at most; more is an error, since they come to the driver.
MOST_DRAWN = 20_000


def colours(kind: Column, table: dict[str, tuple[str, str, str]] = IMAGE_COLOURS) -> Column:
    """[fill, border, font] of a node type."""
    listed = lambda three: F.array(*[F.lit(x) for x in three])
    pairs = [x for k, v in table.items() for x in (F.lit(k), listed(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(kind)), listed(OTHER_COLOURS))


def colours_sql(kind: str, i: int, table: dict[str, tuple[str, str, str]] = IMAGE_COLOURS) -> str:
    return f"CASE upper({kind}) " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in table.items()) + f" ELSE '{OTHER_COLOURS[i]}' END"


def _drawn(df: DataFrame) -> list:
    rows = df.limit(MOST_DRAWN + 1).collect()
    if len(rows) > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} rows to draw: take a smaller subgraph")
    return rows


def _quoted(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): node lines, then edge lines whose two ends are known. Node names are hashes of ids."""
    name = lambda c: F.concat(F.lit("n"), F.substring(F.md5(c), 1, 16))
    of = colours(F.col("type"))
    n = nodes.select(F.lit(0).alias("part"), F.format_string('  %s [label="%s" fillcolor="%s" color="%s" fontcolor="%s"];', name(F.col("id")), _quoted(F.coalesce("label", "id")), of[0], of[1], of[2]).alias("line"))
    ids = nodes.select("id")
    e = edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    title = F.lower(F.replace("label", F.lit("_"), F.lit(" ")))
    return n.unionByName(e.select(F.lit(1).alias("part"), F.format_string('  %s -> %s [label="%s"];', name(F.col("from")), name(F.col("to")), _quoted(title)).alias("line")))


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    lines = [r["line"] for r in sorted(_drawn(dot_lines(nodes, edges)), key=lambda r: (r["part"], r["line"]))]
    return "\n".join(["digraph G {", "  graph [overlap=false, splines=true];", '  node [shape=circle, style=filled, fontname="sans"];', *lines, "}"])


def render(dot: str, path: str, *, dpi: int = 300) -> bool:
    """Draw with the first layout program found; False where there is none."""
    for program in ("sfdp", "fdp"):
        if shutil.which(program):
            done = subprocess.run([program, f"-T{Path(path).suffix[1:]}", f"-Gdpi={dpi}", "-o", path], input=dot, text=True, check=False)
            if done.returncode == 0:
                return True
    return False


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>
body{{margin:0;font-family:sans-serif}}#bar{{position:fixed;top:8px;left:8px;right:8px}}#bar label{{margin:0 6px;padding:2px 6px;border-radius:8px;font-size:12px}}
#about{{position:fixed;right:8px;top:48px;width:260px;font-size:12px;white-space:pre-wrap}}circle{{stroke-width:2;cursor:pointer}}line{{stroke:#aaa}}text{{font-size:10px}}.off{{opacity:.08}}.gone{{display:none}}
</style></head><body><div id="bar"><input id="q" placeholder="search"><span id="legend"></span><span id="count"></span></div><pre id="about"></pre><svg id="g" width="1200" height="900"></svg><script>
const data={data},svg=document.getElementById("g"),at={{}},hidden=new Set();let picked=null;
const make=(tag,attributes)=>{{const e=document.createElementNS("http://www.w3.org/2000/svg",tag);for(const k in attributes)e.setAttribute(k,attributes[k]);svg.appendChild(e);return e}};
data.nodes.forEach((n,i)=>{{const w=2*Math.PI*i/data.nodes.length;at[n.id]=[600+420*Math.cos(w),450+400*Math.sin(w)]}});
const lines=data.edges.filter(e=>at[e.from]&&at[e.to]).map(e=>{{const a=at[e.from],b=at[e.to],l=make("line",{{x1:a[0],y1:a[1],x2:b[0],y2:b[1]}}),t=document.createElementNS("http://www.w3.org/2000/svg","title");t.textContent=e.label+": "+e.desc;l.appendChild(t);return[e,l]}});
const near=id=>new Set(data.edges.flatMap(e=>e.from===id||e.to===id?[e.from,e.to]:[]).concat(id));
const dots=data.nodes.map(n=>{{const[x,y]=at[n.id],c=make("circle",{{cx:x,cy:y,r:5+Math.min(10,Math.log2(1+(n.mentions||1))),fill:n.colours[0],stroke:n.colours[1]}}),t=make("text",{{x:x+10,y:y+4}});t.textContent=n.label;c.onclick=()=>{{picked=picked===n.id?null:n.id;show()}};return[n,c,t]}});
const kind=Object.fromEntries(data.nodes.map(n=>[n.id,n.type]));
function show(){{const q=document.getElementById("q").value.trim().toLowerCase(),around=picked&&near(picked);let shown=0;
dots.forEach(([n,...parts])=>{{const gone=hidden.has(n.type),off=!(n.label+" "+n.desc).toLowerCase().includes(q)||(around&&!around.has(n.id));shown+=!gone&&!off;parts.forEach(p=>{{p.classList.toggle("gone",gone);p.classList.toggle("off",off)}})}});
lines.forEach(([e,l])=>{{l.classList.toggle("gone",hidden.has(kind[e.from])||hidden.has(kind[e.to]));l.classList.toggle("off",!!picked&&e.from!==picked&&e.to!==picked)}});
document.getElementById("count").textContent=shown+" of "+data.nodes.length+" nodes, "+data.edges.length+" edges";
const n=data.nodes.find(n=>n.id===picked);document.getElementById("about").textContent=n?n.label+"\\n"+n.type+"\\n"+n.desc+"\\n"+data.edges.filter(e=>e.from===n.id||e.to===n.id).map(e=>(e.from===n.id?"to ":"from ")+(e.from===n.id?e.to:e.from)+" ("+e.label+")").join("\\n"):""}}
[...new Set(data.nodes.map(n=>n.type))].sort().forEach(type=>{{const l=document.createElement("label"),box=document.createElement("input"),of=data.nodes.find(n=>n.type===type).colours;box.type="checkbox";box.checked=true;box.onchange=()=>{{box.checked?hidden.delete(type):hidden.add(type);show()}};l.style.background=of[0];l.style.color=of[2];l.append(box,type);document.getElementById("legend").append(l)}});
document.getElementById("q").oninput=show;show();
</script></body></html>"""


def to_html(nodes: DataFrame, edges: DataFrame, title: str = "Graph") -> str:
    """A page that draws the subgraph: search, a legend that toggles types, and a node's neighbours on a click."""
    made = nodes.withColumn("colours", colours(F.col("type"), PAGE_COLOURS))
    data = {"nodes": [r.asDict() for r in sorted(_drawn(made), key=lambda r: r["id"])], "edges": [r.asDict() for r in sorted(_drawn(edges), key=lambda r: (r["from"], r["to"], r["label"]))]}
    return _PAGE.format(title=html.escape(title), data=json.dumps(data, ensure_ascii=False).replace("</", "<\\/"))
