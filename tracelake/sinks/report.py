"""Results for people: a console listing, an HTML page, DOT with a cluster per method, and SVG where Graphviz is there.

Pages show at most ROWS rows of a table and say how many there are; counts are over all rows.
"""

from __future__ import annotations

import html
import shutil
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CONFIDENCES, EDGE_KINDS, LABELS, NODE_KINDS

ROWS = 1_000


def listing(items: DataFrame, limit: int = ROWS) -> tuple[int, str]:
    """Exit code (2 if there is nothing) and the lines of items by distance, type and target."""
    rows = items.orderBy("query_id", "distance", "type", "target").limit(limit).collect()
    lines = [f"{r.query_id}  {r.distance:>3}  {CONFIDENCES[r.conf]:<9} {LABELS[r.type]:<14} {r.target}" for r in rows]
    return (0, "\n".join(lines)) if rows else (2, "nothing found")


def tiles(items: DataFrame) -> DataFrame:
    """(type, n, exact, implicit, control), most frequent first."""
    count = lambda c: F.count_if(c)
    return items.groupBy("type").agg(F.count(F.lit(1)).alias("n"), count(F.col("conf") == 0).alias("exact"), count(F.col("implicit")).alias("implicit"), count(F.col("control")).alias("control")).orderBy(F.desc("n"), "type")


def _table(df: DataFrame, limit: int) -> str:
    rows = df.limit(limit).collect()
    cells = lambda tag, xs: "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in xs)
    return f"<table><tr>{cells('th', df.columns)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def page(title: str, items: DataFrame, steps: DataFrame | None = None, limit: int = ROWS) -> str:
    """An HTML page of items, their tiles, and the steps of their paths."""
    n, depth = items.agg(F.count(F.lit(1)), F.max("distance")).first()
    label = F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), F.col("type"))
    shown = items.withColumn("type", label).select("query_id", "distance", "type", "target", F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.col("conf") + 1).alias("confidence"), "implicit", "control", "path_id", "line")
    parts = [f"<h1>{html.escape(title)}</h1><p>{n} items, {depth or 0} steps at most; {min(n, limit)} shown</p>", _table(tiles(items), limit), _table(shown.orderBy("query_id", "distance", "type", "target"), limit)]
    if steps is not None:
        parts += ["<h2>Paths</h2>", _table(steps.orderBy("query_id", "path_id", "seq"), limit)]
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>" + html.escape(title) + "</title></head><body>" + "".join(parts) + "</body></html>"


def dot(nodes: DataFrame, edges: DataFrame, limit: int = ROWS) -> str:
    """nodes(gid, name, kind, sig) and edges(src, dst, kind, conf, flags) as DOT: a cluster per method in order of first node, labels cut at 48."""
    text = lambda s: (s if len(s) <= 48 else s[:47] + "…").replace("\\", "\\\\").replace('"', '\\"')
    shapes = {"COLUMN": "cylinder", "ENDPOINT": "house", "PREDICATE": "diamond", "FIELD": "box3d", "BIND": "cds"}
    groups: dict = {}
    for r in nodes.orderBy("gid").limit(limit).collect():
        groups.setdefault(r.sig, []).append(f'n{r.gid} [label="{text(r.name)}", shape={shapes.get(NODE_KINDS[r.kind], "box")}];')
    out = ["digraph g {"]
    for k, (sig, lines) in enumerate(groups.items()):
        out += lines if sig is None else [f"subgraph cluster{k} {{", f'label="{text(sig.split(".")[-1] if "(" not in sig else sig.split("(")[0].split(".")[-1])}";', *lines, "}"]
    for r in edges.orderBy("src", "dst", "kind").limit(limit * 4).collect():
        style = "dotted" if r.flags & 2 else "dashed" if r.flags & 1 else "solid"
        out.append(f'n{r.src} -> n{r.dst} [label="{EDGE_KINDS[r.kind]}", style={style}, color={("black", "gray40", "gray70")[r.conf]}];')
    return "\n".join([*out, "}"])


def svg(text: str, timeout: int = 60) -> str | None:
    """The picture of a DOT text; None where the dot program isn't there or fails."""
    if shutil.which("dot") is None:
        return None
    done = subprocess.run(["dot", "-Tsvg"], input=text, capture_output=True, text=True, timeout=timeout)
    return done.stdout if done.returncode == 0 else None
