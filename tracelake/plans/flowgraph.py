"""What stands behind an item: the edges of a traversal, what happens inside methods, conditions, and call graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..schema import BRANCHES, EDGE
from .impact import method_starts
from .tables import cut

#: Calls inside calls that an expansion follows.
MAX_DEPTH = 32


def traced_edges(edges: DataFrame, visits: DataFrame, reverse: bool = False) -> DataFrame:
    """Level 1: every usable edge between nodes of a traversal, to nodes seen before too: (start, src, dst, kind, conf, clause, flags)."""
    s = visits.select("start", "v", "terminal")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    out = edges.join(s.filter("not terminal").select("start", F.col("v").alias(a)), a).join(s.select("start", F.col("v").alias(b)), ["start", b], "left_semi")
    return out.select("start", "src", "dst", "kind", "conf", "clause", "flags").dropDuplicates(["start", "src", "dst", "kind", "clause", "flags"])


def _grouped(l2_edges: DataFrame, asked: DataFrame, columns: list[str], find, schema: str) -> DataFrame:
    """find(edges of a method, asked rows of it) for each method; only methods that are asked for are read."""
    e = l2_edges.join(asked.select("sig").distinct(), "sig", "left_semi").select("sig", "src", "dst", F.col("kind").alias("what"), "label", "case_val", *(F.lit(None).cast(t).alias(c) for c, t in asked.drop("sig").dtypes))
    q = asked.select("sig", F.lit(None).cast("int").alias("src"), F.lit(None).cast("int").alias("dst"), F.lit(None).cast("string").alias("what"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("string").alias("case_val"), *columns)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        edges, wanted = t[t.what.notna()], t[t.what.isna()]
        rows = find(edges, wanted) if len(wanted) else []
        return pd.DataFrame([(t.sig.iloc[0], *r) for r in rows], columns=[c.split()[0] for c in schema.split(", ")])

    return e.unionByName(q).groupBy("sig").applyInPandas(run, schema)


def inner_paths(l2_edges: DataFrame, asked: DataFrame, control: bool = False) -> DataFrame:
    """asked(sig, a, b) to (sig, a, b, seq, lid, via): the shortest way from a to b inside a method, both ends included."""

    def find(edges, wanted):
        after: dict = {}
        for s, d, k in zip(edges.src, edges.dst, edges.what):
            if k == "DEF_USE" or control:
                after.setdefault(int(s), []).append((int(d), k))
        out = []
        for a, b in sorted(set(zip(wanted.a.astype(int), wanted.b.astype(int)))):
            came, todo = {a: (None, None)}, [a]
            for v in todo:
                for w, k in sorted(after.get(v, ())):
                    if w not in came:
                        came[w] = v, k
                        todo.append(w)
            if b in came:
                path, v = [], b
                while v is not None:
                    path.append((v, came[v][1]))
                    v = came[v][0]
                out += [(a, b, i, v, k) for i, (v, k) in enumerate(reversed(path))]
        return out

    return _grouped(l2_edges, asked, ["a", "b"], find, "sig string, a int, b int, seq int, lid int, via string")


def inner_edges(l2_edges: DataFrame, asked: DataFrame, control: bool = False) -> DataFrame:
    """Level 2 inside a method: asked(sig, a, b) to (sig, a, b, src, dst, kind), the edges on any way from a to b."""

    def find(edges, wanted):
        rows = [(int(s), int(d), k) for s, d, k in zip(edges.src, edges.dst, edges.what) if k == "DEF_USE" or control]

        def reach(start, pairs):
            seen, todo = {start}, [start]
            while todo:
                v = todo.pop()
                for s, d in pairs.get(v, ()):
                    if d not in seen:
                        seen.add(d)
                        todo.append(d)
            return seen

        on, back = {}, {}
        for s, d, _ in rows:
            on.setdefault(s, []).append((s, d))
            back.setdefault(d, []).append((d, s))
        out = []
        for a, b in sorted(set(zip(wanted.a.astype(int), wanted.b.astype(int)))):
            both = reach(a, on) & reach(b, back)
            out += [(a, b, s, d, k) for s, d, k in rows if s in both and d in both]
        return out

    return _grouped(l2_edges, asked, ["a", "b"], find, "sig string, a int, b int, src int, dst int, kind string")


def conditions(l2_nodes: DataFrame, l2_edges: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(sig, lid) to (sig, lid, conditions): the branches under which a value comes about, outermost first.

    Alternatives of one step stand in parentheses; the way up follows the first. What depends on itself is left out.
    """
    names = l2_nodes.select("sig", F.col("lid").alias("src"), F.col("name").alias("p"))
    control = l2_edges.filter("kind = 'CONTROL'").join(names, ["sig", "src"])
    label = F.element_at(F.array(*map(F.lit, BRANCHES)), F.col("label") + 1)
    text = F.concat_ws(" ", "p", F.concat(F.lit("["), F.concat_ws(" ", label, F.when(F.col("case_val") != "", F.col("case_val"))), F.lit("]")))
    steps = control.select("sig", "src", "dst", text.alias("case_val"), F.lit("CONTROL").alias("kind"), F.lit(None).cast("int").alias("label"))

    def find(edges, wanted):
        up: dict = {}
        for s, d, t in zip(edges.src, edges.dst, edges.case_val):
            if s != d:
                up.setdefault(int(d), []).append((int(s), t))
        out = []
        for lid in sorted(set(wanted.lid.astype(int))):
            chain, at, seen = [], lid, {lid}
            while at in up:
                own = sorted(set(up[at]))
                chain.append(own[0][1] if len(own) == 1 else f"({' | '.join(t for _, t in own)})")
                at = own[0][0]
                if at in seen:
                    break
                seen.add(at)
            if chain:
                out.append((lid, " → ".join(reversed(chain))))
        return out

    return _grouped(steps, asked, ["lid"], find, "sig string, lid int, conditions string")


def expanded_calls(project, pairs: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Level 2 across methods: pairs(src, dst) of SUMMARY edges to (src, dst, a, b, kind, level), the edges inside the calls that they stand for.

    From an argument into the callee's formal, from its result back, and what leads from one to the other there; SUMMARY edges found
    on the way are expanded in turn, each once.
    """
    e = project.edge.select("kind", "src", "dst")
    args, rets = (e.filter(F.col("kind") == EDGE[k]) for k in ("ARG_IN", "RET_OUT"))
    inside = e.filter(F.col("kind").isin(*(EDGE[k] for k in ("LOCAL_FLOW", "CONTROL_FLOW", "SUMMARY", "BIND_TO", "MAPS_TO", "STORE", "LOAD"))))
    todo, seen, out, level = cut(pairs.select("src", "dst").distinct()), None, None, 0
    while level < depth and todo.limit(1).count():
        level += 1
        seen = todo if seen is None else seen.union(todo)
        into = todo.join(args.select("src", F.col("dst").alias("f")), "src").select("src", "dst", "f")
        back = todo.join(rets.select("dst", F.col("src").alias("o")), "dst").select("src", "dst", "o")
        pair = into.join(back, ["src", "dst"])
        owner = project.node.select("gid", "sig")
        pair = pair.join(owner.select(F.col("gid").alias("f"), F.col("sig").alias("m")), "f").join(owner.select(F.col("gid").alias("o"), F.col("sig").alias("m")), ["o", "m"])
        key = F.concat_ws(">", "src", "dst", "f", "o")
        pair = cut(pair.withColumn("start", key))
        ahead = graph.reach(inside, pair.select("start", F.col("f").alias("v")))
        behind = graph.reach(graph.flip(inside), pair.select("start", F.col("o").alias("v")))
        both = ahead.select("start", "v").join(behind.select("start", "v"), ["start", "v"], "left_semi")
        body = inside.join(both.select("start", F.col("v").alias("src")), "src").join(both.select("start", F.col("v").alias("dst")), ["start", "dst"], "left_semi").select("start", F.col("src").alias("a"), F.col("dst").alias("b"), "kind")
        body = body.join(pair.select("start", "src", "dst"), "start").select("src", "dst", "a", "b", "kind")
        met = pair.join(body.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        ends = met.select("src", "dst", F.col("src").alias("a"), F.col("f").alias("b"), F.lit(EDGE["ARG_IN"]).alias("kind")).union(met.select("src", "dst", F.col("o").alias("a"), F.col("dst").alias("b"), F.lit(EDGE["RET_OUT"]).alias("kind")))
        found = cut(body.union(ends).distinct().withColumn("level", F.lit(level)))
        out = found if out is None else out.union(found)
        inner = found.filter(F.col("kind") == EDGE["SUMMARY"]).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        todo = cut(inner.join(seen, ["src", "dst"], "left_anti"))
    return out if out is not None else pairs.select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("kind"), F.lit(0).alias("level")).limit(0)


def call_graph(project, questions: DataFrame, items: DataFrame) -> DataFrame:
    """The calls that method_items() follow: (query_id, caller, callee, label), between its callers and to the methods asked for, the label `L<line>`."""
    callers = items.filter("type <> 'ENDPOINT'").select("query_id", F.col("target").alias("caller"))
    callees = callers.select("query_id", F.col("caller").alias("callee")).union(method_starts(project, questions).select("query_id", F.col("sig").alias("callee"))).distinct()
    calls = project.call_edge.select("caller", "callee", F.concat(F.lit("L"), F.col("line").cast("string")).alias("label"))
    return calls.join(callers, "caller").join(callees, ["query_id", "callee"], "left_semi").select("query_id", "caller", "callee", "label").distinct()


def components(calls: DataFrame) -> DataFrame:
    """calls(caller, callee) to (method, component): the least method of the strongly connected component, of methods that call anything.

    Methods whose reach meets their own callers in a cycle: forward and backward colouring by the least name, round by round, of what isn't yet decided.
    """
    edges = cut(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct())
    left = cut(edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct())
    done = None
    while left.limit(1).count():
        live = edges.join(left.select(F.col("v").alias("src")), "src", "left_semi").join(left.select(F.col("v").alias("dst")), "dst", "left_semi")
        live = cut(live)
        colour = _least(live, left)  # the least method that reaches each
        same = live.join(colour.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd")
        seeds = colour.select(F.col("c").alias("start"), F.col("c").alias("v")).distinct()
        back = graph.reach(graph.flip(same.select("src", "dst")), seeds)
        found = cut(back.join(colour.select("v", F.col("c").alias("start")), ["v", "start"], "left_semi").select(F.col("v").alias("method"), F.col("start").alias("component")))
        done = found if done is None else done.union(found)
        left = cut(left.join(found.select(F.col("method").alias("v")), "v", "left_anti"))
    return done if done is not None else calls.select(F.col("caller").alias("method"), F.col("caller").alias("component")).limit(0)


def _least(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, c): the least node that reaches v, v itself included."""
    colour = cut(nodes.select("v", F.col("v").alias("c")))
    while True:
        step = edges.join(colour, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), F.col("c").alias("n")).groupBy("v").agg(F.min("n").alias("n"))
        new = cut(colour.join(step, "v", "left").select("v", F.least("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") < F.col("c")).alias("changed")))
        if new.filter("changed").limit(1).count() == 0:
            return new.select("v", "c")
        colour = new.select("v", "c")


def paths(visits: DataFrame, items: DataFrame) -> DataFrame:
    """Items with a path_id to its steps in the order of the flow: (query_id, path_id, seq, v, via)."""
    wanted = items.filter("path_id >= 0").select(F.col("query_id").alias("start"), "v", "path_id")
    steps = graph.path_of(visits, wanted.select("start", "v").distinct())
    out = steps.join(wanted.withColumnRenamed("v", "target"), ["start", "target"])
    return out.select(F.col("start").alias("query_id"), "path_id", F.row_number().over(Window.partitionBy("start", "path_id").orderBy("seq")).alias("seq"), "v", "via")
