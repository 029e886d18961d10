"""From extracted methods and SQL statements to one program graph: resolution, pairing and summaries as joins.

Nodes have string keys until dense_ids() numbers them: `sig|lid` inside methods, `C:table.column`, `F:class.field` and `E:VERB path`
for the nodes that all methods share. Every step is a DataFrame over all methods at once; fixpoints go on until nothing is new, with a table in
the shared folder for each round.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut
from ..schema import CLAUSE, CONTROL, EDGE, IMPLICIT, NODE, SPLICED
from .graph import minimal_masks

EDGE_SHAPE = "kind int, src string, dst string, conf int, clause int, flags int, masks int, derive int, sig string"
SOURCES, SINKS = ("FORMAL_IN", "ACTUAL_OUT", "FIELD_LOAD"), ("ACTUAL_IN", "FORMAL_OUT", "FIELD_STORE")


def local(lid: str | Column, sig: str = "sig") -> Column:
    return F.concat(F.col(sig), F.lit("|"), (F.col(lid) if isinstance(lid, str) else lid).cast("string"))


def edge(df: DataFrame, kind: str, src: Column, dst: Column, conf: Column, clause: Column | None = None, flags: Column | None = None, masks: Column | None = None, derive: Column | None = None) -> DataFrame:
    """Rows of EDGE_SHAPE; df has the sig of the method that holds the edge, or null."""
    zero = F.lit(0)
    parts = {"conf": conf, "clause": clause, "flags": flags, "masks": masks, "derive": derive}
    return df.select(F.lit(EDGE[kind]).alias("kind"), src.alias("src"), dst.alias("dst"), *((zero if x is None else x).cast("int").alias(n) for n, x in parts.items()), "sig").filter("src is not null and dst is not null")


# Classes

def supertypes(classes: DataFrame) -> DataFrame:
    """classes(name, extends, implements) to (class, ancestor, depth, up): itself at depth 0, nearest first; up: through superclasses alone."""
    up = classes.filter("extends <> ''").select(F.col("name").alias("ancestor"), F.col("extends").alias("next"), F.lit(True).alias("chain"))
    side = classes.select(F.col("name").alias("ancestor"), F.explode("implements").alias("next"), F.lit(False).alias("chain"))
    links = cut(up.union(side).distinct())
    seen = cut(classes.select(F.col("name").alias("class"), F.col("name").alias("ancestor"), F.lit(0).alias("depth"), F.lit(True).alias("up")))
    new = seen
    while True:
        step = new.join(links, "ancestor").groupBy("class", F.col("next").alias("ancestor")).agg((F.min("depth") + 1).alias("depth"), F.max(F.col("up") & F.col("chain")).alias("up"))
        new = cut(step.join(seen, ["class", "ancestor"], "left_anti"))
        if new.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(new)


def lookup_up(wanted: DataFrame, ancestors: DataFrame, methods: DataFrame) -> DataFrame:
    """wanted(id, class, name, n) to (id, sig, abstract): the nearest method of that name with n formals up the superclass chain."""
    rows = wanted.join(ancestors.filter("up").select("class", "ancestor", "depth"), "class")
    m = methods.select(F.col("class").alias("ancestor"), "name", F.size("formal_in").alias("n_in"), "sig", "abstract", "synthetic")
    rows = rows.join(m, ["ancestor", "name"]).filter("n_in = n or synthetic")
    return rows.groupBy("id", "class").agg(F.min_by(F.struct("sig", "abstract"), F.struct("depth", "sig")).alias("x")).select("id", "x.*")


# SQL statements and their methods

def match_statements(statements: DataFrame, methods: DataFrame) -> DataFrame:
    """statements(class, name, sig or null, binds, ...) with the method each stands for: sig, param_names, param_types, formals, has_method, n_roots.

    A statement without a sig belongs to the first abstract method class#name; of several statements for a method the first counts.
    Statements without any method become methods of their own, with a formal for each bind root.
    """
    abstract = methods.filter("abstract").groupBy("class", "name").agg(F.min_by("sig", F.struct("file_id", "seq")).alias("found"))
    s = statements.join(abstract, ["class", "name"], "left")
    roots = F.array_distinct(F.transform("binds", lambda b: b["root"]))
    s = s.withColumn("roots", roots).withColumn("sig", F.coalesce("sig", "found", F.concat("class", F.lit("#"), "name", F.lit("()")))).drop("found")
    first = s.groupBy("sig").agg(F.min(F.struct("file_id", "line", "name")).alias("first"))
    s = s.join(first, "sig").filter((F.col("first.file_id") == F.col("file_id")) & (F.col("first.line") == F.col("line")) & (F.col("first.name") == F.col("name"))).drop("first")
    m = methods.select("sig", "param_names", "param_types", "formal_in", "formal_out", "has_this", F.lit(True).alias("has_method"))
    s = s.join(m, "sig", "left").withColumn("has_method", F.coalesce("has_method", F.lit(False)))
    formals = F.when(F.col("has_method"), F.transform(F.slice("formal_in", F.when(F.col("has_this"), 2).otherwise(1), F.size("param_names")), lambda x: x.cast("string"))).otherwise(F.transform("roots", lambda r: F.concat(F.lit("p"), (F.array_position(F.col("roots"), r) - 1).cast("string"))))
    out = F.when(F.col("has_method") & F.col("formal_out").isNotNull(), F.col("formal_out").cast("string")).otherwise(F.lit("out"))
    return s.withColumn("names", F.when(F.col("has_method"), F.col("param_names")).otherwise(F.col("roots"))).withColumn("formals", formals).withColumn("result_node", out)


def bind_parameters(matched: DataFrame) -> DataFrame:
    """match_statements() to (sig, slot, expr, root, path, literal, formal, conf): each bind with the formals that it can be of.

    One parameter is every root's; otherwise by name, param<n> (from 1) or arg<n> (from 0), and else all parameters, HEURISTIC.
    """
    b = matched.select("sig", "names", "formals", F.size("roots").alias("n_roots"), "has_method", F.explode("binds").alias("b")).select("sig", "names", "formals", "n_roots", "has_method", "b.*")
    n, root = F.size("formals"), F.col("root")
    named = F.array_position("names", root) - 1
    param = F.regexp_extract("root", r"^param(\d{1,4})$", 1)
    arg = F.regexp_extract("root", r"^arg(\d{1,4})$", 1)
    at = F.when(named >= 0, named).when(param != "", param.try_cast("int") - 1).when(arg != "", arg.try_cast("int"))
    sure = (at >= 0) & (at < n)
    one = (n == 1) & F.col("has_method")
    places = F.when(one, F.array(F.lit(0))).when(sure, F.array(at.cast("int"))).when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    conf = F.when(one, F.when(F.col("n_roots") == 1, 0).otherwise(1)).when(sure, 0).otherwise(2)
    return b.withColumn("conf", F.when(F.col("literal"), 2).otherwise(conf)).withColumn("at", F.explode_outer(places)).select("sig", "slot", "expr", "root", "path", "literal", F.element_at("formals", F.col("at") + 1).alias("formal"), "conf")


def sql_nodes(matched: DataFrame) -> DataFrame:
    """(key, kind, name, sig, file_id, line) of statements: binds, spliced texts, and formals of methods that only SQL has."""
    b = matched.select("sig", "file_id", "line", F.explode("binds").alias("b"))
    kind = F.when(F.col("b.literal"), NODE["UNKNOWN"]).otherwise(NODE["BIND"])
    name = F.concat(F.when(F.col("b.literal"), "${").otherwise("#{"), F.col("b.expr"), F.lit("}"))
    out = b.select(F.concat("sig", F.lit("|b"), F.col("b.slot").cast("string")).alias("key"), kind.alias("kind"), name.alias("name"), "sig", "file_id", "line")
    own = matched.filter("not has_method")
    formals = own.select("sig", "file_id", "line", F.posexplode("roots").alias("i", "root")).select(F.concat("sig", F.lit("|p"), F.col("i").cast("string")).alias("key"), F.lit(NODE["FORMAL_IN"]).alias("kind"), F.col("root").alias("name"), "sig", "file_id", "line")
    result = matched.filter("result_node = 'out'").select(local(F.lit("out")).alias("key"), F.lit(NODE["FORMAL_OUT"]).alias("kind"), F.lit("return").alias("name"), "sig", "file_id", "line")
    return out.unionByName(formals).unionByName(result)


def sql_edges(matched: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges of statements from lineage() facts, whose id is `sig`, `sig@variant`: binds, columns, results and derivations."""
    real = lambda c: F.coalesce(~F.upper(c).contains(SPLICED), F.lit(True))
    f = facts.withColumn("sig", F.regexp_replace("id", r"@v\d+$", "")).filter(real("source_table") & real("target_table") & real("source_column") & real("target_column"))
    f = f.join(matched.select("sig", "capped", "result_node", "result_type", "properties", F.lower(F.regexp_extract("sql", r"^\s*([A-Za-z]+)", 1)).alias("verb")).dropDuplicates(["sig"]), "sig")
    base = F.when(F.col("capped"), 2).otherwise(0)
    conf, result = F.greatest(F.col("conf"), base), local("result_node")
    column = lambda side: F.concat(F.lit("C:"), F.col(f"{side}_table"), F.lit("."), F.col(f"{side}_column"))
    bind = F.concat("sig", F.lit("|b"), F.regexp_extract("bind", r"(\d+)$", 1))
    select, item = F.col("verb").isin("select", "with"), CLAUSE["SELECT_ITEM"]
    uses = f.filter("fact = 'use'")
    implicit = F.when(select & F.col("top") & (F.col("clause") == item), 0).otherwise(IMPLICIT)
    out = edge(uses, "MAPS_TO", column("source"), result, conf, F.col("clause"), implicit)
    binds = f.filter("fact = 'bind' and bind is not null")
    out = out.unionByName(edge(binds.filter("target_table is not null"), "MAPS_TO", bind, column("target"), conf, F.col("clause")))
    out = out.unionByName(edge(f.filter("fact = 'derive'"), "COL_DERIVES", column("source"), column("target"), conf, F.col("clause"), F.when(F.col("implicit"), IMPLICIT).otherwise(0), derive=F.col("derive")))
    # A bind only reaches the result as a filter, unless a select shows it.
    shown = binds.filter(F.col("clause") == item).select("sig", F.regexp_extract("bind", r"(\d+)$", 1).alias("slot")).distinct().withColumn("shown", F.lit(True))
    slots = matched.select("sig", "capped", "result_node", F.lower(F.regexp_extract("sql", r"^\s*([A-Za-z]+)", 1)).alias("verb"), F.explode("binds").alias("b")).filter("not b.literal").withColumn("slot", F.col("b.slot").cast("string"))
    slots = slots.join(shown, ["sig", "slot"], "left")
    flag = F.when(F.col("shown").isNotNull() & F.col("verb").isin("select", "with"), 0).otherwise(IMPLICIT)
    out = out.unionByName(edge(slots, "LOCAL_FLOW", F.concat("sig", F.lit("|b"), "slot"), local("result_node"), base, flags=flag))
    spliced = matched.select("sig", "result_node", F.explode("binds").alias("b")).filter("b.literal")
    out = out.unionByName(edge(spliced, "LOCAL_FLOW", F.concat("sig", F.lit("|b"), F.col("b.slot").cast("string")), local("result_node"), F.lit(2)))
    # Result rows to properties of the result type.
    dto = f.filter("fact = 'item'").filter(select & F.col("result_type").contains(".") & ~F.col("result_type").startswith("java.") & ~F.col("target_column").endswith("*"))
    words = F.split(F.lower("target_column"), "_")
    camel = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")
    prop = F.coalesce(F.element_at("properties", F.upper("target_column")), camel)
    out = out.unionByName(edge(dto, "MAPS_TO", column("source"), F.concat(F.lit("F:"), "result_type", F.lit("."), prop), F.greatest(conf, F.lit(1)), F.lit(item)))
    formals = bind_parameters(matched)
    return out.unionByName(edge(formals, "BIND_TO", local("formal"), F.concat("sig", F.lit("|b"), F.col("slot").cast("string")), F.col("conf"))).distinct()


def dto_binds(matched: DataFrame, ancestors: DataFrame, fields: DataFrame) -> DataFrame:
    """FIELD to BIND edges: a bind that names a property of the only parameter's class, or of the parameter that it names."""
    p = bind_parameters(matched).join(matched.select("sig", "names", "formals", "param_types", "parameter_type").distinct(), "sig")
    at = F.array_position("formals", F.col("formal"))
    kind = F.coalesce(F.nullif("parameter_type", F.lit("")), F.expr("try_element_at(param_types, cast(array_position(formals, formal) as int))"))
    named = F.element_at("names", at.cast("int")) == F.col("root")
    prop = F.when(named & (F.col("path") != ""), F.split("path", r"\.")[0]).when((F.size("formals") == 1) & ~F.coalesce(named, F.lit(False)), F.split("expr", r"\.")[0])
    p = p.filter(at > 0).withColumn("class", kind).withColumn("property", prop).filter("property is not null and not literal")
    found = p.join(ancestors.filter("up").select("class", "ancestor", "depth"), "class").join(fields.select(F.col("class").alias("ancestor"), F.col("name").alias("property")), ["ancestor", "property"])
    near = found.groupBy("sig", "slot", "property").agg(F.min_by("ancestor", "depth").alias("owner"))
    return edge(near, "LOAD", F.concat(F.lit("F:"), "owner", F.lit("."), "property"), F.concat("sig", F.lit("|b"), F.col("slot").cast("string")), F.lit(1))


# Methods

def local_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Interface node to interface node inside methods: LOCAL_FLOW by definitions and uses alone, CONTROL_FLOW with control on the way.

    A path is as sure as its least sure edge, and of all paths the surest counts. One group is one method.
    """
    kinds = {NODE[k]: True for k in SOURCES} | {NODE[k]: False for k in SINKS}
    n = nodes.filter(F.col("kind").isin(*kinds)).select("sig", F.col("lid").alias("a"), F.lit(-1).alias("b"), F.col("kind").alias("c"))
    e = edges.select("sig", F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("conf") * 2 + (F.col("kind") == "CONTROL").cast("int")).alias("c"))
    rows = n.unionByName(e.join(n.select("sig").distinct(), "sig", "left_semi"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        out, after, sink = [], {}, set()
        for a, b, c in zip(t.a, t.b, t.c):
            if b >= 0:
                after.setdefault(a, []).append((b, c >> 1, c & 1))
            elif not kinds[c]:
                sink.add(a)
        for s in t.a[(t.b < 0) & t.c.map(kinds)]:
            best, todo = {(s, 0): 0}, [[(s, 0)], [], []]
            for conf in range(3):
                for v, ctl in todo[conf]:
                    if best[v, ctl] < conf:
                        continue
                    for w, ec, eb in after.get(v, ()):
                        key, nc = (w, ctl | eb), max(conf, ec)
                        if best.get(key, 3) > nc:
                            best[key] = nc
                            todo[nc].append(key)
            for w in sink - {s}:
                for ctl in (0, 1):
                    if (w, ctl) in best:
                        out.append((t.sig.iloc[0], s, w, best[w, ctl], ctl))
                        break
        return pd.DataFrame(out, columns=["sig", "a", "b", "conf", "ctl"])

    f = rows.groupBy("sig").applyInPandas(run, "sig string, a int, b int, conf int, ctl int")
    flows = edge(f.filter("ctl = 0"), "LOCAL_FLOW", local("a"), local("b"), F.col("conf"))
    return flows.unionByName(edge(f.filter("ctl = 1"), "CONTROL_FLOW", local("a"), local("b"), F.col("conf"), flags=F.lit(CONTROL)))


def field_edges(accesses: DataFrame, classes: DataFrame, fields: DataFrame) -> DataFrame:
    """STORE and LOAD edges; those of a field that its class, known in the project, doesn't have are dropped."""
    owner = F.regexp_extract("field", r"^(.*)\.[^.]*$", 1)
    a = accesses.withColumn("class", owner).withColumn("name", F.regexp_extract("field", r"([^.]*)$", 1))
    missing = a.join(classes.select(F.col("name").alias("class")), "class", "left_semi").join(fields.select("class", "name"), ["class", "name"], "left_anti").select("field").distinct()
    a = a.join(missing, "field", "left_anti")
    field = F.concat(F.lit("F:"), "field")
    return edge(a.filter("stored"), "STORE", local("lid"), field, F.lit(0)).unionByName(edge(a.filter("not stored"), "LOAD", field, local("lid"), F.lit(0)))


def resolve_calls(calls: DataFrame, methods: DataFrame, classes: DataFrame, fields: DataFrame, ancestors: DataFrame) -> DataFrame:
    """calls to (sig, ord, callee, conf): of the ways to find a target the first that finds any.

    1 targets named by the site (direct, static, constructor, super, this); 2 without a receiver's type, all that match, HEURISTIC; 3 a SQL
    method of the receiver's type; 4 implementations of an interface or of a class with abstract methods, among the beans if the field is
    injected, by its qualifier if any has it; 5 targets named by the site; 6 by name and number up the superclasses.
    """
    m = methods.select("sig", "class", "name", "abstract", "synthetic")
    id_ = F.struct(F.col("sig").alias("sig"), F.col("ord").alias("ord"))
    c = calls.select(id_.alias("id"), "candidates", "conf", "name", F.col("receiver_type").alias("class"), "kind", "field", F.size("actual_in").alias("n"))
    direct = F.col("kind").isin("DIRECT_TARGET", "STATIC", "CONSTRUCTOR", "SUPER", "THIS")
    listed = c.withColumn("sig", F.explode("candidates")).join(m.select("sig"), "sig", "left_semi")
    out = listed.filter(direct).select("id", "sig", "conf", F.lit(1).alias("way"))
    open_ = F.col("kind").isin("VIRTUAL", "THIS")
    out = out.unionByName(listed.filter(open_ & (F.col("class") == "")).select("id", "sig", F.lit(2).alias("conf"), F.lit(2).alias("way")))
    typed = c.filter(open_ & (F.col("class") != ""))
    out = out.unionByName(typed.join(m.filter("synthetic").select("class", "name", "sig"), ["class", "name"]).select("id", "sig", F.lit(1).alias("conf"), F.lit(3).alias("way")))
    loose = classes.filter("kind = 'interface'").select(F.col("name").alias("class")).union(m.filter("abstract").select("class")).distinct()
    under = ancestors.filter("depth > 0").select(F.col("class").alias("impl"), F.col("ancestor").alias("class"))
    wide = typed.join(loose, "class", "left_semi").join(under, "class")
    wide = wide.join(classes.select(F.col("name").alias("impl"), "bean", "bean_name"), "impl")
    own = fields.select(F.concat("class", F.lit("."), "name").alias("field"), "injected", "qualifier")
    wide = wide.join(own, "field", "left")
    by_call = Window.partitionBy("id")
    wide = wide.withColumn("any_bean", F.max(F.col("bean") & F.coalesce("injected", F.lit(False))).over(by_call)).filter("not any_bean or bean")
    match = F.coalesce(F.col("any_bean") & (F.col("qualifier") != "") & (F.col("bean_name") == F.col("qualifier")), F.lit(False))
    wide = wide.withColumn("match", match).withColumn("any_match", F.max("match").over(by_call)).filter("not any_match or match")
    impl = lookup_up(wide.select("id", F.col("impl").alias("class"), "name", "n"), ancestors, methods).filter("not abstract").select("id", "sig").distinct()
    impl = impl.withColumn("conf", F.when(F.count(F.lit(1)).over(by_call) == 1, 1).otherwise(2))
    out = out.unionByName(impl.select("id", "sig", "conf", F.lit(4).alias("way")))
    out = out.unionByName(listed.filter(open_ & (F.col("class") != "")).select("id", "sig", "conf", F.lit(5).alias("way")))
    out = out.unionByName(lookup_up(typed.select("id", "class", "name", "n"), ancestors, methods).select("id", "sig", F.lit(1).alias("conf"), F.lit(6).alias("way")))
    best = out.groupBy("id").agg(F.min("way").alias("way"))
    found = out.join(best, ["id", "way"]).groupBy("id", "sig").agg(F.min("conf").alias("conf"))
    found = found.select("id.ord", F.col("id.sig").alias("caller"), F.col("sig").alias("callee"), "conf")
    site = calls.select(F.col("sig").alias("caller"), "ord", F.col("conf").alias("site_conf"))
    return found.join(site, ["caller", "ord"]).select(F.col("caller").alias("sig"), "ord", "callee", F.greatest("conf", "site_conf").alias("conf"))


def argument_pairs(calls: DataFrame, targets: DataFrame, methods: DataFrame) -> DataFrame:
    """(sig, ord, callee, actual, formal, conf): receivers with this, arguments by place, what is too many with the last parameter."""
    c = calls.select("sig", "ord", "actual_in", "has_receiver")
    m = methods.select(F.col("sig").alias("callee"), "formals", "has_this")
    rows = targets.join(c, ["sig", "ord"]).join(m, "callee").withColumn("i", F.explode(F.transform("actual_in", lambda x, i: i)))
    a0, f0 = F.col("has_receiver").cast("int"), F.col("has_this").cast("int")
    place, n = F.col("i") - a0, F.size("formals") - f0
    at = F.when((F.col("i") == 0) & F.col("has_receiver"), F.when(F.col("has_this"), 0)).when(n > 0, f0 + F.least(place, n - 1))
    rows = rows.withColumn("at", at).filter("at is not null")
    return rows.select("sig", "ord", "callee", local(F.element_at("actual_in", F.col("i") + 1)).alias("actual"), F.concat("callee", F.lit("|"), F.element_at("formals", (F.col("at") + 1).cast("int"))).alias("formal"), "conf")


def endpoint_edges(endpoints: DataFrame, methods: DataFrame) -> DataFrame:
    """ENDPOINT to its handler's parameters, and the handler's result to it."""
    e = endpoints.join(methods.select("sig", "formals", "result"), "sig").withColumn("key", F.concat(F.lit("E:"), "verb", F.lit(" "), "path"))
    ins = e.withColumn("p", F.explode("params")).withColumn("formal", F.element_at("formals", F.col("p.formal") + 1))
    return edge(ins, "ARG_IN", F.col("key"), local("formal"), F.lit(0)).unionByName(edge(e, "RET_OUT", local("result"), F.col("key"), F.lit(0)))


def method_summaries(intra: DataFrame, pairs: DataFrame, returns: DataFrame, methods: DataFrame) -> DataFrame:
    """Summaries (sig, src, dst, combos, conf): from formals and fields to results and fields, as the least fixpoint over all calls.

    intra: edges inside methods (sig, src, dst, conf, flags); pairs: argument_pairs(); returns(sig, ord, callee, result, out, conf). Fields are
    ends of paths, except where a path begins. Each round extends only what the round before found or improved.
    """
    is_field = lambda c: F.col(c).startswith("F:")
    flows = cut(intra.groupBy("sig", "src", "dst", "flags").agg(F.min("conf").alias("edge_conf")))
    formals = methods.select("sig", F.explode("formals").alias("f")).select("sig", local("f").alias("s"))
    seeds = formals.union(flows.filter(is_field("src")).select("sig", F.col("src").alias("s"))).distinct()
    keys = ["sig", "s", "v", "fl"]
    paths = cut(seeds.select("sig", "s", F.col("s").alias("v"), F.lit(0).alias("fl"), F.lit(0).alias("conf")))
    outs = methods.filter("result is not null").select("sig", local("result").alias("v"))
    sites = cut(pairs.select("sig", "ord", "callee", "actual", "formal", F.col("conf").alias("pair_conf")))
    calls = cut(returns.select("sig", "ord", "callee", "result", F.col("conf").alias("call_conf")).distinct())
    new = paths
    while True:
        done = paths.filter("s <> v").join(outs.withColumn("is_out", F.lit(True)), ["sig", "v"], "left").filter(F.col("is_out") | is_field("v"))
        done = cut(done.select(F.col("sig").alias("callee"), "s", F.col("v").alias("dst"), F.col("fl").alias("add"), F.col("conf").alias("sum_conf"), F.coalesce("is_out", F.lit(False)).alias("is_out")))
        live = paths.filter(~is_field("v") | (F.col("s") == F.col("v")))
        step = live.join(flows.withColumnRenamed("src", "v"), ["sig", "v"]).select("sig", "s", F.col("dst").alias("v"), F.col("fl").bitwiseOR(F.col("flags")).alias("fl"), F.greatest("conf", "edge_conf").alias("conf"))
        entry = live.join(sites.withColumnRenamed("actual", "v"), ["sig", "v"]).select("sig", "s", "fl", "conf", "ord", "callee", F.col("formal").alias("into"), "pair_conf")
        through = live.filter(is_field("s") & (F.col("s") == F.col("v"))).join(calls, "sig").select("sig", "s", "fl", "conf", "ord", "callee", F.col("s").alias("into"), F.col("call_conf").alias("pair_conf"))
        made = entry.unionByName(through).join(done.withColumnRenamed("s", "into"), ["callee", "into"]).join(calls, ["sig", "ord", "callee"], "left")
        made = made.withColumn("v", F.when(F.col("is_out"), F.col("result")).otherwise(F.col("dst"))).filter("v is not null")
        made = made.select("sig", "s", "v", F.col("fl").bitwiseOR(F.col("add")).alias("fl"), F.greatest("conf", "pair_conf", "sum_conf", F.coalesce(F.when(F.col("is_out"), F.col("call_conf")), F.lit(0))).alias("conf"))
        begun = done.filter(is_field("s")).join(calls, "callee").select("sig", "s", F.col("s").alias("v"), F.lit(0).alias("fl"), F.lit(0).alias("conf"))
        best = step.unionByName(made).unionByName(begun).groupBy(*keys).agg(F.min("conf").alias("conf"))
        known = paths.withColumnRenamed("conf", "was")
        new = cut(best.join(known, keys, "left").filter("was is null or conf < was").drop("was"))
        if new.limit(1).count() == 0:
            break
        paths = cut(paths.unionByName(new).groupBy(*keys).agg(F.min("conf").alias("conf")))
    return done.groupBy(F.col("callee").alias("sig"), F.col("s").alias("src"), "dst").agg(F.bit_or(F.expr("shiftleft(1, add)")).cast("int").alias("combos"), F.min("sum_conf").alias("conf"), F.max("is_out").alias("is_out"))


def summary_edges(summaries: DataFrame, pairs: DataFrame, returns: DataFrame) -> DataFrame:
    """SUMMARY edges at call sites: arguments or fields to results or fields, with the minimal flag combinations."""
    s = summaries.withColumnRenamed("sig", "callee").withColumnRenamed("conf", "sum_conf")
    calls = returns.select("sig", "ord", "callee", "result", F.col("conf").alias("call_conf"))
    by_argument = pairs.select("sig", "ord", "callee", F.col("actual").alias("from"), F.col("formal").alias("src"), F.col("conf").alias("pair_conf")).join(s, ["callee", "src"]).join(calls, ["sig", "ord", "callee"], "left")
    by_field = calls.join(s.filter(F.col("src").startswith("F:")), "callee").withColumn("from", F.col("src")).withColumn("pair_conf", F.col("call_conf"))
    names = ["sig", "from", "dst", "combos", "sum_conf", "pair_conf", "call_conf", "is_out", "result"]
    rows = by_argument.select(*names).unionByName(by_field.select(*names)).withColumn("to", F.when(F.col("is_out"), F.col("result")).otherwise(F.col("dst"))).filter("to is not null and to <> from")
    conf = F.greatest("sum_conf", "pair_conf", F.when(F.col("is_out"), F.col("call_conf")).otherwise(0))
    return edge(rows, "SUMMARY", F.col("from"), F.col("to"), conf, masks=minimal_masks(F.col("combos")))


def unresolved_edges(calls: DataFrame, targets: DataFrame, methods: DataFrame) -> DataFrame:
    """Arguments to results, HEURISTIC, of calls without a target that has a body or SQL."""
    real = targets.join(methods.filter("not abstract or synthetic").select(F.col("sig").alias("callee")), "callee", "left_semi").select("sig", "ord").distinct()
    open_ = calls.join(real, ["sig", "ord"], "left_anti").withColumn("a", F.explode("actual_in"))
    return edge(open_, "SUMMARY", local("a"), local("actual_out"), F.lit(2), masks=F.lit(1))


def call_graph(calls: DataFrame, targets: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, callee, site, line, conf): targets, and the declared methods that a site names."""
    named = calls.select("sig", "ord", F.explode("candidates").alias("callee"), "conf").join(methods.select(F.col("sig").alias("callee")), "callee", "left_semi")
    both = targets.select("sig", "ord", "callee", "conf").unionByName(named.select("sig", "ord", "callee", "conf")).groupBy("sig", "ord", "callee").agg(F.min("conf").alias("conf"))
    return both.join(calls.select("sig", "ord", "actual_out", "line"), ["sig", "ord"]).select(F.col("sig").alias("caller"), "callee", local("actual_out").alias("site"), "line", "conf")


def dense_ids(nodes: DataFrame) -> DataFrame:
    """nodes(key, sig or null, rank, place) to (key, gid long): methods by sig, in them by rank and place; shared nodes last.

    Two levels: the nodes of a method are numbered by themselves, and the methods' numbers of nodes are added up in ranges of sig.
    """
    inner = F.row_number().over(Window.partitionBy("sig").orderBy("rank", "place", "key"))
    shared = nodes.filter("sig is null").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(64)))
    per_method = nodes.filter("sig is not null").withColumn("i", inner)
    per_bucket = shared.withColumn("i", F.row_number().over(Window.partitionBy("bucket").orderBy("key")))
    rows = per_method.select("key", "i", F.concat(F.lit("0"), "sig").alias("of")).union(per_bucket.select("key", "i", F.format_string("1%02d", F.col("bucket").cast("int")).alias("of")))
    sizes = rows.groupBy("of").agg(F.max("i").alias("n"), F.substring("of", 1, 12).alias("range"))
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("rn"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("rn").over(before(Window.orderBy("range"))), F.lit(0)))
    sizes = sizes.withColumn("within", F.coalesce(F.sum("n").over(before(Window.partitionBy("range").orderBy("of"))), F.lit(0))).join(ranges.select("range", "base"), "range")
    return rows.join(sizes.select("of", "base", "within"), "of").select("key", (F.col("base") + F.col("within") + F.col("i") - 1).cast("long").alias("gid"))
