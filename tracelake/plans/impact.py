"""From a source tree to a graph, and the three impact questions on it, many at once.

index() reads Java, mapper XML and SQL files; column_impact(), param_flow() and method_items() take a table of questions and give items with
distance, confidence, flags and path numbers. Types of items are the codes of schema.LABELS.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, linking
from ..schema import CLAUSE, EDGE, NODE
from ..sources import files, java_flow, mappers, sql_lineage
from .tables import cut

#: Items with a path, per question.
MAX_PATHS = 500


@dataclass
class Project:
    """node(gid, key, kind, name, sig, synthetic, handler, file_id, line), edge, method, call_edge, summary, endpoint, problem; l2_node and l2_edge by sig."""

    node: DataFrame
    edge: DataFrame
    method: DataFrame
    call_edge: DataFrame
    summary: DataFrame
    endpoint: DataFrame
    problem: DataFrame
    l2_node: DataFrame
    l2_edge: DataFrame


def statements_of(sources: DataFrame, java: dict[str, DataFrame]) -> DataFrame:
    """All SQL statements: of mappers, of annotations and calls, and of SQL files; a row per variant."""
    binds = "array<struct<slot:int,expr:string,root:string,path:string,literal:boolean>>"
    names = ["file_id", "line", "class", "name", "sig", "variant", "sql", "binds", "capped", "parameter_type", "result_type", "properties"]
    none, no_props = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    slim = F.transform("binds", lambda b: F.struct(*(b[x].alias(x) for x in ("slot", "expr", "root", "path", "literal"))))
    x = mappers.mapper_statements(sources.filter("kind = 'xml'").select("file_id", "content")).filter("sql is not null")
    x = x.select("file_id", "line", F.col("namespace").alias("class"), F.col("id").alias("name"), none.alias("sig"), "variant", "sql", slim.cast(binds).alias("binds"), "capped", F.coalesce("parameter_type", F.lit("")).alias("parameter_type"), F.coalesce("result_type", F.lit("")).alias("result_type"), "properties")
    j = java["statement"].select("file_id", "line", "class", "name", "sig", F.lit(0).alias("variant"), "sql", F.col("binds").cast(binds).alias("binds"), F.lit(False).alias("capped"), F.lit("").alias("parameter_type"), F.coalesce("result", F.lit("")).alias("result_type"), no_props.alias("properties"))
    q = files.split_statements(sources.filter("kind = 'sql'")).join(sources.select("file_id", F.regexp_extract("path", r"([^/]*)$", 1).alias("class")), "file_id")
    slots = F.transform(F.array_distinct(F.regexp_extract_all("sql", F.lit(r":__b(\d+)"), F.lit(1))), lambda s: F.struct(s.cast("int").alias("slot"), F.concat(F.lit("?"), s).alias("expr"), F.concat(F.lit("?"), s).alias("root"), F.lit("").alias("path"), F.lit(False).alias("literal")))
    q = q.select("file_id", "line", "class", "name", none.alias("sig"), F.lit(0).alias("variant"), "sql", slots.cast(binds).alias("binds"), F.lit(False).alias("capped"), F.lit("").alias("parameter_type"), F.lit("").alias("result_type"), no_props.alias("properties"))
    return cut(x.select(names).unionByName(j.select(names)).unionByName(q.select(names)))


def index(spark: SparkSession, tree: str | DataFrame, catalog: DataFrame | None = None, packs: tuple = ()) -> Project:
    """The graph of a source tree: a path, or rows as files.source_files() gives them."""
    sources = cut(files.source_files(spark, tree) if isinstance(tree, str) else tree)
    java = java_flow.extract(sources.filter("kind = 'java'"), packs)
    classes, fields, methods = java["class"].dropDuplicates(["name"]), java["field"], java["method"].dropDuplicates(["sig"])
    statements = statements_of(sources, java)
    # Tables that statements create are known to the statements after them, whichever file these are in.
    found = catalog
    created = sql_lineage.lineage(statements.filter(F.lower("sql").rlike(r"^\s*create\b")).select(F.concat_ws("#", "class", "name").alias("id"), "sql"), catalog).filter("fact = 'created'")
    made = created.select(F.lit("").alias("schema"), F.col("target_table").alias("table"), F.col("target_column").alias("column"), F.monotonically_increasing_id().alias("o"))
    made = cut(made.withColumn("ordinal", F.row_number().over(Window.partitionBy("table").orderBy("o"))).drop("o"))
    if catalog is not None or made.limit(1).count():
        found = made if catalog is None else catalog.select("schema", "table", "column", "ordinal").unionByName(made)
    all_methods = methods.withColumn("synthetic", F.lit(False))
    matched = linking.match_statements(statements, all_methods)
    variants = cut(matched)
    one = cut(variants.filter("variant = 0"))
    facts = cut(sql_lineage.lineage(variants.select(F.concat("sig", F.lit("@v"), F.col("variant").cast("string")).alias("id"), "sql"), found))
    real = one.select("sig", F.col("class"), "name", "file_id", "line", "has_method", "formals", "result_node", "roots")
    own = real.filter("not has_method").select(
        "sig", "class", "name", F.col("roots").alias("param_names"), F.transform("roots", lambda r: F.lit("java.lang.Object")).alias("param_types"), F.lit(False).alias("has_this"), F.lit(False).alias("abstract"), F.lit(True).alias("synthetic"),
        F.col("formals"), F.col("result_node").alias("result"), "file_id", "line",
    )
    m = methods.join(real.filter("has_method").select("sig", "result_node"), "sig", "left")
    m = m.select(
        "sig", "class", "name", "param_names", "param_types", "has_this", F.col("abstract") & F.col("result_node").isNull().alias("abstract"), F.col("result_node").isNotNull().alias("synthetic"),
        F.transform("formal_in", lambda x: x.cast("string")).alias("formals"), F.coalesce("result_node", F.col("formal_out").cast("string")).alias("result"), "file_id", "line",
    ).toDF("sig", "class", "name", "param_names", "param_types", "has_this", "abstract", "synthetic", "formals", "result", "file_id", "line")
    m = m.unionByName(own)
    m = m.join(java["endpoint"].select("sig", F.lit(True).alias("handler")).distinct(), "sig", "left").withColumn("handler", F.coalesce("handler", F.lit(False)))
    m = cut(m.withColumn("formal_in", F.col("formals")))
    ancestors = cut(linking.supertypes(classes.select("name", "extends", "implements")))
    calls = cut(java["call"])
    targets = cut(linking.resolve_calls(calls, m, classes, fields, ancestors))
    pairs = cut(linking.argument_pairs(calls, targets, m))
    returns = targets.join(calls.select("sig", "ord", "actual_out"), ["sig", "ord"]).join(m.select(F.col("sig").alias("callee"), F.col("result").alias("out")), "callee")
    returns = cut(returns.filter("out is not null").select("sig", "ord", "callee", linking.local("actual_out").alias("result"), F.concat("callee", F.lit("|"), "out").alias("out"), "conf"))
    flows = linking.local_flows(java["node"], java["edge"])
    heap = linking.field_edges(java["access"], classes, fields)
    sql = linking.sql_edges(variants, facts).unionByName(linking.dto_binds(one, ancestors, fields))
    intra = cut(flows.unionByName(heap).unionByName(sql.filter(F.col("kind").isin(EDGE["LOCAL_FLOW"], EDGE["BIND_TO"], EDGE["LOAD"]))))
    summary = cut(linking.method_summaries(intra, pairs, returns, m))
    shared = linking.endpoint_edges(java["endpoint"], m)
    e = flows.unionByName(heap).unionByName(sql)
    e = e.unionByName(linking.edge(pairs, "ARG_IN", F.col("actual"), F.col("formal"), F.col("conf"))).unionByName(linking.edge(returns, "RET_OUT", F.col("out"), F.col("result"), F.col("conf")))
    e = e.unionByName(shared).unionByName(linking.unresolved_edges(calls, targets, m)).unionByName(linking.summary_edges(summary, pairs, returns))
    e = cut(e.filter("src <> dst"))
    inner = java["node"].filter(~F.col("kind").isin(NODE["LOCAL"], NODE["PREDICATE"]))
    nodes = inner.select(linking.local("lid").alias("key"), "kind", "name", "sig", "file_id", "line").unionByName(linking.sql_nodes(one))
    ends = e.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    globals_ = ends.filter(F.col("key").rlike("^[CFE]:")).union(java["endpoint"].select(F.concat(F.lit("E:"), "verb", F.lit(" "), "path"))).distinct()
    kind = F.when(F.col("key").startswith("C:"), NODE["COLUMN"]).when(F.col("key").startswith("F:"), NODE["FIELD"]).otherwise(NODE["ENDPOINT"])
    nodes = nodes.unionByName(globals_.select("key", kind.alias("kind"), F.substring("key", 3, 10_000).alias("name"), F.lit(None).cast("string").alias("sig"), F.lit(None).cast("int").alias("file_id"), F.lit(None).cast("int").alias("line")))
    nodes = cut(nodes.dropDuplicates(["key"]))
    rank = F.when(F.col("kind") == NODE["FORMAL_IN"], 0).when(F.col("kind") == NODE["FORMAL_OUT"], 1).when(F.col("kind").isin(NODE["ACTUAL_IN"], NODE["ACTUAL_OUT"]), 2).when(F.col("kind") == NODE["BIND"], 3).when(F.col("kind") == NODE["FIELD_STORE"], 4).when(F.col("kind") == NODE["FIELD_LOAD"], 5).otherwise(6)
    place = F.coalesce(F.regexp_extract("key", r"\|\D*(\d+)$", 1).try_cast("int"), F.lit(0))
    ids = cut(linking.dense_ids(nodes.select("key", "sig", rank.alias("rank"), place.alias("place"))))
    flags = m.select("sig", "synthetic", "handler")
    node = cut(nodes.join(ids, "key").join(flags, "sig", "left"))
    numbered = e.join(ids.select(F.col("key").alias("src"), F.col("gid").alias("s")), "src").join(ids.select(F.col("key").alias("dst"), F.col("gid").alias("d")), "dst")
    ordered = numbered.select("kind", F.col("s").alias("src"), F.col("d").alias("dst"), "conf", "clause", "flags", "masks", "derive", ((F.col("s") * 2_000_003 + F.col("d")) * 16 + F.col("kind")).alias("ord"))
    edges = cut(graph.dedup_edges(ordered))
    call_edge = cut(linking.call_graph(calls, targets, m))
    return Project(node, edges, m, call_edge, summary, cut(java["endpoint"]), cut(java["problem"]), cut(java["node"]), cut(java["edge"]))


TABLES = ("node", "edge", "method", "call_edge", "summary", "endpoint", "problem", "l2_node", "l2_edge")
VERSION = 1


def save(project: Project, path: str) -> None:
    """Writes a project: a table each, edges by kind and sorted by source, what is inside methods sorted by method, and the version."""
    spark = project.node.sparkSession
    for name in TABLES:
        df = getattr(project, name)
        if name == "edge":
            df.repartitionByRange("kind", "src").sortWithinPartitions("kind", "src", "ord").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edge")
        else:
            df = df.repartitionByRange("sig").sortWithinPartitions("sig") if name.startswith("l2_") else df
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = project.edge.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.lit(project.node.count()).alias("nodes"))
    counts.withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Project:
    """A project that save() wrote; another version is an error. Readers prune edges by kind, and methods by their ranges of sig."""
    found = [r.version for r in spark.read.parquet(f"{path}/meta").select("version").distinct().collect()]
    if found not in ([VERSION], []):
        raise ValueError(f"version {found} of {path} isn't {VERSION}")
    return Project(**{n: spark.read.parquet(f"{path}/{n}") for n in TABLES})


def memory_estimate(project: Project) -> DataFrame:
    """(nodes, edges, kinds, bytes): 17 bytes a node, 8 for each of its places in the offsets of every kind, 10 an edge."""
    n = project.node.agg(F.count(F.lit(1)).alias("nodes"))
    e = project.edge.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("kind").alias("kinds"))
    return n.join(F.broadcast(e)).withColumn("bytes", 17 * F.col("nodes") + 8 * (F.col("nodes") + 1) * F.col("kinds") + 10 * F.col("edges"))


# Lookups

def column_starts(project: Project, questions: DataFrame) -> DataFrame:
    """questions(query_id, column) to (query_id, v): `T.C` and `S.T.C`, upper-cased, with `T.*`; `T.*` is all columns of T."""
    key = F.upper(F.trim("column"))
    q = questions.select("query_id", F.regexp_replace(key, r"^[^:]*:", "").alias("wanted"))
    table = F.regexp_extract("wanted", r"^(.*)\.[^.]*$", 1)
    columns = project.node.filter(F.col("kind") == NODE["COLUMN"]).select("gid", F.upper("name").alias("name"))
    short = F.concat(F.element_at(F.split(F.regexp_extract("name", r"^(.*)\.[^.]*$", 1), r"\."), -1), F.lit("."), F.regexp_extract("name", r"([^.]*)$", 1))
    keys = columns.withColumn("key", F.explode(F.array_distinct(F.array("name", short))))
    wanted = q.withColumn("key", F.explode(F.array_distinct(F.array("wanted", F.concat(table, F.lit(".*"))))))
    exact = wanted.join(keys, "key").select("query_id", F.col("gid").alias("v"))
    whole = q.filter(F.col("wanted").endswith(".*")).select("query_id", table.alias("t"))
    inside = keys.withColumn("t", F.regexp_extract("key", r"^(.*)\.[^.]*$", 1))
    return exact.union(whole.join(inside, "t").select("query_id", F.col("gid").alias("v"))).distinct()


def endpoint_starts(project: Project, questions: DataFrame) -> DataFrame:
    """questions(query_id, endpoint, param) to (query_id, v): `VERB /path`, else any verb."""
    e = project.endpoint.withColumn("p", F.explode("params")).join(project.method.select("sig", "formals"), "sig")
    e = e.select("verb", "path", F.col("p.name").alias("param"), F.concat("sig", F.lit("|"), F.element_at("formals", F.col("p.formal") + 1)).alias("key"))
    q = questions.select("query_id", "param", F.trim("endpoint").alias("e"))
    q = q.withColumn("verb", F.when(F.col("e").contains(" "), F.split("e", " ")[0]).otherwise("*")).withColumn("path", F.element_at(F.split("e", " "), -1))
    found = q.join(e.withColumnRenamed("verb", "has"), ["path", "param"]).withColumn("same", F.col("verb") == F.col("has"))
    best = found.groupBy("query_id").agg(F.max("same").alias("any_same"))
    found = found.join(best, "query_id").filter("same or not any_same")
    return found.join(project.node.select("key", F.col("gid").alias("v")), "key").select("query_id", "v").distinct()


def method_starts(project: Project, questions: DataFrame) -> DataFrame:
    """questions(query_id, method) to (query_id, sig): full signature, `full.Class#name` or `Class#name`."""
    m = project.method.select("sig", F.concat_ws("#", "class", "name").alias("long"), F.concat_ws("#", F.element_at(F.split("class", r"\."), -1), "name").alias("short"))
    keys = m.select("sig", F.explode(F.array_distinct(F.array("sig", "long", "short"))).alias("method"))
    return questions.select("query_id", F.trim("method").alias("method")).join(keys, "method").select("query_id", "sig").distinct()


# Questions

def classified(nodes: DataFrame) -> DataFrame:
    """nodes with type and target; nodes that are no items are left out."""
    kind, shared = F.col("kind"), [("ENDPOINT", "ENDPOINT"), ("COLUMN", "COLUMN"), ("FIELD", "FIELD")]
    type_ = F.when(kind == NODE["BIND"], "SQL_BIND").when(kind == NODE["UNKNOWN"], "UNKNOWN")
    for k, t in shared:
        type_ = type_.when(kind == NODE[k], t)
    entry = (kind == NODE["FORMAL_IN"]) & F.coalesce("handler", F.lit(False))
    type_ = type_.when(F.col("sig").isNull(), None).when(entry, "ENDPOINT_INPUT").when(F.coalesce("synthetic", F.lit(False)), "SQL").otherwise("METHOD")
    target = F.when(F.col("sig").isNull(), F.col("name")).when(kind.isin(NODE["BIND"], NODE["UNKNOWN"]), F.concat_ws(" ", "sig", "name")).when(entry, F.concat("sig", F.lit(" ("), "name", F.lit(")"))).otherwise(F.col("sig"))
    return nodes.withColumn("type", type_).withColumn("target", target).filter("type is not null")


def _visits(project: Project, starts: DataFrame, reverse: bool, min_conf: int, implicit: bool, control: bool) -> DataFrame:
    seeds = starts.select(F.col("query_id").alias("start"), "v", F.row_number().over(Window.partitionBy("query_id").orderBy("v")).alias("ord"))
    of = lambda k: project.node.filter(F.col("kind") == NODE[k]).select(F.col("gid").alias("v"))
    return graph.first_visits(project.edge, seeds, reverse, min_conf, implicit, control, of("ENDPOINT"), of("COLUMN"))


def _items(project: Project, visits: DataFrame, side: int) -> DataFrame:
    known = classified(project.node).select(F.col("gid").alias("v"), "type", "target", "file_id", "line")
    return visits.filter("dist > 0").join(known, "v").select(F.col("start").alias("query_id"), "type", "target", F.col("dist").alias("distance"), "conf", F.col("flags").bitwiseAND(1).cast("boolean").alias("implicit"), F.col("flags").bitwiseAND(2).cast("boolean").alias("control"), (F.col("ord") * 2 + side).alias("ord"), F.lit(side).alias("side"), F.col("v").cast("long").alias("v"), "file_id", "line")


def _rolled(items: DataFrame) -> DataFrame:
    """One item per type and target: the least distance, first on ties; paths are numbered by first visit, MAX_PATHS at most."""
    by = F.struct("side", "ord")
    best = F.min_by(F.struct("distance", "conf", "implicit", "control", "v", "file_id", "line", "side"), F.struct("distance", "side", "ord")).alias("x")
    out = items.groupBy("query_id", "type", "target").agg(best, F.min(by).alias("seen"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "type", "target")) - 1
    return out.withColumn("n", n).select("query_id", "type", "target", "x.*", F.when((F.col("n") < MAX_PATHS) & (F.col("x.v") >= 0), F.col("n")).otherwise(-1).alias("path_id"))


def column_impact(project: Project, questions: DataFrame, min_conf: int = 2, implicit: bool = False, control: bool = False) -> DataFrame:
    """What columns affect and are affected by: both slices, and statements that refer to a column directly, at distance 1."""
    starts = cut(column_starts(project, questions))
    back, on = (_visits(project, starts, r, min_conf, implicit, control) for r in (True, False))
    items = _items(project, back, 0).unionByName(_items(project, on, 1))
    maps = project.edge.filter((F.col("kind") == EDGE["MAPS_TO"]) & (F.col("conf") <= min_conf))
    both = maps.select(F.col("src").alias("v"), F.col("dst").alias("w"), "conf", "flags").union(maps.select(F.col("dst"), F.col("src"), "conf", "flags"))
    direct = starts.join(both, "v").join(project.node.filter("sig is not null").select(F.col("gid").alias("w"), "sig", "file_id", "line"), "w")
    direct = direct.select("query_id", F.lit("SQL").alias("type"), F.col("sig").alias("target"), F.lit(1).alias("distance"), "conf", F.col("flags").bitwiseAND(1).cast("boolean").alias("implicit"), F.lit(False).alias("control"), F.col("w").alias("ord"), F.lit(2).alias("side"), F.lit(-1).cast("long").alias("v"), "file_id", "line")
    return _rolled(items.unionByName(direct))


def param_flow(project: Project, questions: DataFrame, min_conf: int = 2, implicit: bool = False, control: bool = False) -> DataFrame:
    """Where the values of endpoint parameters go."""
    starts = cut(endpoint_starts(project, questions))
    return _rolled(_items(project, _visits(project, starts, False, min_conf, implicit, control), 0))


def method_items(project: Project, questions: DataFrame, min_conf: int = 2) -> DataFrame:
    """Who calls methods, directly or not, and the endpoints behind them: (query_id, type, target, distance, conf, line)."""
    starts = cut(method_starts(project, questions))
    calls = project.call_edge.filter(F.col("conf") <= min_conf).select("caller", "callee", F.col("conf").alias("call_conf"), "line")
    seen = cut(starts.select("query_id", F.col("sig").alias("v"), F.lit(0).alias("distance"), F.lit(0).alias("conf"), F.lit(None).cast("int").alias("line")))
    new = seen
    while True:
        step = new.drop("line").join(calls, F.col("v") == F.col("callee")).select("query_id", F.col("caller").alias("v"), (F.col("distance") + 1).alias("distance"), F.greatest("conf", "call_conf").alias("conf"), "line")
        step = step.groupBy("query_id", "v").agg(F.min_by(F.struct("distance", "conf", "line"), F.struct("conf", "line")).alias("x")).select("query_id", "v", "x.*")
        new = cut(step.join(seen, ["query_id", "v"], "left_anti"))
        if new.limit(1).count() == 0:
            break
        seen = seen.unionByName(new)
    label = F.when(F.col("distance") == 1, "DIRECT_CALLER").otherwise("INDIRECT_CALLER")
    callers = seen.filter("distance > 0").select("query_id", label.alias("type"), F.col("v").alias("target"), "distance", "conf", "line")
    ends = project.endpoint.select(F.col("sig").alias("v"), F.concat_ws(" ", "verb", "path").alias("target"))
    reached = seen.join(ends, "v").select("query_id", F.lit("ENDPOINT").alias("type"), "target", (F.col("distance") + 1).alias("distance"), "conf", F.lit(None).cast("int").alias("line"))
    return callers.unionByName(reached.groupBy("query_id", "type", "target").agg(F.min("distance").alias("distance"), F.min("conf").alias("conf"), F.first("line").alias("line")))


def ordered(items: DataFrame) -> DataFrame:
    """By question, distance, type and target."""
    return items.orderBy("query_id", "distance", "type", "target")
