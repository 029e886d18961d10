"""The engine's operators over a typed property graph made from the star schema, each with equal SQL.

Ids: class * 100,000,000 + key, class 1 region, 2 nation, 3 customer, 4 order, 5 part, 6 supplier. Edges: customer to order
(LOCAL_FLOW, confidence by priority), order to part (ARG_IN, flags by return flag), order to supplier (RET_OUT, confidence by line status),
supplier to nation (MAPS_TO), nation to region (MAPS_TO in a comparing clause, so terminal), nation to customer (COL_DERIVES).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import graph, linking
from ..operators.ranks import nearest_ranks
from ..sources import catalog
from .tables import cut, small, table

ID = {"region": 100000000, "nation": 200000000, "customer": 300000000, "order": 400000000, "part": 500000000, "supplier": 600000000}


def _gid(kind: str, key: str):
    return F.col(key).cast("long") + F.lit(ID[kind])


def edges(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    z, one = F.lit(0), F.lit(1)

    def edge(kind, src, dst, conf=z, flags=z, clause=0, ord_=z):
        return [F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), conf.cast("int").alias("conf"), F.lit(clause).alias("clause"), flags.cast("int").alias("flags"), F.call_function("shiftleft", one, flags.cast("int")).alias("masks"), z.alias("derive"), ord_.cast("long").alias("ord")]

    priority = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    returned = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
    status = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    parts = [
        t("orders").select(*edge(1, _gid("customer", "o_custkey"), _gid("order", "o_orderkey"), priority, ord_=F.col("o_orderkey"))),
        t("lineitem").select(*edge(2, _gid("order", "l_orderkey"), _gid("part", "l_partkey"), z, returned, ord_=line)),
        t("lineitem").select(*edge(3, _gid("order", "l_orderkey"), _gid("supplier", "l_suppkey"), status, ord_=line)),
        t("supplier").select(*edge(8, _gid("supplier", "s_suppkey"), _gid("nation", "s_nationkey"), ord_=F.col("s_suppkey"))),
        t("nation").select(*edge(8, _gid("nation", "n_nationkey"), _gid("region", "n_regionkey"), clause=2, ord_=F.col("n_nationkey"))),
        t("customer").select(*edge(9, _gid("nation", "c_nationkey"), _gid("customer", "c_custkey"), ord_=F.col("c_custkey"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def arcs(spark: SparkSession, d: str, *kinds: int) -> DataFrame:
    """(kind, src, dst, terminal) of all kinds or those named, written once; traversals take a node once, so repeated edges stay."""
    e = edges(spark, d).filter(F.col("kind").isin(*kinds)) if kinds else edges(spark, d)
    return cut(e.select("kind", "src", "dst", (F.col("clause") > 0).alias("terminal")))


def _nations(spark, d):
    return table(spark, d, "nation").select(_gid("nation", "n_nationkey").alias("start"), _gid("nation", "n_nationkey").alias("v"))


def _regions(spark, d):
    return table(spark, d, "region").select(_gid("region", "r_regionkey").alias("start"), _gid("region", "r_regionkey").alias("v"))


E_SQL = """e AS (
  SELECT 1 AS kind, 300000000 + o_custkey AS src, 400000000 + o_orderkey AS dst, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS conf, 0 AS clause, 0 AS flags, o_orderkey AS ord FROM orders
  UNION ALL SELECT 2, 400000000 + l_orderkey, 500000000 + l_partkey, 0, 0, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END, l_orderkey * 8 + l_linenumber FROM lineitem
  UNION ALL SELECT 3, 400000000 + l_orderkey, 600000000 + l_suppkey, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, 0, 0, l_orderkey * 8 + l_linenumber FROM lineitem
  UNION ALL SELECT 8, 600000000 + s_suppkey, 200000000 + s_nationkey, 0, 0, 0, s_suppkey FROM supplier
  UNION ALL SELECT 8, 200000000 + n_nationkey, 100000000 + n_regionkey, 0, 2, 0, n_nationkey FROM nation
  UNION ALL SELECT 9, 200000000 + c_nationkey, 300000000 + c_custkey, 0, 0, 0, c_custkey FROM customer)"""
NATIONS = "SELECT 200000000 + n_nationkey AS s, 200000000 + n_nationkey AS v FROM nation"
REGIONS = "SELECT 100000000 + r_regionkey AS s, 100000000 + r_regionkey AS v FROM region"
QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("edge_dedup", f"WITH {E_SQL} SELECT kind, flags, clause, src, dst, min(conf) AS conf, bit_or(1 << flags) AS masks, min(ord) AS ord FROM e GROUP BY kind, flags, clause, src, dst")
def edge_dedup(spark, d):
    return graph.dedup_edges(edges(spark, d)).select("kind", "flags", "clause", "src", "dst", "conf", "masks", "ord")


def _masks(spark, d):
    return edges(spark, d).groupBy("kind", "src", "dst").agg(F.bit_or("masks").alias("masks"), F.min("conf").alias("conf"))


M_SQL = f"{E_SQL}, m AS (SELECT kind, src, dst, bit_or(1 << flags) AS masks, min(conf) AS conf FROM e GROUP BY kind, src, dst)"


@query(
    "minimal_masks",
    f"WITH {M_SQL} SELECT kind, src, dst, masks, CAST(CASE WHEN masks & 1 > 0 THEN 1 WHEN masks & 6 > 0 THEN masks & 6 ELSE masks & 8 END AS INTEGER) AS minimal FROM m",
)
def minimal_masks(spark, d):
    return _masks(spark, d).select("kind", "src", "dst", "masks", graph.minimal_masks(F.col("masks")).alias("minimal"))


def _usable(allowed):
    return lambda spark, d: _masks(spark, d).select("kind", "src", "dst", graph.usable_combo(F.col("masks"), allowed).alias("combo")).filter("combo is not null")


for _name, _allowed in (("none", 0), ("implicit", 1), ("control", 2), ("both", 3)):
    _when = " ".join(f"WHEN masks & {1 << k} > 0 THEN {k}" for k in range(4) if k & ~_allowed == 0)
    query(f"usable_combo_{_name}", f"WITH {M_SQL} SELECT * FROM (SELECT kind, src, dst, CASE {_when} END AS combo FROM m) WHERE combo IS NOT NULL")(_usable(_allowed))


@query("minconf_filter", f"WITH {E_SQL} SELECT kind, conf, count(*) AS n FROM e WHERE conf <= 1 AND kind IN (1, 2, 3) GROUP BY kind, conf")
def minconf_filter(spark, d):
    return graph.traversable(edges(spark, d), min_conf=1, control=True).filter(F.col("kind").isin(1, 2, 3)).groupBy("kind", "conf").agg(F.count(F.lit(1)).alias("n"))


def _slice_sql(seeds, one, two, src="src", dst="dst"):
    return f"""WITH RECURSIVE {E_SQL}, d AS (SELECT DISTINCT kind, {src} AS a, {dst} AS b FROM e),
a1 AS ({seeds} UNION SELECT a1.s, d.b FROM a1 JOIN d ON a1.v = d.a WHERE kind IN (1, 8, 9, {one})),
a2 AS (SELECT s, v FROM a1 UNION SELECT a2.s, d.b FROM a2 JOIN d ON a2.v = d.a WHERE kind IN (1, 8, 9, {two}))
"""


@query("slice_forward", _slice_sql(NATIONS, 3, 2) + "SELECT s AS start, v, CASE WHEN (s, v) IN (SELECT (s, v) FROM a1) THEN 1 ELSE 2 END AS phase FROM a2")
def slice_forward(spark, d):
    return graph.two_phase(arcs(spark, d).drop("terminal"), _nations(spark, d)).select("start", "v", "phase")


@query("slice_reverse", _slice_sql(REGIONS, 2, 3, "dst", "src") + "SELECT s AS start, v, CASE WHEN (s, v) IN (SELECT (s, v) FROM a1) THEN 1 ELSE 2 END AS phase FROM a2")
def slice_reverse(spark, d):
    return graph.two_phase(arcs(spark, d).drop("terminal"), _regions(spark, d), reverse=True).select("start", "v", "phase")


@query(
    "slice_hops",
    f"""WITH RECURSIVE {E_SQL}, d AS (SELECT DISTINCT kind, dst AS a, src AS b FROM e),
h AS (SELECT s, v, 0 AS hop FROM ({REGIONS}) UNION SELECT h.s, d.b, h.hop + 1 FROM h JOIN d ON h.v = d.a WHERE kind IN (1, 2, 8, 9) AND hop < 12)
SELECT s AS start, v, min(hop) AS hop FROM h GROUP BY s, v""",
)
def slice_hops(spark, d):
    back = graph.flip(arcs(spark, d, 1, 2, 8, 9).drop("terminal"))
    return graph.reach(back, _regions(spark, d)).select("start", "v", "hop")


@query(
    "slice_terminal",
    f"""WITH RECURSIVE {E_SQL}, d AS (SELECT src AS a, dst AS b, max(clause) > 0 AS t FROM e WHERE kind IN (3, 8) GROUP BY kind, src, dst),
h AS (SELECT 400000000 + o_orderkey AS s, 400000000 + o_orderkey AS v, false AS t FROM orders UNION SELECT h.s, d.b, d.t FROM h JOIN d ON h.v = d.a WHERE NOT h.t)
SELECT s AS start, v, bool_and(t) AS terminal FROM h GROUP BY s, v""",
)
def slice_terminal(spark, d):
    starts = table(spark, d, "orders").select(_gid("order", "o_orderkey").alias("start"), _gid("order", "o_orderkey").alias("v"))
    return graph.reach(arcs(spark, d, 3, 8).select("src", "dst", "terminal"), starts).select("start", "v", "terminal")


def _kind_of(v="v"):
    return F.element_at(F.array(*map(F.lit, ("region", "nation", "customer", "order", "part", "supplier"))), F.floor(F.col(v) / 100000000).cast("int"))


@query(
    "batched_impact",
    _slice_sql(REGIONS, 2, 3, "dst", "src")
    + "SELECT s AS start, ['region', 'nation', 'customer', 'order', 'part', 'supplier'][CAST(v // 100000000 AS INTEGER)] AS type, count(*) AS n, count(*) FILTER (WHERE (s, v) NOT IN (SELECT (s, v) FROM a1)) AS second_phase FROM a2 GROUP BY ALL",
)
def batched_impact(spark, d):
    found = graph.two_phase(arcs(spark, d).drop("terminal"), _regions(spark, d), reverse=True)
    return found.groupBy("start", _kind_of().alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phase") == 2).alias("second_phase"))


@query(
    "bottleneck_conf",
    f"""WITH RECURSIVE {E_SQL}, c AS (SELECT unnest([0, 1, 2]) AS c), d AS (SELECT src AS a, dst AS b, min(conf) AS conf FROM e WHERE kind IN (1, 3, 8, 9) GROUP BY kind, src, dst),
h AS (SELECT s, v, c FROM ({NATIONS}), c UNION SELECT h.s, d.b, h.c FROM h JOIN d ON h.v = d.a AND d.conf <= h.c)
SELECT s AS start, v, min(c) AS conf FROM h GROUP BY s, v""",
)
def bottleneck_conf(spark, d):
    steps = cut(edges(spark, d).filter(F.col("kind").isin(1, 3, 8, 9)).select("src", "dst", "conf"))
    return graph.bottleneck(steps, _nations(spark, d))


@query(
    "flag_reach",
    f"""WITH RECURSIVE {E_SQL}, d AS (SELECT DISTINCT src AS a, dst AS b, flags AS f FROM e WHERE kind IN (1, 2)),
h AS (SELECT 300000000 + c_custkey AS s, 300000000 + c_custkey AS v, 0 AS fl FROM customer UNION SELECT h.s, d.b, h.fl | d.f FROM h JOIN d ON h.v = d.a)
SELECT s AS start, v, bit_or(1 << fl) AS combos FROM h GROUP BY s, v""",
)
def flag_reach(spark, d):
    starts = table(spark, d, "customer").select(_gid("customer", "c_custkey").alias("start"), _gid("customer", "c_custkey").alias("v"))
    steps = cut(edges(spark, d).filter(F.col("kind").isin(1, 2)).select("src", "dst", "flags"))
    return graph.flag_sets(steps, starts)


@query(
    "method_impact",
    f"""WITH RECURSIVE {E_SQL}, d AS (SELECT DISTINCT src, dst FROM e WHERE kind IN (1, 2)),
h AS (SELECT 500000000 + p_partkey AS s, 500000000 + p_partkey AS v, 0 AS dist FROM part UNION SELECT h.s, d.src, h.dist + 1 FROM h JOIN d ON h.v = d.dst)
SELECT s AS target, v, min(dist) AS dist, CASE WHEN min(dist) = 1 THEN 'DIRECT_CALLER' ELSE 'INDIRECT_CALLER' END AS type FROM h WHERE dist > 0 GROUP BY s, v""",
)
def method_impact(spark, d):
    calls = arcs(spark, d, 1, 2).select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.lit(0).alias("call_conf"))
    found = graph.callers(calls, table(spark, d, "part").select(_gid("part", "p_partkey").alias("v")))
    return found.select("target", "v", "dist", F.when(F.col("dist") == 1, "DIRECT_CALLER").otherwise("INDIRECT_CALLER").alias("type"))


@query("endpoints_of", f"WITH {E_SQL} SELECT src AS method, dst AS endpoint FROM e WHERE kind = 3 UNION SELECT dst, src FROM e WHERE kind = 2")
def endpoints_of(spark, d):
    e = edges(spark, d)
    out = e.filter("kind = 3").select(F.col("src").alias("method"), F.col("dst").alias("endpoint"))
    return out.union(e.filter("kind = 2").select("dst", "src")).distinct()


@query(
    "fwd_bwd_intersection",
    f"""WITH RECURSIVE {E_SQL}, d AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE kind IN (1, 3, 8) AND clause = 0),
f AS (SELECT 300000000 + c_custkey AS v FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT d.b FROM f JOIN d ON f.v = d.a),
b AS (SELECT 200000000 + n_nationkey AS v FROM nation WHERE n_regionkey = 1 UNION SELECT d.a FROM b JOIN d ON b.v = d.b)
SELECT v FROM f INTERSECT SELECT v FROM b""",
)
def fwd_bwd_intersection(spark, d):
    e = arcs(spark, d, 1, 3, 8).filter(~F.col("terminal")).select("src", "dst")
    one = F.lit(0).alias("start")
    f = graph.reach(e, table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(one, _gid("customer", "c_custkey").alias("v")))
    b = graph.reach(graph.flip(e), table(spark, d, "nation").filter("n_regionkey = 1").select(one, _gid("nation", "n_nationkey").alias("v")))
    return f.select("v").join(b.select("v"), "v", "left_semi")


@query(
    "csr_offsets",
    f"""WITH {E_SQL}, n AS (SELECT 300000000 + c_custkey AS gid FROM customer), k AS (SELECT src AS gid, count(*) AS n FROM e WHERE kind = 1 GROUP BY src)
SELECT gid, coalesce(k.n, 0) AS n, CAST(sum(coalesce(k.n, 0)) OVER (ORDER BY gid) - coalesce(k.n, 0) AS BIGINT) AS off FROM n LEFT JOIN k USING (gid)""",
)
def csr_offsets(spark, d):
    return graph.offsets(edges(spark, d).filter("kind = 1"), table(spark, d, "customer").select(_gid("customer", "c_custkey").alias("gid")))


@query("degree_stats", f"WITH {E_SQL} SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, 17 * count(DISTINCT src) + 10 * count(*) AS bytes FROM e GROUP BY kind")
def degree_stats(spark, d):
    g = edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))
    return g.withColumn("bytes", 17 * F.col("sources") + 10 * F.col("edges"))


@query(
    "dense_ids",
    "WITH k AS (SELECT 1 AS c, r_regionkey AS key FROM region UNION ALL SELECT 2, n_nationkey FROM nation UNION ALL SELECT 3, c_custkey FROM customer UNION ALL SELECT 6, s_suppkey FROM supplier) SELECT c * 100000000 + key AS gid, row_number() OVER (ORDER BY c, key) - 1 AS id FROM k",
)
def dense_ids(spark, d):
    kinds = (("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"))
    nodes = None
    for t, k, c in kinds:
        x = table(spark, d, t).select(_gid(k, c).cast("string").alias("key"), F.lit(str(ID[k])).alias("sig"), F.lit(0).alias("rank"), F.col(c).cast("long").alias("place"))
        nodes = x if nodes is None else nodes.union(x)
    return linking.dense_ids(nodes).select(F.col("key").cast("long").alias("gid"), F.col("gid").alias("id"))


@query(
    "arg_pairs",
    "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, CAST(i AS INTEGER) AS arg, CAST(least(i, length(o_orderpriority) - 4) AS INTEGER) AS param FROM orders JOIN n ON o_orderkey = l_orderkey, unnest(range(1, n + 1)) AS t(i)",
)
def arg_pairs(spark, d):
    """Orders as calls of a method per priority, with as many parameters as its name is long, less four; lines as arguments."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    lines = l.groupBy(F.col("l_orderkey").alias("sig")).agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("actual_in", F.sequence(F.lit(1), F.col("n")))
    calls = lines.select(F.col("sig").cast("string").alias("sig"), F.lit(0).alias("ord"), "actual_in", F.lit(False).alias("has_receiver"))
    targets = o.select(F.col("o_orderkey").cast("string").alias("sig"), F.lit(0).alias("ord"), F.col("o_orderpriority").alias("callee"), F.lit(0).alias("conf"))
    methods = o.select(F.col("o_orderpriority").alias("sig")).distinct().withColumn("formals", F.transform(F.sequence(F.lit(1), F.length("sig") - 4), lambda i: i.cast("string"))).withColumn("has_this", F.lit(False))
    end = lambda c: F.substring_index(c, "|", -1).cast("int")
    return linking.argument_pairs(calls, targets, methods).select(F.col("sig").cast("long").alias("o_orderkey"), end("actual").alias("arg"), end("formal").alias("param"))


@query(
    "di_resolution",
    """WITH c AS (SELECT n_nationkey AS n, s_suppkey AS s, s_acctbal > 0 AS bean, s_suppkey % 5 = n_regionkey AS named FROM nation JOIN supplier ON s_nationkey = n_nationkey),
f AS (SELECT *, bool_or(bean) OVER (PARTITION BY n) AS any_bean FROM c), b AS (SELECT *, bool_or(named AND any_bean AND bean) OVER (PARTITION BY n) AS any_named FROM f WHERE bean OR NOT any_bean),
k AS (SELECT * FROM b WHERE NOT any_named OR named)
SELECT n AS receiver, s AS target, CASE WHEN count(*) OVER (PARTITION BY n) = 1 THEN 1 ELSE 2 END AS conf FROM k""",
)
def di_resolution(spark, d):
    """Nations as interfaces with an injected field each, suppliers as classes that implement them; those in the black are beans."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    iface, impl = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    none = F.array().cast("array<string>")
    classes = n.select(iface.alias("name"), F.lit("interface").alias("kind"), F.lit("").alias("extends"), none.alias("implements"), F.lit(False).alias("bean"), F.lit("").alias("bean_name"))
    own = s.select(impl.alias("name"), F.lit("class").alias("kind"), F.lit("").alias("extends"), F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("implements"), (F.col("s_acctbal") > 0).alias("bean"), F.concat(F.lit("q"), (F.col("s_suppkey") % 5).cast("string")).alias("bean_name"))
    classes = cut(classes.unionByName(own))
    method = lambda x, abstract: x.select(F.concat("name", F.lit("#go()")).alias("sig"), F.col("name").alias("class"), F.lit("go").alias("name"), F.lit(abstract).alias("abstract"), F.lit(False).alias("synthetic"), F.array(F.lit("0")).alias("formal_in"))
    methods = method(classes.filter("kind = 'class'"), False).unionByName(method(classes.filter("kind = 'interface'"), True))
    fields = n.select(F.lit("user").alias("class"), iface.alias("name"), F.lit(True).alias("injected"), F.concat(F.lit("q"), F.col("n_regionkey").cast("string")).alias("qualifier"))
    calls = n.select(iface.alias("sig"), F.lit(0).alias("ord"), F.array(F.concat(iface, F.lit("#go()"))).alias("candidates"), F.lit(0).alias("conf"), F.lit("go").alias("name"), iface.alias("receiver_type"), F.lit("VIRTUAL").alias("kind"), F.concat(F.lit("user."), iface).alias("field"), F.array(F.lit(0)).alias("actual_in"))
    found = linking.resolve_calls(calls, methods, classes, fields, linking.supertypes(classes.select("name", "extends", "implements")))
    number = lambda c: F.regexp_extract(c, r"^[ns](\d+)", 1).cast("int")
    return found.filter(F.col("callee").startswith("s")).select(number("sig").alias("receiver"), number("callee").cast("long").alias("target"), "conf")


@query(
    "catalog_resolve",
    """WITH t AS (SELECT DISTINCT 'D' || (c_nationkey % 3) AS ds, 'S' || c_nationkey AS sc, c_mktsegment AS tab FROM customer),
p AS (SELECT p_partkey AS ref, 'D' || (p_size % 3) AS data_source, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'S' || p_size END AS schema, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD', 'NONE'][CAST(p_partkey % 6 AS INTEGER) + 1] AS tab FROM part),
j AS (SELECT p.*, ds, sc, ds = data_source AND sc = schema AS a, ds = data_source AND (sc = schema OR schema = '') AS b, sc = schema AND schema <> '' AS c, schema = '' AND ds IS NOT NULL AS d FROM p LEFT JOIN t USING (tab)),
g AS (SELECT ref, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE b) AS nb, count(*) FILTER (WHERE c) AS nc, count(*) FILTER (WHERE d) AS nd, max(ds || '.' || sc) FILTER (WHERE a) AS ha, max(ds || '.' || sc) FILTER (WHERE b) AS hb, max(ds || '.' || sc) FILTER (WHERE c) AS hc, max(ds || '.' || sc) FILTER (WHERE d) AS hd FROM j GROUP BY ref)
SELECT ref, CASE WHEN na = 1 THEN 1 WHEN nb = 1 THEN 2 WHEN nc = 1 THEN 3 WHEN nd = 1 THEN 4 END AS step, CASE WHEN na = 1 THEN ha WHEN nb = 1 THEN hb WHEN nc = 1 THEN hc WHEN nd = 1 THEN hd END AS hit FROM g""",
)
def catalog_resolve(spark, d):
    c = table(spark, d, "customer")
    tables = c.select(F.concat(F.lit("D"), (F.col("c_nationkey") % 3).cast("string")).alias("data_source"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("schema"), F.col("c_mktsegment").alias("table"))
    segments = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD", "NONE")))
    schema = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("S"), F.col("p_size").cast("string")))
    refs = table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.concat(F.lit("D"), (F.col("p_size") % 3).cast("string")).alias("data_source"), schema.alias("schema"), F.element_at(segments, (F.col("p_partkey") % 6 + 1).cast("int")).alias("table"))
    return catalog.resolve(refs, tables).select("ref", "step", F.concat_ws(".", "ds", "sc").alias("hit")).withColumn("hit", F.when(F.col("step").isNotNull(), F.col("hit")))


@query(
    "flow_edge_list",
    f"""WITH {E_SQL}, n AS (SELECT 600000000 + s_suppkey AS gid, s_name AS name FROM supplier UNION ALL SELECT 200000000 + n_nationkey, n_name FROM nation UNION ALL SELECT 100000000 + r_regionkey, r_name FROM region UNION ALL SELECT 300000000 + c_custkey, c_name FROM customer)
SELECT a.name AS from_name, b.name AS to_name, ['LOCAL_FLOW', 'ARG_IN', 'RET_OUT', 'SUMMARY', 'STORE', 'LOAD', 'BIND_TO', 'MAPS_TO', 'COL_DERIVES'][kind] AS kind, conf FROM e JOIN n a ON a.gid = src JOIN n b ON b.gid = dst""",
)
def flow_edge_list(spark, d):
    n = None
    for t, k, key, name in (("supplier", "supplier", "s_suppkey", "s_name"), ("nation", "nation", "n_nationkey", "n_name"), ("region", "region", "r_regionkey", "r_name"), ("customer", "customer", "c_custkey", "c_name")):
        x = table(spark, d, t).select(_gid(k, key).alias("gid"), F.col(name).alias("name"))
        n = x if n is None else n.union(x)
    kinds = F.array(*map(F.lit, ("LOCAL_FLOW", "ARG_IN", "RET_OUT", "SUMMARY", "STORE", "LOAD", "BIND_TO", "MAPS_TO", "COL_DERIVES")))
    a, b = n.select(F.col("gid").alias("src"), F.col("name").alias("from_name")), n.select(F.col("gid").alias("dst"), F.col("name").alias("to_name"))
    return edges(spark, d).filter(F.col("kind").isin(8, 9)).join(a, "src").join(b, "dst").select("from_name", "to_name", F.element_at(kinds, F.col("kind")).alias("kind"), "conf")


@query("impact_tiles", f"WITH {E_SQL} SELECT kind, count(*) AS n, count(*) FILTER (WHERE conf = 0) AS exact, count(*) FILTER (WHERE conf = 2) AS heuristic, count(*) FILTER (WHERE flags & 1 > 0) AS implicit, count(*) FILTER (WHERE flags & 2 > 0) AS control FROM e GROUP BY kind")
def impact_tiles(spark, d):
    has = lambda bit: F.count_if(F.col("flags").bitwiseAND(bit) > 0)
    return edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("conf") == 0).alias("exact"), F.count_if(F.col("conf") == 2).alias("heuristic"), has(1).alias("implicit"), has(2).alias("control"))


@query(
    "recall_precision",
    """WITH x AS (SELECT source, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fp FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, tp, fn, fp, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS recall, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS precision FROM x""",
)
def recall_precision(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    low, tox = F.col("quality") == 0, F.col("toxic") == 1
    x = j.groupBy("source").agg(F.count_if(low & tox).alias("tp"), F.count_if(low & ~tox).alias("fn"), F.count_if(~low & tox).alias("fp"))
    rate = lambda other: F.when(F.col("tp") + F.col(other) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(other)))
    return x.select("source", "tp", "fn", "fp", rate("fn").alias("recall"), rate("fp").alias("precision"))


@query(
    "latency_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (WHERE i = n // 2 + 1) AS p50, max(value) FILTER (WHERE i = CAST(ceil(n * 0.95::DOUBLE) AS BIGINT)) AS p95, max(value) FILTER (WHERE i = CAST(ceil(n * 0.99::DOUBLE) AS BIGINT)) AS p99, max(value) AS most FROM r GROUP BY event_type""",
)
def latency_percentiles(spark, d):
    """Nearest rank: the upper median, and place ceil(n * p)."""
    return nearest_ranks(table(spark, d, "events"), "event_type", "value", {"p50": lambda n: F.floor(n / 2) + 1, "p95": lambda n: F.ceil(n * F.lit(0.95)), "p99": lambda n: F.ceil(n * F.lit(0.99))})


@query(
    "line_of_offset",
    "WITH x AS (SELECT doc_id, substr(text, 1, CAST(length(text) // 2 AS BIGINT)) AS p FROM documents) SELECT doc_id, CAST(1 + length(p) - length(replace(p, chr(10), '')) AS INTEGER) AS line, CAST(strlen(p) AS INTEGER) AS bytes FROM x",
)
def line_of_offset(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, d, "documents").select("doc_id", names.line_of(F.col("text"), half).alias("line"), names.bytes_before(F.col("text"), half).alias("bytes"))


@query(
    "bind_slots",
    """WITH s AS (SELECT c_custkey, 'select * from t where a = #{p.' || lower(c_mktsegment) || ',jdbcType=VARCHAR} and b = #{key' || c_nationkey || '}' AS q FROM customer), b AS (SELECT c_custkey, regexp_extract_all(q, '#\\{\\s*([A-Za-z0-9_.]+)[^}]*\\}', 1) AS n FROM s)
SELECT c_custkey, CAST(i - 1 AS INTEGER) AS slot, n[i] AS name FROM b, unnest(range(1, len(n) + 1)) AS t(i)""",
)
def bind_slots(spark, d):
    sql = F.concat(F.lit("select * from t where a = #{p."), F.lower("c_mktsegment"), F.lit(",jdbcType=VARCHAR} and b = #{key"), F.col("c_nationkey").cast("string"), F.lit("}"))
    return table(spark, d, "customer").select("c_custkey", F.posexplode(names.binds(sql)).alias("slot", "name"))


@query("ident_normalise", """SELECT p_partkey, upper(trim(p_name)) AS plain, p_name AS quoted FROM part""")
def ident_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", names.normalise(F.col("p_name")).alias("plain"), names.normalise(F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))).alias("quoted"))


@query(
    "snake_to_camel",
    "WITH x AS (SELECT p_partkey, string_split(lower(replace(p_type, ' ', '_')), '_') AS w FROM part) SELECT p_partkey, array_to_string([CASE WHEN i = 1 THEN w[i] ELSE upper(w[i][1:1]) || w[i][2:] END FOR i IN range(1, len(w) + 1)], '') AS camel FROM x",
)
def snake_to_camel(spark, d):
    return table(spark, d, "part").select("p_partkey", names.camel(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("camel"))


@query("concat_path", "WITH x AS (SELECT page_id, regexp_replace(regexp_replace('/' || 'api//' || '/' || url || '/', '/+', '/', 'g'), '/$', '') AS p FROM pages) SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM x")
def concat_path(spark, d):
    return table(spark, d, "pages").select("page_id", names.concat_path(F.lit("api//"), F.col("url"), F.lit("")).alias("path"))


@query("xml_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def xml_tags(spark, d):
    return table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("prefix_lookup", "SELECT p_brand, p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')")
def prefix_lookup(spark, d):
    return table(spark, d, "part").filter(F.col("p_brand").startswith("Brand#1")).select("p_brand", "p_partkey")


@query(
    "statement_split",
    "WITH s AS (SELECT conv_id, turn, string_split(text, '.') AS p FROM conversations), x AS (SELECT conv_id, turn, i, trim(p[i], ' ') AS stmt FROM s, unnest(range(1, len(p) + 1)) AS t(i)) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n, stmt FROM x WHERE stmt <> ''",
)
def statement_split(spark, d):
    parts = F.filter(F.transform(F.split("text", r"\."), lambda s: F.trim(s)), lambda s: s != "")
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("n", "stmt")).withColumn("n", (F.col("n") + 1).cast("long"))


@query(
    "event_call_graph",
    "WITH x AS (SELECT event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events) SELECT caller, callee, count(*) AS n FROM x WHERE callee IS NOT NULL GROUP BY ALL",
)
def event_call_graph(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").select(F.col("event_type").alias("caller"), F.lead("event_type").over(w).alias("callee"))
    return x.filter("callee is not null").groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n"))
