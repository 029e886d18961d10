"""The sample project end to end: graph, questions, paths, conditions, flow graphs, saving and loading."""

import pytest
from pyspark.sql import functions as F

from tracelake.plans import flowgraph, impact, sample
from tracelake.schema import EDGE, EDGE_KINDS


@pytest.fixture(scope="module")
def project(spark):
    return impact.index(spark, sample.sources(spark))


def found(df, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


BOOK, DESK, ROWS = "shop.PaperBook", "shop.TicketDesk", "shop.TicketRows"
OPEN, HOLDER = f"{DESK}#open(java.lang.String,int)", f"{DESK}#holder(java.lang.String)"


def items(df):
    return found(df, "query_id", "type", "target")


def test_summaries_and_edges(project):
    e = project.edge.join(project.node.select(F.col("gid").alias("src"), F.col("key").alias("a")), "src").join(project.node.select(F.col("gid").alias("dst"), F.col("key").alias("b")), "dst")
    names = project.node.select("key", "name", "sig")
    e = e.join(names.select(F.col("key").alias("a"), F.col("name").alias("from")), "a").join(names.select(F.col("key").alias("b"), F.col("name").alias("to"), F.col("sig").alias("m")), "b")
    rows = {(EDGE_KINDS[r.kind], r["from"], r["to"], r.masks) for r in e.collect()}
    assert ("SUMMARY", "clean(·)[0]", "clean() result", 1) in rows  # through the recursion
    assert not any(k == "SUMMARY" and a == "clean(·)[1]" and m & 1 for k, a, _, m in rows)  # n decides only
    assert ("SUMMARY", "find(·)[0]", "find() result", 2) in rows  # as a filter
    assert {("STORE", "store Ticket.holder", "shop.Ticket.holder", 0), ("LOAD", "shop.Ticket.holder", "#{holder}", 0), ("MAPS_TO", "#{holder}", "TICKET.HOLDER", 0), ("COL_DERIVES", "TICKET.HOLDER", "ARCHIVE.NAME", 0)} <= rows
    ids = sorted(r.gid for r in project.node.select("gid").collect())
    assert ids == list(range(len(ids)))


def test_column_impact(spark, project):
    q = spark.createDataFrame([("h", "ticket.holder"), ("c", "TICKET.CODE"), ("n", "NONE.X")], "query_id string, column string")
    assert items(impact.column_impact(project, q)) == {
        ("h", "SQL", f"{ROWS}#insert(shop.Ticket)"), ("h", "SQL_BIND", f"{ROWS}#insert(shop.Ticket) #{{holder}}"), ("h", "FIELD", "shop.Ticket.holder"), ("h", "METHOD", "shop.Ticket#setHolder(java.lang.String)"),
        ("h", "METHOD", f"{BOOK}#save(shop.Ticket)"), ("h", "METHOD", OPEN), ("h", "ENDPOINT_INPUT", f"{OPEN} (holder)"), ("h", "ENDPOINT", "POST /desk/tickets"),
        ("h", "SQL", f"{ROWS}#find(java.lang.String)"), ("h", "METHOD", f"{BOOK}#holderOf(java.lang.String)"), ("h", "METHOD", HOLDER), ("h", "ENDPOINT", "GET /desk/holder"),
        ("h", "COLUMN", "ARCHIVE.NAME"), ("h", "SQL", "night.sql#stmt1@L1()"),
        ("c", "SQL", f"{ROWS}#find(java.lang.String)"), ("c", "SQL_BIND", f"{ROWS}#find(java.lang.String) #{{code}}"), ("c", "METHOD", f"{BOOK}#holderOf(java.lang.String)"), ("c", "METHOD", f"{BOOK}#clean(java.lang.String,int)"),
        ("c", "ENDPOINT_INPUT", f"{HOLDER} (code)"), ("c", "METHOD", HOLDER), ("c", "ENDPOINT", "GET /desk/holder"),
    }
    sure = items(impact.column_impact(project, q.filter("query_id = 'c'"), min_conf=0))
    assert sure == {("c", "SQL", f"{ROWS}#find(java.lang.String)"), ("c", "SQL_BIND", f"{ROWS}#find(java.lang.String) #{{code}}")}


def test_param_flow_and_options(spark, project):
    q = spark.createDataFrame([("a", "POST /desk/tickets", "seat"), ("b", "/desk/holder", "code"), ("c", "PUT /desk/holder", "code"), ("d", "GET /none", "x")], "query_id string, endpoint string, param string")
    plain = items(impact.param_flow(project, q))
    assert not any(x[0] in "ad" for x in plain)  # seat only decides
    b = {("METHOD", HOLDER), ("METHOD", f"{BOOK}#holderOf(java.lang.String)"), ("METHOD", f"{BOOK}#clean(java.lang.String,int)"), ("SQL", f"{ROWS}#find(java.lang.String)"), ("SQL_BIND", f"{ROWS}#find(java.lang.String) #{{code}}"), ("COLUMN", "TICKET.CODE")}
    assert {x[1:] for x in plain if x[0] == "b"} == b == {x[1:] for x in plain if x[0] == "c"}  # an unknown verb is any
    assert {("b", "ENDPOINT", "GET /desk/holder"), ("a", "ENDPOINT", "POST /desk/tickets")} <= items(impact.param_flow(project, q, implicit=True, control=True))


def test_method_items(spark, project):
    q = spark.createDataFrame([("s", "TicketBook#save"), ("c", f"{BOOK}#clean"), ("e", OPEN)], "query_id string, method string")
    rows = found(impact.ordered(impact.method_items(project, q)), "query_id", "type", "target", "distance")
    assert rows == {
        ("s", "DIRECT_CALLER", OPEN, 1), ("s", "ENDPOINT", "POST /desk/tickets", 2), ("c", "DIRECT_CALLER", f"{BOOK}#holderOf(java.lang.String)", 1), ("c", "INDIRECT_CALLER", HOLDER, 2), ("c", "ENDPOINT", "GET /desk/holder", 3), ("e", "ENDPOINT", "POST /desk/tickets", 1),
    }


def test_paths_conditions_and_flow_graphs(spark, project):
    q = spark.createDataFrame([("b", "GET /desk/holder", "code")], "query_id string, endpoint string, param string")
    starts = impact.endpoint_starts(project, q)
    visits = impact._visits(project, starts, False, 2, False, False)
    rows = impact.param_flow(project, q)
    steps = flowgraph.paths(visits, rows.filter("type = 'COLUMN'")).join(project.node.select(F.col("gid").alias("v"), "name"), "v").orderBy("seq").collect()
    assert [r.name for r in steps] == ["code", "holderOf(·)[0]", "code", "clean(·)[0]", "clean() result", "find(·)[0]", "code", "#{code}", "TICKET.CODE"] and steps[-1].via == EDGE["MAPS_TO"]
    traced = flowgraph.traced_edges(graph_edges(project), visits)
    assert traced.count() >= visits.count() - 1
    summary = project.edge.filter(F.col("kind") == EDGE["SUMMARY"]).join(project.node.filter("name = 'clean(·)[0]'").select(F.col("gid").alias("src")), "src")
    inner = flowgraph.expanded_calls(project, summary)
    assert {EDGE_KINDS[r.kind] for r in inner.collect()} == {"ARG_IN", "RET_OUT", "LOCAL_FLOW", "SUMMARY"}
    nodes = project.l2_node.filter(F.col("sig") == OPEN)
    asked = nodes.filter("name = 'reject(·)[0]'").select("sig", "lid")
    assert [r.conditions for r in flowgraph.conditions(project.l2_node, project.l2_edge, asked).collect()] == ["seat > 100 [TRUE]"]
    ends = {r.name: r.lid for r in nodes.collect()}
    asked = spark.createDataFrame([(OPEN, ends["holder"], ends["setHolder(·)[0]"])], "sig string, a int, b int")
    assert [r.lid for r in flowgraph.inner_paths(project.l2_edge, asked).orderBy("seq").collect()] == [ends["holder"], ends["trim() result"], ends["setHolder(·)[0]"]]
    assert flowgraph.inner_edges(project.l2_edge, asked).count() == 2
    q = spark.createDataFrame([("c", f"{BOOK}#clean")], "query_id string, method string")
    calls = flowgraph.call_graph(project, q, impact.method_items(project, q))
    assert {(r.caller, r.callee) for r in calls.collect()} == {(f"{BOOK}#holderOf(java.lang.String)", f"{BOOK}#clean(java.lang.String,int)"), (HOLDER, f"{BOOK}#holderOf(java.lang.String)")}


def graph_edges(project):
    from tracelake.operators import graph

    return graph.traversable(project.edge, implicit=False)


def test_components(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a")], "caller string, callee string")
    assert found(flowgraph.components(calls), "method", "component") == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f"), ("g", "g")}


def test_save_and_load(spark, project, tmp_path):
    impact.save(project, str(tmp_path / "p"))
    again = impact.load(spark, str(tmp_path / "p"))
    q = spark.createDataFrame([("e", OPEN)], "query_id string, method string")
    assert items(impact.method_items(again, q)) == items(impact.method_items(project, q))
    assert again.edge.filter("kind = 2").count() == project.edge.filter("kind = 2").count()
    n = impact.memory_estimate(again).first()
    assert n.bytes == 17 * n.nodes + 8 * (n.nodes + 1) * n.kinds + 10 * n.edges
    spark.createDataFrame([(0, 1, 1, 99)], "kind int, edges long, nodes int, version int").write.mode("overwrite").parquet(str(tmp_path / "p/meta"))
    with pytest.raises(ValueError):
        impact.load(spark, str(tmp_path / "p"))


def test_generated_sources(spark):
    rows = sample.generated(spark, 3).collect()
    assert len(rows) == 18 and len({r.path for r in rows}) == 18 and len({r.file_id for r in rows}) == 18
    assert any("package d2;" in r.text and "class Desk_2" in r.text for r in rows)


def test_reports(spark, project):
    from tracelake.sinks import report, writers

    q = spark.createDataFrame([("c", "TICKET.CODE")], "query_id string, column string")
    rows = impact.column_impact(project, q).cache()
    code, text = report.listing(rows)
    assert code == 0 and text.splitlines()[0].split()[:3] == ["c", "1", "EXACT"] and report.listing(rows.limit(0)) == (2, "nothing found")
    assert {r.type: r.n for r in report.tiles(rows).collect()}["METHOD"] == 3
    page = report.page("a < b", rows)
    assert "a &lt; b" in page and f"{rows.count()} items" in page and "GET /desk/holder" in page
    nodes = project.node.filter(F.col("sig") == HOLDER).union(project.node.filter("kind = 6"))
    text = report.dot(nodes, project.edge)
    assert text.count("subgraph") == 1 and "shape=cylinder" in text and text.endswith("}")
    assert report.svg(text) is None or "<svg" in report.svg(text)


def test_result_tables_are_typed(spark, tmp_path):
    from tracelake.sinks import writers

    writers.write(spark.createDataFrame([("q", "t")], "query_id string, target string"), writers.IMPACT, str(tmp_path / "i"))
    types = dict(spark.read.parquet(str(tmp_path / "i")).dtypes)
    assert types["distance"] == "int" and types["implicit"] == "boolean" and types["query"] == "string"
