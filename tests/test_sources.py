"""Sources and sinks."""

from pyspark.sql import functions as F

from tracelake.schema import EDGES, NODES
from tracelake.sinks import writers
from tracelake.sources import catalog, files


def test_statements():
    text = "-- é\nselect 'a;?' from t where x = ?;\n/* only; a comment */;\ninsert into u values (?, ?)"
    assert files.statements(text) == [(1, 0, 1, "-- é\nselect 'a;?' from t where x = :__b0"), (3, 62, 4, "insert into u values (:__b0, :__b1)")]


def test_source_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("b.java", "class B {}"), ("a/a.java", "class A {}"), ("m.xml", "<mapper namespace='x'/>"), ("pom.xml", "<project/>"), ("s.sql", "select 1; select 2"), ("x.txt", "")):
        (tmp_path / name).write_text(text)
    found = files.source_files(spark, str(tmp_path))
    assert [(r.file_id, r.kind, r.path.rsplit("/", 1)[1]) for r in found.orderBy("file_id").collect()] == [(0, "java", "a.java"), (1, "java", "b.java"), (2, "xml", "m.xml"), (3, "sql", "s.sql")]
    assert [r.name for r in files.split_statements(found.filter("kind = 'sql'")).collect()] == ["stmt1@L1", "stmt2@L1"]


def test_catalogs(spark, tmp_path):
    (tmp_path / "c.csv").write_text('OWNER,TABLE_NAME,COLUMN_NAME,COLUMN_ID\ns,t,b,2\ns,t,a,1\ns,t,"c",\n')
    rows = catalog.from_csv(spark, str(tmp_path / "c.csv")).orderBy("ordinal").collect()
    assert [(r.schema, r.table, r.column, r.ordinal) for r in rows] == [("S", "T", "A", 1), ("S", "T", "B", 2), ("S", "T", "C", 3)]
    (tmp_path / "e.csv").write_text("CLASS_ID,ABBR_NAME,OBJ_RMK2\n9001,t,x\n7,t,y\n9001,t,z\n")
    assert [r.column for r in catalog.from_csv(spark, str(tmp_path / "e.csv")).orderBy("ordinal").collect()] == ["X", "Z"]
    ddl = 'CREATE TABLE shop.orders (id NUMBER(10,2) NOT NULL, "Cust" VARCHAR2(10), PRIMARY KEY (id)); DROP TABLE x; CREATE TABLE broken (a'
    found = catalog.from_ddl(spark.createDataFrame([(ddl,)], "text string")).orderBy("ordinal").collect()
    assert [(r.schema, r.table, r.column) for r in found] == [("SHOP", "ORDERS", "ID"), ("SHOP", "ORDERS", "Cust")]


def test_longest_prefix_and_resolution(spark):
    p = spark.createDataFrame([("a.b.c",), ("a.x",), ("z",)], "package string")
    m = spark.createDataFrame([("a", "D1", "S1"), ("a.b", "D2", "S2")], "prefix string, data_source string, schema string")
    assert {r.package: r.data_source for r in catalog.data_source_of(p, m, ("D0", "")).collect()} == {"a.b.c": "D2", "a.x": "D1", "z": "D0"}
    c = spark.createDataFrame([("D", "S", "T", "A", 1), ("E", "S", "T", "A", 1), ("E", "R", "U", "A", 1)], catalog.CATALOG)
    refs = spark.createDataFrame([(1, "D", "S", "T"), (2, "D", "", "T"), (3, "X", "R", "U"), (4, "X", "", "U"), (5, "X", "", "T"), (6, "X", "", "V")], "ref int, data_source string, schema string, table string")
    assert {r.ref: (r.step, r.ds) for r in catalog.resolve(refs, c).collect()} == {1: (1, "D"), 2: (2, "D"), 3: (3, "E"), 4: (4, "E"), 5: (None, None), 6: (None, None)}


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 6, 'T."C"', None), (2, 0, "x" * 60, 5)], NODES)
    edges = spark.createDataFrame([(8, 1, 2, 1, 0, 1, 1, 0, 0)], EDGES)
    writers.write_snapshot(nodes, edges, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/edge")).filter("kind = 8").count() == 1
    writers.write(nodes, writers.NODE, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).columns == list(writers.NODE)
    lines = [r.line for r in writers.dot_lines(nodes, edges).orderBy("part", "line").collect()]
    assert lines[0] == '  n1 [label="T.\\"C\\"", shape=cylinder];' and "…" in lines[1] and lines[2] == '  n1 -> n2 [label="MAPS_TO", style=dashed];'
    assert writers.display_edges(edges, nodes).select("kind", "confidence").first() == ("MAPS_TO", "RESOLVED")
    assert writers.as_json(nodes.filter(F.col("gid") == 2)).first().json.startswith('{"gid":2')
