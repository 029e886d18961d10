import pytest

from tracelake.schema import CLAUSE, EDGE
from tracelake.sources.sql_lineage import AGG, DIRECT, EXACT, EXPR, HEURISTIC, RESOLVED, analyse, flow_edges, lineage

CATALOG = {"EMP": ["ID", "NAME", "DEPT_ID", "SAL"], "DEPT": ["DEPT_ID", "TITLE"]}


def facts(sql, fact, catalog=CATALOG):
    return [dict(zip("st sc tt tc bind clause conf derive implicit top".split(), r[1:])) for r in analyse(sql, catalog) if r[0] == fact]


def uses(sql, clause, catalog=CATALOG):
    return {(f["st"], f["sc"], f["conf"]) for f in facts(sql, "use", catalog) if f["clause"] == CLAUSE[clause]}


def derives(sql, implicit=False, catalog=CATALOG):
    return {(f["st"], f["sc"], f["tt"], f["tc"], f["derive"]) for f in facts(sql, "derive", catalog) if f["implicit"] == implicit}


def outputs(sql, catalog=CATALOG):
    return {(f["tc"], f["derive"]) for f in facts(sql, "output", catalog)}


def binds(sql, catalog=CATALOG):
    return {(f["bind"], f["tt"], f["tc"], f["clause"]) for f in facts(sql, "bind", catalog)}


def test_select_items_and_clauses():
    sql = "select /*+ INDEX(e X) */ e.name, sum(e.sal) total, e.id + 1 from emp e, dept d where e.dept_id = d.dept_id(+) and e.id = :__b0 group by e.name order by total"
    assert outputs(sql) == {("NAME", DIRECT), ("TOTAL", AGG), ("EXPR_3", EXPR)}
    assert uses(sql, "SELECT_ITEM") == {("EMP", "NAME", EXACT), ("EMP", "SAL", EXACT), ("EMP", "ID", EXACT)}
    assert ("DEPT", "DEPT_ID", EXACT) in uses(sql, "WHERE")
    assert uses(sql, "GROUP_ORDER") == {("EMP", "NAME", EXACT), ("EMP", "SAL", EXACT)}
    assert binds(sql) == {(":__b0", "EMP", "ID", CLAUSE["WHERE"])}


def test_unqualified_names():
    assert uses("select title from emp join dept on emp.dept_id = dept.dept_id", "SELECT_ITEM") == {("DEPT", "TITLE", RESOLVED)}
    assert uses("select x from a, b", "SELECT_ITEM") == {("A", "X", HEURISTIC), ("B", "X", HEURISTIC)}
    assert facts("select dept_id from emp, dept", "unknown")
    assert uses("select 1 from emp e where exists (select 1 from dept where title = name)", "WHERE") >= {("DEPT", "TITLE", EXACT), ("EMP", "NAME", EXACT)}


def test_star_views_and_ctes():
    assert outputs("select * from dept") == {("DEPT_ID", DIRECT), ("TITLE", DIRECT)}
    assert uses("select * from nowhere", "SELECT_ITEM") == {("NOWHERE", "*", HEURISTIC)}
    assert uses("with x(a) as (select sal from emp) select a from x", "SELECT_ITEM") == {("EMP", "SAL", EXACT)}
    assert uses("select q.n from (select name n from emp) q", "SELECT_ITEM") == {("EMP", "NAME", EXACT)}
    assert uses("select q.n from (select z.* from zed z) q", "SELECT_ITEM") >= {("ZED", "N", HEURISTIC)}


def test_between_keeps_its_and():
    assert binds("select id from emp where sal between ? and :b and name like :c") == {("?", "EMP", "SAL", 2), (":b", "EMP", "SAL", 2), (":c", "EMP", "NAME", 2)}


def test_set_operations_merge_by_position():
    rows = derives("insert into t (a) select name from emp union all select title from dept")
    assert rows == {("EMP", "NAME", "T", "A", DIRECT), ("DEPT", "TITLE", "T", "A", DIRECT)}


def test_insert():
    assert binds("insert into emp values (:a, :b, 1, :c)") == {(":a", "EMP", "ID", 4), (":b", "EMP", "NAME", 4), (":c", "EMP", "SAL", 4)}
    sql = "insert into t (a, b) select name, max(sal) from emp where dept_id = 3 group by name"
    assert derives(sql) == {("EMP", "NAME", "T", "A", DIRECT), ("EMP", "SAL", "T", "B", AGG)}
    assert derives(sql, True) == {("EMP", "DEPT_ID", "T", c, EXPR) for c in "AB"}


def test_update_delete_merge_create():
    sql = "update emp e set (name, sal) = (select d.title, 1 from dept d where d.dept_id = e.dept_id), id = :x where id = :y"
    assert derives(sql) == {("DEPT", "TITLE", "EMP", "NAME", DIRECT)}
    assert {(":x", "EMP", "ID", CLAUSE["SET"]), (":y", "EMP", "ID", CLAUSE["WHERE"])} <= binds(sql)
    assert binds("delete from emp where id = :x") == {(":x", "EMP", "ID", CLAUSE["WHERE"])}
    sql = "merge into emp e using dept d on (e.dept_id = d.dept_id) when matched then update set e.name = d.title, sal = case when d.title = 'x' then 1 else 2 end when not matched then insert (id, name) values (:i, d.title)"
    assert derives(sql) == {("DEPT", "TITLE", "EMP", "NAME", DIRECT), ("DEPT", "TITLE", "EMP", "SAL", EXPR)}
    assert derives(sql, True) == {("DEPT", "DEPT_ID", "EMP", c, EXPR) for c in ("ID", "NAME", "SAL")}
    assert derives("create table t as select name n, sal * 2 s from emp") == {("EMP", "NAME", "T", "N", DIRECT), ("EMP", "SAL", "T", "S", EXPR)}


@pytest.mark.parametrize("sql", ["truncate table t", "select (", "insert", "update emp", "select )"])
def test_unknown(sql):
    assert facts(sql, "unknown") or not facts(sql, "derive")


def test_other_forms():
    assert analyse(None) == analyse("") == []
    assert ("EMP", "ID", EXACT) in uses("select level from emp start with id = 1 connect by prior id = dept_id", "WHERE")
    assert not uses("select level, sysdate, s.nextval from dual", "SELECT_ITEM")
    assert uses("select a.id from emp a join dept using (dept_id)", "JOIN_ON") == {("EMP", "DEPT_ID", EXACT), ("DEPT", "DEPT_ID", EXACT)}
    assert facts("select x from table(f(1)) t", "unknown")
    assert outputs("select row_number() over (partition by name order by sal) rn, date '2020-01-01' d from emp") == {("RN", EXPR), ("D", EXPR)}


def test_lineage_and_edges(spark):
    catalog = spark.createDataFrame([("", "EMP", c, i) for i, c in enumerate(CATALOG["EMP"], 1)], "schema string, table string, column string, ordinal int")
    sql = [("a", "select * from emp where id = :x", 0), ("b", "insert into t (n) select name from emp", 0), ("c", None, 0), ("a2", "select :v from dual", 0)]
    found = lineage(spark.createDataFrame(sql, "id string, sql string, clause int"), catalog).cache()
    assert {r.source_column for r in found.filter("id = 'a' and fact = 'use' and clause = 1").collect()} == set(CATALOG["EMP"])
    rows = {(r.kind, r.src, r.dst, r.flags) for r in flow_edges(found).collect()}
    assert (EDGE["COL_DERIVES"], "column:EMP.NAME", "column:T.N", 0) in rows
    assert (EDGE["MAPS_TO"], "bind:a::x", "column:EMP.ID", 0) in rows
    assert (EDGE["LOCAL_FLOW"], "bind:a::x", "result:a", 1) in rows and (EDGE["LOCAL_FLOW"], "bind:a2::v", "result:a2", 0) in rows
    assert (EDGE["MAPS_TO"], "column:EMP.SAL", "result:a", 0) in rows
    assert lineage(spark.createDataFrame([], "id string, sql string")).count() == 0
