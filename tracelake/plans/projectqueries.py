"""Queries on literal sources: the sample project's impact questions, and lineage of literal statements; their SQL is the expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLAUSE
from ..sources import mappers, sql_lineage
from . import impact, sample

QUERIES, SQL = {}, {}
_PROJECTS: dict[str, impact.Project] = {}

BOOK, DESK, ROWS = "shop.PaperBook", "shop.TicketDesk", "shop.TicketRows"
OPEN, HOLDER = f"{DESK}#open(java.lang.String,int)", f"{DESK}#holder(java.lang.String)"
INSERT, FIND = f"{ROWS}#insert(shop.Ticket)", f"{ROWS}#find(java.lang.String)"


def query(name: str, columns: str, rows: list[tuple]):
    """Registers a query whose result is known."""
    literal = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    SQL[name] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"

    def register(f):
        QUERIES[name] = f
        return f

    return register


def project(spark: SparkSession) -> impact.Project:
    """The sample project, indexed once per application."""
    key = spark.sparkContext.applicationId
    if key not in _PROJECTS:
        _PROJECTS[key] = impact.index(spark, sample.sources(spark))
    return _PROJECTS[key]


@query(
    "column_impact",
    "query_id, type, target",
    [
        ("h", "SQL", INSERT), ("h", "SQL_BIND", f"{INSERT} #{{holder}}"), ("h", "FIELD", "shop.Ticket.holder"), ("h", "METHOD", "shop.Ticket#setHolder(java.lang.String)"), ("h", "METHOD", f"{BOOK}#save(shop.Ticket)"), ("h", "METHOD", OPEN),
        ("h", "ENDPOINT_INPUT", f"{OPEN} (holder)"), ("h", "ENDPOINT", "POST /desk/tickets"), ("h", "SQL", FIND), ("h", "METHOD", f"{BOOK}#holderOf(java.lang.String)"), ("h", "METHOD", HOLDER), ("h", "ENDPOINT", "GET /desk/holder"),
        ("h", "COLUMN", "ARCHIVE.NAME"), ("h", "SQL", "night.sql#stmt1@L1()"), ("c", "SQL", FIND), ("c", "SQL_BIND", f"{FIND} #{{code}}"), ("c", "METHOD", f"{BOOK}#holderOf(java.lang.String)"),
        ("c", "METHOD", f"{BOOK}#clean(java.lang.String,int)"), ("c", "ENDPOINT_INPUT", f"{HOLDER} (code)"), ("c", "METHOD", HOLDER), ("c", "ENDPOINT", "GET /desk/holder"),
    ],
)
def column_impact(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([("h", "ticket.holder"), ("c", "TICKET.CODE"), ("n", "NONE.X")], "query_id string, column string")
    return impact.column_impact(project(spark), q).select("query_id", "type", "target")


@query(
    "param_flow",
    "query_id, type, target",
    [("b", "METHOD", HOLDER), ("b", "METHOD", f"{BOOK}#holderOf(java.lang.String)"), ("b", "METHOD", f"{BOOK}#clean(java.lang.String,int)"), ("b", "SQL", FIND), ("b", "SQL_BIND", f"{FIND} #{{code}}"), ("b", "COLUMN", "TICKET.CODE")],
)
def param_flow(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([("a", "POST /desk/tickets", "seat"), ("b", "PUT /desk/holder", "code"), ("d", "GET /none", "x")], "query_id string, endpoint string, param string")
    return impact.param_flow(project(spark), q).select("query_id", "type", "target")


@query(
    "method_items",
    "query_id, type, target, distance",
    [
        ("s", "DIRECT_CALLER", OPEN, 1), ("s", "ENDPOINT", "POST /desk/tickets", 2), ("c", "DIRECT_CALLER", f"{BOOK}#holderOf(java.lang.String)", 1), ("c", "INDIRECT_CALLER", HOLDER, 2), ("c", "ENDPOINT", "GET /desk/holder", 3),
        ("e", "ENDPOINT", "POST /desk/tickets", 1),
    ],
)
def method_items(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([("s", "TicketBook#save"), ("c", f"{BOOK}#clean"), ("e", OPEN)], "query_id string, method string")
    return impact.method_items(project(spark), q).select("query_id", "type", "target", "distance")


STATEMENTS = [
    ("rollup", "insert into cust_total (custkey, total) select o_custkey, sum(o_totalprice) from orders where o_orderstatus = 'F' group by o_custkey"),
    ("view", "create table big as select c.c_name, v.t * 2 as twice from customer c join (select o_custkey k, o_totalprice t from orders) v on v.k = c.c_custkey"),
    ("update", "update part p set p_size = :__b0, (p_brand, p_type) = (select max(s.s_name), s.s_name from supplier s where s.s_suppkey = p.p_partkey) where p.p_name like :__b1"),
    ("merge", "merge into nation n using region r on (n.n_regionkey = r.r_regionkey) when matched then update set n.n_name = r.r_name"),
    ("union", "insert into names (name) select n_name from nation union all select r_name from region"),
]


@query(
    "lineage_derives",
    "id, source, target, derive, implicit",
    [
        ("rollup", "ORDERS.O_CUSTKEY", "CUST_TOTAL.CUSTKEY", 0, 0), ("rollup", "ORDERS.O_TOTALPRICE", "CUST_TOTAL.TOTAL", 2, 0), ("rollup", "ORDERS.O_ORDERSTATUS", "CUST_TOTAL.CUSTKEY", 1, 1), ("rollup", "ORDERS.O_ORDERSTATUS", "CUST_TOTAL.TOTAL", 1, 1),
        ("view", "CUSTOMER.C_NAME", "BIG.C_NAME", 0, 0), ("view", "ORDERS.O_TOTALPRICE", "BIG.TWICE", 1, 0), ("update", "SUPPLIER.S_NAME", "PART.P_BRAND", 2, 0), ("update", "SUPPLIER.S_NAME", "PART.P_TYPE", 0, 0),
        ("merge", "REGION.R_NAME", "NATION.N_NAME", 0, 0), ("merge", "REGION.R_REGIONKEY", "NATION.N_NAME", 1, 1), ("union", "NATION.N_NAME", "NAMES.NAME", 0, 0), ("union", "REGION.R_NAME", "NAMES.NAME", 0, 0),
    ],
)
def lineage_derives(spark: SparkSession, d: str) -> DataFrame:
    """Columns that statements over the star schema derive from others."""
    facts = sql_lineage.lineage(spark.createDataFrame(STATEMENTS, "id string, sql string")).filter("fact = 'derive'")
    return facts.select("id", F.concat_ws(".", "source_table", "source_column").alias("source"), F.concat_ws(".", "target_table", "target_column").alias("target"), "derive", F.col("implicit").cast("int").alias("implicit")).distinct()


@query(
    "lineage_binds",
    "id, bind, target, clause",
    [("update", ":__b0", "PART.P_SIZE", CLAUSE["SET"]), ("update", ":__b1", "PART.P_NAME", CLAUSE["WHERE"])],
)
def lineage_binds(spark: SparkSession, d: str) -> DataFrame:
    facts = sql_lineage.lineage(spark.createDataFrame(STATEMENTS, "id string, sql string")).filter("fact = 'bind' and target_table is not null")
    return facts.select("id", "bind", F.concat_ws(".", "target_table", "target_column").alias("target"), "clause").distinct()


MAPPER = """<mapper namespace="n"><sql id="cols">a, b</sql>
<select id="s">select <include refid="cols"/> from t <where><if test="x">and a = #{x}</if> <if test="y">or b in <foreach collection="y" item="i" open="(" close=")">#{i}</foreach></if></where></select>
<update id="u">update t <set>a = #{p.a}, <if test="b">b = 1,</if></set> where k = ${k}</update></mapper>"""


@query(
    "mapper_variants",
    "id, variant, sql",
    [
        ("s", 0, "select a, b from t"), ("s", 1, "select a, b from t WHERE b in (:__b1)"), ("s", 2, "select a, b from t WHERE a = :__b0"), ("s", 3, "select a, b from t WHERE a = :__b0 or b in (:__b1)"),
        ("u", 0, "update t SET a = :__b0 where k = SPLICED_TEXT_1"), ("u", 1, "update t SET a = :__b0, b = 1 where k = SPLICED_TEXT_1"),
    ],
)
def mapper_variants(spark: SparkSession, d: str) -> DataFrame:
    return mappers.mapper_statements(spark.createDataFrame([(1, MAPPER)], "file_id int, text string")).select("id", "variant", "sql")
