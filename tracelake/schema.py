"""Enumerations and table schemas of the program graph."""

from pyspark.sql import types as T

# Ids of node kinds, edge kinds, confidences, clauses, branch labels, derivations and flags.
NODE_KINDS = ("FORMAL_IN", "FORMAL_OUT", "ACTUAL_IN", "ACTUAL_OUT", "LOCAL", "BIND", "COLUMN", "FIELD", "ENDPOINT", "UNKNOWN", "PREDICATE", "FIELD_LOAD", "FIELD_STORE")
EDGE_KINDS = ("DEF_USE", "LOCAL_FLOW", "ARG_IN", "RET_OUT", "SUMMARY", "STORE", "LOAD", "BIND_TO", "MAPS_TO", "COL_DERIVES", "CONTROL", "CONTROL_FLOW")
CONFIDENCES = ("EXACT", "RESOLVED", "HEURISTIC")
CLAUSES = ("NONE", "SELECT_ITEM", "WHERE", "SET", "INSERT_VALUE", "JOIN_ON", "GROUP_ORDER")
BRANCHES = ("TRUE", "FALSE", "CASE", "DEFAULT", "EXCEPTION")
DERIVES = ("DIRECT", "EXPR", "AGG")
IMPLICIT, CONTROL = 1, 2
# Labels of result types.
LABELS = {
    "ENDPOINT": "Endpoint", "COLUMN": "컬럼", "FIELD": "필드", "SQL_BIND": "SQL 바인드", "UNKNOWN": "UNKNOWN", "ENDPOINT_INPUT": "Endpoint 입력",
    "SQL": "SQL", "METHOD": "메서드", "DIRECT_CALLER": "직접 호출자", "INDIRECT_CALLER": "간접 호출자",
}

NODE = {k: i for i, k in enumerate(NODE_KINDS)}
EDGE = {k: i for i, k in enumerate(EDGE_KINDS)}
CLAUSE = {k: i for i, k in enumerate(CLAUSES)}

#: Edge kinds that both phases of a slice follow, and those of one phase only.
COMMON = tuple(EDGE[k] for k in ("LOCAL_FLOW", "SUMMARY", "BIND_TO", "MAPS_TO", "STORE", "LOAD", "COL_DERIVES"))
#: Comparing clauses: a value that reaches a column there is compared, not stored.
COMPARING = tuple(CLAUSE[k] for k in ("WHERE", "JOIN_ON", "GROUP_ORDER"))

EDGES = T.StructType(
    [
        T.StructField("kind", T.IntegerType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("conf", T.IntegerType()),
        T.StructField("clause", T.IntegerType()), T.StructField("flags", T.IntegerType()), T.StructField("masks", T.IntegerType()), T.StructField("derive", T.IntegerType()), T.StructField("ord", T.LongType()),
    ]
)
NODES = T.StructType([T.StructField("gid", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("method", T.LongType())])

#: What a text spliced into SQL is called there, followed by its number.
SPLICED = "SPLICED_TEXT_"
