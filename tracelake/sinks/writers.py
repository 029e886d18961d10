"""Results as Parquet, JSON and DOT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CONFIDENCES, EDGE_KINDS, NODE_KINDS

# Columns of the result files.
IMPACT = ("query_id", "query", "target", "type", "distance", "confidence", "implicit", "control", "path_id", "file", "line")
PATH_STEP = ("path_id", "seq", "node_gid", "kind", "name", "file", "line", "via", "conditions")
GRAPH_NODE = ("key", "gid", "method", "lid", "kind", "name", "file", "line", "conditions", "is_start", "level")
GRAPH_EDGE = ("from_key", "to_key", "kind", "confidence", "label", "implicit", "control", "expanded_from")
NODE = ("gid", "kind", "name", "method", "file", "byte_offset", "line")


def _named(names: tuple[str, ...], column: str):
    return F.element_at(F.array(*map(F.lit, names)), F.col(column).cast("int") + 1)


#: Types of columns that aren't strings.
TYPES = {"distance": "int", "implicit": "boolean", "control": "boolean", "path_id": "int", "line": "int", "seq": "int", "node_gid": "long", "gid": "long", "lid": "int", "is_start": "boolean", "level": "int", "byte_offset": "int"}


def write(df: DataFrame, columns: tuple[str, ...], path: str) -> None:
    """df with exactly these columns, in their types; those it lacks are null."""
    df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in columns)).write.mode("overwrite").parquet(path)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes sorted by gid, and edges in a folder per kind, sorted by source, so that readers prune by kind and source."""
    nodes.sortWithinPartitions("gid").write.mode("overwrite").parquet(f"{path}/node")
    edges.repartitionByRange("kind", "src").sortWithinPartitions("kind", "src", "ord").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edge")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def display_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of their ends, kinds and confidences."""
    a, b = (nodes.select(F.col("gid").alias(k), F.col("name").alias(n), _named(NODE_KINDS, "kind").alias(t)) for k, n, t in (("src", "from_name", "from_kind"), ("dst", "to_name", "to_kind")))
    return edges.join(a, "src").join(b, "dst").select("src", "from_name", "from_kind", "dst", "to_name", "to_kind", _named(EDGE_KINDS, "kind").alias("kind"), _named(CONFIDENCES, "conf").alias("confidence"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the lines of a DOT graph, nodes before edges; labels are cut at 48 characters."""
    quoted = F.replace(F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    label = F.when(F.length("name") > 48, F.concat(F.substring(quoted, 1, 47), F.lit("…"))).otherwise(quoted)
    shape = F.when(F.col("kind") == NODE_KINDS.index("COLUMN"), "cylinder").when(F.col("kind") == NODE_KINDS.index("ENDPOINT"), "house").when(F.col("kind") == NODE_KINDS.index("PREDICATE"), "diamond").otherwise("box")
    n = nodes.select(F.lit(0).alias("part"), F.format_string('  n%d [label="%s", shape=%s];', F.col("gid"), label, shape).alias("line"))
    style = F.when(F.col("flags").bitwiseAND(1) > 0, "dashed").when(F.col("flags").bitwiseAND(2) > 0, "dotted").otherwise("solid")
    e = edges.select(F.lit(1).alias("part"), F.format_string('  n%d -> n%d [label="%s", style=%s];', F.col("src"), F.col("dst"), _named(EDGE_KINDS, "kind"), style).alias("line"))
    return n.unionByName(e)
