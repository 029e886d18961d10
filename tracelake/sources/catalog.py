"""Table catalogs from CSV files, metadata exports and DDL, and how names are resolved in them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import normalise
from .files import statements

CATALOG = "data_source string, schema string, table string, column string, ordinal int"
# Header names of catalog files.
HEADERS = {
    "schema": ("SCHEMA", "OWNER", "SCHEMA_NAME", "TABLE_SCHEMA"), "table": ("TABLE_NAME", "TABLE"), "column": ("COLUMN_NAME", "COLUMN"),
    "data_source": ("DATA_SOURCE", "DATASOURCE"), "ordinal": ("COLUMN_ID", "ORDINAL_POSITION", "COL_ORDER"),
}
EXPORT_CLASS, EXPORT_COLUMN = "9001", "OBJ_RMK2"
CONSTRAINTS = frozenset("CONSTRAINT PRIMARY FOREIGN UNIQUE CHECK KEY INDEX SUPPLEMENTAL".split())


def _ordered(rows: DataFrame) -> DataFrame:
    """Ordinals from 1 per table: given ones first, then by place in the file."""
    w = Window.partitionBy("data_source", "schema", "table").orderBy(F.col("given").asc_nulls_last(), "place")
    return rows.withColumn("ordinal", F.row_number().over(w)).select("data_source", "schema", "table", "column", "ordinal")


def from_csv(spark: SparkSession, path: str, export_column: str = EXPORT_COLUMN) -> DataFrame:
    """A catalog file; one with CLASS_ID and ABBR_NAME in its header is a metadata export."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    by = {c.strip().upper(): c for c in raw.columns}
    place = F.monotonically_increasing_id().alias("place")
    if "CLASS_ID" in by and "ABBR_NAME" in by:
        raw = raw.filter(F.trim(F.col(by["CLASS_ID"])) == EXPORT_CLASS)
        rows = raw.select(F.lit("").alias("data_source"), F.lit("").alias("schema"), normalise(F.col(by["ABBR_NAME"])).alias("table"), normalise(F.col(by[export_column])).alias("column"), F.lit(None).cast("int").alias("given"), place)
        return _ordered(rows.filter("column <> ''"))
    pick = lambda k: next((F.col(by[h]) for h in HEADERS[k] if h in by), F.lit(""))
    name = lambda k: F.coalesce(normalise(pick(k)), F.lit("")).alias(k)
    rows = raw.select(name("data_source"), name("schema"), name("table"), name("column"), pick("ordinal").try_cast("int").alias("given"), place)
    return _ordered(rows.filter("table <> '' and column <> ''"))


def table_of(sql: str) -> tuple[str, str, list[str]] | None:
    """(schema, table, columns) of a CREATE TABLE statement, or None if it isn't one that can be read."""
    m = re.match(r"\s*CREATE\s+(?:GLOBAL\s+TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?((?:\"[^\"]+\"|[\w$#]+)(?:\s*\.\s*(?:\"[^\"]+\"|[\w$#]+))?)\s*\(", sql, re.I)
    if not m:
        return None
    plain = lambda x: x.strip()[1:-1] if x.strip()[:1] in ('"', "`") else x.strip().upper()
    names, depth, item, items = re.split(r"\s*\.\s*", m[1]), 1, "", []
    for c in sql[m.end() :]:
        depth += (c == "(") - (c == ")")
        if depth == 0:
            break
        if c == "," and depth == 1:
            items.append(item)
            item = ""
        else:
            item += c
    if depth:
        return None
    columns = [k[0] for k in (re.match(r'\s*("[^"]+"|`[^`]+`|[\w$#]+)', x) for x in [*items, item]) if k and k[0].strip().upper() not in CONSTRAINTS]
    return (plain(names[0]) if len(names) > 1 else "", plain(names[-1]), [plain(c) for c in columns])


def from_ddl(texts: DataFrame, data_source: str = "") -> DataFrame:
    """texts(text) to catalog rows; statements that can't be read are skipped."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [t for x in b.column("text").to_pylist() for *_, s in statements(x or "") if (t := table_of(s))]
            rows = [(data_source, s, t, c, i) for s, t, cols in found for i, c in enumerate(cols, 1)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(),) * 4 + (pa.int32(),))], ["data_source", "schema", "table", "column", "ordinal"])

    return texts.select("text").mapInArrow(run, CATALOG)


def data_source_of(packages: DataFrame, mappings: DataFrame, default: tuple[str, str] = ("", "")) -> DataFrame:
    """packages(package) with the data source and schema of the longest prefix in mappings(prefix, data_source, schema).

    Each package is exploded into its own prefixes, so that this is an equi-join.
    """
    parts = F.split("package", r"\.")
    prefixes = packages.select("package").distinct().select("package", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, F.lit(1), n)))).alias("prefix"))
    best = prefixes.join(mappings, "prefix").groupBy("package").agg(F.max_by(F.struct("data_source", "schema"), F.length("prefix")).alias("m"))
    return packages.join(best, "package", "left").select(packages["*"], F.coalesce("m.data_source", F.lit(default[0])).alias("data_source"), F.coalesce("m.schema", F.lit(default[1])).alias("schema"))


def resolve(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """refs(ref, data_source, schema, table) to the catalog table each stands for, and the step that found it.

    1 exact; 2 one table of that name in the data source (and schema, if given); 3 one in the schema anywhere; 4 without a schema, one anywhere.
    """
    tables = catalog.select("data_source", "schema", "table").distinct()
    hit = tables.select(F.col("data_source").alias("ds"), F.col("schema").alias("sc"), "table")
    j = refs.join(hit, "table", "left")
    same_ds, same_schema, free = F.col("data_source") == F.col("ds"), F.col("schema") == F.col("sc"), F.col("schema") == ""
    one = lambda c: (F.count_if(c) == 1, F.max(F.when(c, F.struct("ds", "sc"))))
    steps = [one(same_ds & same_schema), one(same_ds & (same_schema | free)), one(same_schema & ~free), one(free & F.col("ds").isNotNull())]
    x = j.groupBy("ref", "data_source", "schema", "table").agg(*(F.when(c, v).alias(f"h{i}") for i, (c, v) in enumerate(steps, 1)))
    step = F.coalesce(*(F.when(F.col(f"h{i}").isNotNull(), i) for i in range(1, 5)))
    return x.select("ref", F.coalesce("h1", "h2", "h3", "h4").alias("hit"), "table", step.alias("step")).select("ref", "hit.ds", "hit.sc", "table", "step")
