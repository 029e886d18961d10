"""Scanning source trees and splitting SQL files into statements."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File kinds in the order in which their files are numbered.
KINDS = ("java", "xml", "sql")


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, kind, path, text, content, sha256): .java, .sql, and .xml with a mapper in it, numbered by kind and path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{java,xml,sql}").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    f = raw.select(kind.alias("kind"), "path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"), "content")
    f = f.filter((F.col("kind") != "xml") | F.contains("text", F.lit("<mapper")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # Numbers in two levels, without the texts: among paths that begin alike beyond what all share, and over such beginnings.
    names = f.select(rank.alias("rank"), "path")
    ends = names.agg(F.min("path"), F.max("path")).first()
    shared = len(os.path.commonprefix([x or "" for x in ends]))
    names = names.withColumn("head", F.substring("path", 1, shared + 4))
    heads = names.groupBy("rank", "head").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank", "head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("rank", "head").orderBy("path"))
    ids = names.withColumn("i", inner).join(heads.select("rank", "head", before.alias("before")), ["rank", "head"])
    ids = ids.select("path", (F.col("before") + F.col("i") - 1).cast("int").alias("file_id"))
    return f.join(ids, "path").select("file_id", "kind", "path", "text", "content", "sha256")


def statements(text: str) -> list[tuple[int, int, int, str]]:
    """(number, UTF-8 byte offset, line, SQL) of the statements of a file.

    They end at `;` outside quotes and comments (a `;` in a comment ends nothing); those of comments alone are dropped but counted;
    `?` outside quotes becomes `:__b<n>`.
    """
    out, i, start, n, number = [], 0, 0, len(text), 0
    while i <= n:
        c = text[i : i + 1]
        if c == "'":
            end = text.find("'", i + 1)
            i = n if end < 0 else end + 1
        elif text.startswith("--", i):
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
        elif c == ";" or not c:
            body = text[start:i]
            number += 1
            if without_comments(body).strip():
                first = start + len(body) - len(body.lstrip())
                out.append((number, len(text[:first].encode()), text.count("\n", 0, first) + 1, number_binds(body.strip())))
            i += 1
            start = i
        else:
            i += 1
    return out


def without_comments(sql: str) -> str:
    out, i = [], 0
    while i < len(sql):
        if sql[i] == "'":
            end = sql.find("'", i + 1)
            end = len(sql) if end < 0 else end + 1
            out.append(sql[i:end])
            i = end
        elif sql.startswith("--", i):
            end = sql.find("\n", i)
            i = len(sql) if end < 0 else end
        elif sql.startswith("/*", i):
            end = sql.find("*/", i + 2)
            i = len(sql) if end < 0 else end + 2
        else:
            out.append(sql[i])
            i += 1
    return "".join(out)


def number_binds(sql: str) -> str:
    parts, n = sql.split("'"), 0
    for k in range(0, len(parts), 2):
        while "?" in parts[k]:
            parts[k] = parts[k].replace("?", f":__b{n}", 1)
            n += 1
    return "'".join(parts)


def split_statements(files: DataFrame) -> DataFrame:
    """files(file_id, text) to (file_id, n, offset, line, name, sql)."""

    def run(batches):
        for b in batches:
            rows = [(f, n, o, line, f"stmt{n}@L{line}", s) for f, t in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist()) for n, o, line, s in statements(t or "")]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file_id", "n", "offset", "line", "name", "sql"])

    return files.select(F.col("file_id").cast("int").alias("file_id"), "text").mapInArrow(run, "file_id int, n int, offset long, line int, name string, sql string")
