"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import pickle
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: Rows of a table that may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 20_000

#: Bytes 0-255 with A-Z made lower case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, with every ASCII byte that is neither letter nor digit made a space.
LOWER_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else (b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only on a local master, where both run on one machine, is one made if neither is set; elsewhere that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back, so that what follows doesn't compute it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracelake-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracelake_path = path
    written(spark, path)
    return out


_WRITTEN: list[tuple[SparkSession, str]] = []


def written(spark: SparkSession, path: str) -> None:
    """Has a table deleted when the program ends, if its session is still there then."""
    _WRITTEN.append((spark, path))


@atexit.register
def _delete_written() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            try:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
            except (Py4JError, OSError):  # the session has ended meanwhile
                return


def discard(*frames: DataFrame) -> None:
    """Deletes tables that cut() wrote, once nothing lazy reads them any more."""
    for df in frames:
        path = getattr(df, "_tracelake_path", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcasting if it is counted to have at most so many rows; otherwise it is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_row_ids(docs: DataFrame, *columns: str) -> DataFrame:
    """rid long, doc_id and the given columns; rid is unique, and its order is that of doc_id.

    Where doc_id is whole and unique it serves as rid. Otherwise (nulls, repeated rows) the rows are sorted by
    doc_id, nulls last, then by the other columns, and numbered once in a table in the shared folder.
    """
    rows = numbered(docs.select("doc_id", *columns), "rid")
    out = rows.select("rid", "doc_id", *columns)
    if hasattr(rows, "_tracelake_path"):
        out._tracelake_path = rows._tracelake_path
    return out


def free_name(docs: DataFrame, name: str) -> str:
    """name, or name followed by as many underscores as make it differ from every column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """All columns of docs, and a long called name: unique, in order of doc_id (nulls last), then of the other columns.

    Rows that are equal in full are told apart by where they are read, so that a row repeated very often is sorted by many tasks.
    """
    n, whole, distinct = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == whole == distinct:
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id" and isinstance(docs.schema[c].dataType, AtomicType)]
    ranged = docs.withColumn(name, F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), *others, name)
    return cut(ranged.withColumn(name, F.monotonically_increasing_id()))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1, F.lit(False))


def pieces_of(texts: list, budget: int):
    """Runs (start, end) of texts of about budget bytes each, one text at least."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if i > start and size + n > budget:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def share(spark: SparkSession, value):
    """Broadcasts a bounded value with its code; on executors, calling what this returns gives the value."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)
