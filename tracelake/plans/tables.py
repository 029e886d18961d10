"""Reading the inputs and cutting lineage through the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
#: Rows of a join's or aggregation's inputs for one task.
TASK_ROWS = 1_000_000


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


def cut(df: DataFrame) -> DataFrame:
    """Writes df once and reads it back; iterations call this for every layer so that plans stay small."""
    path = f"{shared_dir(df.sparkSession)}/layer-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_written() -> None:
    """Deletes what cut() wrote when the program ends, if the session is still there then."""
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            try:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
            except (Py4JError, OSError):  # the session has ended meanwhile
                return


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """A table that cut() wrote: None if it is empty, marked for broadcast if it has few rows, else as it is."""
    n = df.count()
    return None if not n else F.broadcast(df) if n <= rows else df


@contextmanager
def dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside shuffles into the session's count of partitions, or more where so many rows would make larger tasks than TASK_ROWS."""
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    spark.conf.set(key, str(max(int(was), -(-rows // TASK_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(key, was)
