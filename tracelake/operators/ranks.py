"""Exact order statistics and numbers without a task that holds all rows of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut, small

CELLS = 4096


def nearest_ranks(rows: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(key, one column per place, most): the values at places (from 1) of the sorted values of each key; null values don't count.

    Each place is found by two rounds of a histogram of CELLS cells between its bounds, and by counts of the values in the last cell. Windows run
    over cells, and over the different values of one cell, a 16-millionth of the range.
    """
    base = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).filter("v is not null")
    stats = base.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("place"), f(F.col("n")).cast("long").alias("rank")) for p, f in places.items()))).alias("x")
    targets = cut(stats.select("key", "lo", "hi", F.col("hi").alias("most"), wanted).select("key", "lo", "hi", "most", "x.*"))
    for _ in range(2):
        inside = base.join(small(targets), "key").filter("v between lo and hi")
        cell = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(CELLS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS))).otherwise(0)
        cells = inside.groupBy("key", "place", "rank", "most", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        cells = cells.withColumn("upto", F.sum("c").over(Window.partitionBy("key", "place").orderBy("cell")))
        found = cells.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        targets = cut(found.select("key", "lo", "hi", "most", "place", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank")))
    last = base.join(small(targets), "key").filter("v between lo and hi").groupBy("key", "place", "rank", "most", "v").agg(F.count(F.lit(1)).alias("c"))
    last = last.withColumn("upto", F.sum("c").over(Window.partitionBy("key", "place").orderBy("v")))
    hit = last.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
    return hit.groupBy(F.col("key").alias(key)).agg(*(F.max(F.when(F.col("place") == p, F.col("v"))).alias(p) for p in places), F.max("most").alias("most"))


def numbered_within(rows: DataFrame, group: str, order: str, coarse: Column) -> DataFrame:
    """rows with turn long: their place (from 1) in their group by order.

    coarse must never fall as order rises. Rows are numbered within (group, coarse), and the numbers of rows of these are added up.
    """
    rows = rows.withColumn("part", coarse)
    sizes = rows.groupBy(group, "part").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy(group, "part").orderBy(order))
    return rows.withColumn("inner", inner).join(sizes.select(group, "part", before.alias("before")), [group, "part"]).withColumn("turn", F.col("before") + F.col("inner")).drop("part", "inner", "before")
