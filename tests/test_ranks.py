"""Exact ranks and numbers in two levels against plain Python; queries on literal sources against their rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators.ranks import nearest_ranks, numbered_within
from tracelake.plans import projectqueries


def test_nearest_ranks(spark):
    rng = random.Random(3)
    rows = [("wide", rng.uniform(-1e9, 1e9)) for _ in range(999)] + [("ties", float(rng.randrange(3))) for _ in range(500)] + [("one", 7.5), ("null", None), ("same", 2.0), ("same", 2.0)] + [("tiny", 1 + i * 2**-50) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v double")
    places = {"p50": lambda n: F.floor(n / 2) + 1, "p99": lambda n: F.ceil(n * F.lit(0.99))}
    found = {r.k: (r.p50, r.p99, r.most) for r in nearest_ranks(df, "k", "v", places).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        x = sorted(v for kk, v in rows if kk == k and v is not None)
        want[k] = x[len(x) // 2], x[math.ceil(len(x) * 0.99) - 1], x[-1]
    assert found == want
    assert nearest_ranks(df.limit(0), "k", "v", places).count() == 0


def test_numbered_within(spark):
    rows = [(i % 3, i * 37 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, x int")
    found = {(r.g, r.x): r.turn for r in numbered_within(df, "g", "x", F.shiftright("x", 6)).collect()}
    for g in range(3):
        xs = sorted(x for gg, x in rows if gg == g)
        assert [found[g, x] for x in xs] == list(range(1, len(xs) + 1))


@pytest.mark.parametrize("name", ["lineage_derives", "lineage_binds", "mapper_variants"])
def test_literal_queries(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = projectqueries.QUERIES[name](spark, "")
    want = duckdb.connect().sql(projectqueries.SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
