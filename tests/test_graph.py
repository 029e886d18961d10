"""Graph operators against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tracelake.functions import names
from tracelake.operators import graph
from tracelake.schema import COMMON, EDGE, EDGES


def breadth_first(edges, starts, first, second):
    """The queue that first_visits stands for: dist, parent, confidence and flags of each first visit."""
    seen, order = {s: (0, None, 0, 0) for s in starts}, list(starts)
    by = {}
    for e in sorted(edges, key=lambda e: (e[0], e[8])):
        by.setdefault(e[1], []).append(e)
    for only in (first, second):
        queue = deque(order)
        while queue:
            v = queue.popleft()
            for kind, _, w, conf, _, flags, *_ in by.get(v, ()):
                if (kind in COMMON or kind == only) and flags & ~1 == 0 and w not in seen:
                    d, _, c, f = seen[v]
                    seen[w] = (d + 1, v, max(c, conf), f | flags)
                    order.append(w)
                    queue.append(w)
    return seen, order


@pytest.mark.parametrize("seed", range(3))
def test_first_visits_equal_a_queue(spark, seed):
    rng = random.Random(seed)
    kinds = (EDGE["LOCAL_FLOW"], EDGE["ARG_IN"], EDGE["RET_OUT"], EDGE["STORE"])
    rows = [(rng.choice(kinds), rng.randrange(25), rng.randrange(25), rng.randrange(3), 0, rng.choice((0, 0, 1, 2)), 1, 0, i) for i in range(70)]
    edges = spark.createDataFrame(rows, EDGES)
    starts = [3, 7]
    seeds = spark.createDataFrame([(0, v, i) for i, v in enumerate(starts)], "start long, v long, ord long")
    found = {r.v: r for r in graph.first_visits(edges, seeds).collect()}
    want, order = breadth_first(rows, starts, EDGE["RET_OUT"], EDGE["ARG_IN"])
    assert {v: (r.dist, r.parent, r.conf, r.flags) for v, r in found.items()} == want
    assert sorted(found, key=lambda v: found[v].ord) == order


def test_worked_example_summary(spark):
    """Three methods in a chain: list calls find, find calls select, whose flow is implicit."""
    intra = spark.createDataFrame([("list", 0, 3, 0, 0), ("list", 4, 5, 0, 0), ("find", 6, 7, 0, 0), ("find", 8, 9, 0, 0), ("select", 10, 12, 1, 0)], "method string, src long, dst long, flags int, conf int")
    calls = spark.createDataFrame([("list", 3, 4, "find", 6, 9, 1), ("find", 7, 8, "select", 10, 12, 0)], "method string, arg long, result long, callee string, formal long, out long, conf int")
    formals = spark.createDataFrame([("list", 0, 5), ("find", 6, 9), ("select", 10, 12)], "method string, formal long, out long")
    found = {(r.method, r.src, r.dst): (r.combos, r.conf) for r in graph.summaries(intra, calls, formals).collect()}
    assert found == {("list", 0, 5): (2, 1), ("find", 6, 9): (2, 0), ("select", 10, 12): (2, 0)}


def test_recursive_summary(spark):
    intra = spark.createDataFrame([("f", 1, 3, 0, 0), ("f", 4, 2, 0, 0), ("f", 1, 2, 2, 1)], "method string, src long, dst long, flags int, conf int")
    calls = spark.createDataFrame([("f", 3, 4, "f", 1, 2, 0)], "method string, arg long, result long, callee string, formal long, out long, conf int")
    formals = spark.createDataFrame([("f", 1, 2)], "method string, formal long, out long")
    assert [(r.combos, r.conf) for r in graph.summaries(intra, calls, formals).collect()] == [(4, 1)]


def test_masks(spark):
    rows = spark.range(16).select(F.col("id").cast("int").alias("m"), graph.minimal_masks(F.col("id").cast("int")).alias("k"), *(graph.usable_combo(F.col("id").cast("int"), a).alias(f"u{a}") for a in range(4))).collect()
    for r in rows:
        combos = [k for k in range(4) if r.m >> k & 1]
        assert r.k == sum(1 << k for k in combos if not any(j != k and j & k == j for j in combos))
        for a in range(4):
            assert r[f"u{a}"] == next((k for k in combos if k & ~a == 0), None)


def test_names(spark):
    r = spark.range(1).select(
        names.normalise(F.lit(' "aB" ')).alias("q"), names.normalise(F.lit("ab")).alias("u"), names.camel(F.lit("CUST_ID")).alias("c"), names.concat_path(F.lit("/a/"), F.lit("b")).alias("p"),
        names.concat_path(F.lit(""), F.lit("")).alias("e"), names.binds(F.lit("x=#{a.b,jdbcType=VARCHAR} and #{c}")).alias("b"), names.line_of(F.lit("a\nb\nc"), F.lit(4)).alias("l"), names.first_keyword(F.lit("  SELECT 1")).alias("k"),
    ).first()
    assert (r.q, r.u, r.c, r.p, r.e, r.b, r.l, r.k) == ("aB", "AB", "custId", "/a/b", "/", ["a.b", "c"], 3, "select")


def test_paths(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0, 0, 0, 1, 0, 0), (1, 2, 3, 0, 0, 0, 1, 0, 1), (1, 1, 4, 0, 0, 0, 1, 0, 2)], EDGES)
    visits = graph.first_visits(edges, spark.createDataFrame([(0, 1, 0)], "start long, v long, ord long"))
    path = graph.path_of(visits, spark.createDataFrame([(0, 3)], "start long, v long")).orderBy("seq").collect()
    assert [r.v for r in path] == [1, 2, 3]
