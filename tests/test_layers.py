"""Traversals of many starts: the size of their tables, and of their tasks."""

import random

import pytest

from tracelake.operators import graph
from tracelake.plans import tables
from tracelake.schema import EDGE


@pytest.fixture
def written(spark, monkeypatch):
    """(rows, shuffle partitions) of each table that a traversal writes."""
    found = []

    def cut(df):
        out = tables.cut(df)
        found.append((out.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        return out

    monkeypatch.setattr(graph, "cut", cut)
    return found


def ring(spark, n, kind="LOCAL_FLOW"):
    return [(EDGE[kind], i, (i + 1) % n) for i in range(n)]


def test_starts_that_reach_the_same_share_rows(spark, written):
    """40 starts over two rings of 3 nodes, the second behind a call: a row per node and layer instead of one per start."""
    rows = ring(spark, 3) + [(EDGE["ARG_IN"], 0, 10)] + [(EDGE["LOCAL_FLOW"], 10 + i, 10 + (i + 1) % 3) for i in range(3)]
    edges = spark.createDataFrame(rows, "kind int, src long, dst long")
    seeds = spark.createDataFrame([(s, s % 3) for s in range(128, 168)], "start long, v long")
    found = {(r.start, r.v): r.phase for r in graph.two_phase(edges, seeds).collect()}
    assert found == {(s, v): 1 if v < 3 else 2 for s in range(128, 168) for v in (0, 1, 2, 10, 11, 12)}
    assert max(n for n, _ in written) <= 3


@pytest.mark.parametrize("kind", ["long", "string"])
def test_bottleneck_equals_paths(spark, written, kind):
    rng = random.Random(5)
    rows = [(rng.randrange(12), rng.randrange(12), rng.randrange(4)) for _ in range(40)]
    starts = [-65, -1, 0, 63, 64, 127] if kind == "long" else list("abcdef")
    want = {}
    for i, s in enumerate(starts):
        for c in (2, 1, 0):
            seen, todo = {i}, [i]
            while todo:
                v = todo.pop()
                new = {b for a, b, w in rows if a == v and w <= c} - seen
                seen |= new
                todo += new
            want |= {(s, v): c for v in seen}
    seeds = spark.createDataFrame([(s, i) for i, s in enumerate(starts)], f"start {kind}, v long")
    found = graph.bottleneck(spark.createDataFrame(rows, "src long, dst long, conf int"), seeds)
    assert {(r.start, r.v): r.conf for r in found.collect()} == want


def test_bottleneck_starts_share_rows(spark, written):
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1)], "src long, dst long, conf int")
    seeds = spark.createDataFrame([(s, 0) for s in range(40)], "start long, v long")
    assert {(r.start, r.v, r.conf) for r in graph.bottleneck(edges, seeds).collect()} == {(s, v, c) for s in range(40) for v, c in ((0, 0), (1, 2), (2, 1))}
    assert max(n for n, _ in written) <= 3


def test_more_rows_are_dealt_to_more_tasks(spark, written, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 5, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    edges = spark.createDataFrame([(i, i + 1, i % 3 == 0) for i in range(60)], "src long, dst long, terminal boolean")
    graph.reach(edges, spark.createDataFrame([(i, i) for i in range(3)], "start long, v long")).collect()
    assert max(p for _, p in written) >= 12
    written.clear()
    calls = edges.selectExpr("src AS caller", "dst AS callee", "0 AS call_conf")
    graph.callers(calls.filter("caller > 57"), spark.createDataFrame([(60,)], "v long")).collect()
    graph.callers(calls.filter("caller < 60").repartition(1), spark.createDataFrame([(2,)], "v long")).collect()
    assert max(p for _, p in written) >= 12
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_terminal_starts_share_rows(spark, written):
    """Neighbouring starts over a terminal edge that a later edge opens again: a row per node and layer."""
    edges = spark.createDataFrame([(0, 1, True), (0, 2, False), (2, 1, False), (1, 3, True), (3, 4, False)], "src long, dst long, terminal boolean")
    seeds = spark.createDataFrame([(s, 0) for s in range(40)], "start long, v long")
    want = {(s, v, h, t) for s in range(40) for v, h, t in ((0, 0, False), (1, 1, False), (2, 1, False), (3, 3, True))}
    assert {(r.start, r.v, r.hop, r.terminal) for r in graph.reach(edges, seeds).collect()} == want
    assert max(n for n, _ in written) <= 5
