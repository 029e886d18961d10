"""Terminal edges whose target another edge reaches later."""

from tracelake.operators import graph


def test_terminal_target_is_opened_by_a_later_edge(spark):
    rows = [(1, 2, True), (1, 3, False), (3, 4, False), (4, 2, False), (2, 5, False), (1, 6, True), (6, 7, False), (5, 2, True)]
    edges = spark.createDataFrame(rows, "src long, dst long, terminal boolean")
    found = graph.reach(edges, spark.createDataFrame([(0, 1)], "start long, v long")).collect()
    assert sorted((r.v, r.hop) for r in found) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 4), (6, 1)]
