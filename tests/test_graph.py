import random

from siftline.operators import graph
from siftline.operators.graph import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(100, 130)] + [(random.randrange(60), random.randrange(60)) for _ in range(35)]
    edges += [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == brute(edges)


def test_components_of_names(spark):
    random.seed(4)
    edges = [(f"n{random.randrange(80):03d}", f"n{random.randrange(80):03d}") for _ in range(60)] + [("a1", "b2"), ("b2", "ü"), (None, "x")]
    got = connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    assert {r.node: r.component for r in got} == brute(edges)


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_scratch_drops_what_is_not_kept(spark):
    import pytest

    from siftline.plans.storage import scratch, stored

    with scratch() as keep:
        a = stored(spark.range(3))
        b = keep(stored(spark.range(4)))
        with scratch() as inner:
            c = inner(stored(spark.range(5)))
        assert a.count() == 3 and c.count() == 5
    assert b.count() == 4
    for gone in (a, c):
        with pytest.raises(Exception):  # noqa: B017
            gone.collect()


def test_a_round_takes_three_joins(spark, monkeypatch):
    """The end of the rounds is seen on the labels before, which travel along; it took a join of its own."""
    frame, joins, tables = type(spark.range(1)), [], []
    join, write = frame.join, graph.stored
    monkeypatch.setattr(frame, "join", lambda self, *a, **b: joins.append(1) or join(self, *a, **b))
    monkeypatch.setattr(graph, "stored", lambda df, name: tables.append(name) or write(df, name))
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 100), (None, 7)], "a long, b long")
    found = {(r.node, r.component) for r in graph.connected_components(path, "a", "b").collect()}
    assert found == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert len(joins) == 3 * (tables.count("labels") - 1) / 2
