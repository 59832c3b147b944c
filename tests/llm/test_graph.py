import random

from tessera.llm import graph
from tessera.llm.graph import connected_components


def test_against_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3), (3, None)] + [(2000, 2001 + i) for i in range(200)]
    edges += edges[:20]
    root: dict[int, int] = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_no_round_once_edges_are_stars(spark, monkeypatch):
    kept = []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: kept.append(label) or stored(df, label))
    # stars, the core's own star and no core at all: each of the driver's rounds costs it dozens of threads and plans
    for edges in ([(9, 1), (8, 1), (7, 2)], [(9, 1), (9, 2), (8, 2)], []):
        kept.clear()
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: 2 if edges[1:] and x in (7, 2) and len(edges) == 3 and edges[2] == (7, 2) else 1 for e in edges for x in e}
        assert kept == ["edges", "drawn", "edges", "leaves"]
