"""Polygons, rings and components at their edges, against brute force."""

import random

import pytest

from tessera.operators import geometry, rings
from tessera.operators.components import components, grid_components

RND = random.Random(4)


def cells(spark, rows):
    return spark.createDataFrame(rows, "r long, c long")


def flood(mask, width):
    out, left = {}, set(mask)
    while left:
        group, todo = set(), [min(left)]
        while todo:
            r, c = todo.pop()
            if (r, c) in left:
                left.discard((r, c))
                group.add((r, c))
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        for r, c in group:
            out[(r, c)] = min(a * width + b for a, b in group)
    return out


def test_tiles_give_the_components_of_the_whole(spark):
    mask = {(r, c) for r in range(30) for c in range(30) if RND.random() < 0.62}
    mask |= {(40, c) for c in range(30)} | {(r, 29) for r in range(30, 41)}
    got = grid_components(cells(spark, [*mask, (40, 0), (None, 1), (1, None)]), 30, tile=7)
    assert {(r.r, r.c): r.blob for r in got.collect()} == flood(mask, 30)
    assert grid_components(cells(spark, []), 30).collect() == []


def test_components_of_a_graph(spark):
    edges = [(i, i + 1) for i in range(60, 10, -1)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 11 for i in range(11, 62)}, 200: 11, 100: 100, 101: 100}


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2


def test_rings_of_blobs_with_holes_and_pinches(spark):
    shape = ["#####", "#.#.#", "###.#", "#..##", "#####", ".#...", "#.#.."]
    mask = [(r, c) for r, row in enumerate(shape) for c, v in enumerate(row) if v == "#"]
    blobs = grid_components(cells(spark, mask), 5)
    sizes = {r.blob: r["count"] for r in blobs.groupBy("blob").count().collect()}
    got = {}
    for r in rings.blob_rings(blobs, 5).orderBy("blob", "ring", "pos").collect():
        got.setdefault((r.blob, r.ring, r.hole), []).append((r.x, r.y))
    areas = {k: area(v) for k, v in got.items()}
    assert all((a < 0) == k[2] for k, a in areas.items())
    assert {b: sum(a for k, a in areas.items() if k[0] == b) for b in sizes} == sizes
    assert sum(k[2] for k in got) == 2  # the blob does not pass between holes that meet at a corner, so they have one outline
    assert got[next(k for k in got if k[0] == 30)] == [(0, 6), (1, 6), (1, 7), (0, 7)]


def test_ways_whichever_way_round(spark):
    ways = [(1, "a", "b"), (2, "c", "b"), (3, "c", "a"), (4, "x", "x"), (5, "p", "q"), (6, "q", "p"), (7, "m", "n"), (8, "n", "o"), (10, "u", "v"), (11, "v", "u"), (12, "u", "v"), (13, None, "z")]
    df = spark.createDataFrame(ways, "id long, a string, b string")
    placed = rings.stitched(df)
    got = {}
    for r in placed.orderBy("ring", "pos").collect():
        got.setdefault(r.ring, []).append((r.id, r.forward))
    assert got == {1: [(1, True), (2, False), (3, True)], 4: [(4, True)], 5: [(5, True), (6, True)]}
    assert sorted(r.id for r in rings.unclosed(df, placed).collect()) == [7, 8, 10, 11, 12, 13]
    assert rings.stitched(df.limit(0)).collect() == []


def star(n):
    import math

    return [(500 + (400 if i % 2 else 150 + 40 * (i % 5)) * math.cos(2 * math.pi * i / n), 500 + (400 if i % 2 else 150) * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("shape", ["star", "square", "none"])
def test_containment_and_shore_against_every_edge(spark, shape):
    outline = {"star": [star(61), star(9)[::-1]], "square": [[(100, 100), (900, 100), (900, 900), (100, 900)], [(300, 300), (600, 300), (600, 600), (300, 600)]], "none": []}[shape]
    edges = [(i, *map(float, (*r[j], *r[(j + 1) % len(r)]))) for i, r in enumerate(outline) for j in range(len(r))]
    points = [(i, RND.uniform(-200, 1200), RND.uniform(-200, 1200)) for i in range(400)] + [(900, None, 1.0), (901, 5e6, 500.0), (902, 500.0, 1e6), (903, 300.0, 50.0), (904, 900.0, 50.0)]

    def brute(x, y):
        if x is None:
            return False, None
        odd, best = False, None
        for _, a, b, c, d in edges:
            if (b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b):
                odd = not odd
            t = max(0, min(1, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
            m = ((x - a - t * (c - a)) ** 2 + (y - b - t * (d - b)) ** 2) ** 0.5
            best = m if best is None else min(best, m)
        return odd, None if best is None else pytest.approx(best)

    polygon = spark.createDataFrame(edges, "ring int, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: (r.inside, r.shore_m) for r in geometry.inside_and_shore(spark.createDataFrame(points, "id long, x double, y double"), polygon).collect()}
    assert got == {i: brute(x, y) for i, x, y in points}
    if edges:
        nodes = {(r.r, r.c) for r in geometry.raster_mask(polygon, 37.0).collect()}
        assert nodes == {(r, c) for r in range(-5, 40) for c in range(-5, 40) if brute(c * 37.0, r * 37.0)[0]}


def test_points_on_edges_and_corners_count_as_in_the_plain_sum(spark):
    outline = [[(8, 4), (6, 6), (4, 8), (2, 6), (0, 4), (2, 2), (4, 0), (6, 2)], [(3, 3), (5, 3), (5, 5), (3, 5)], [(0, 7), (3, 9), (1, 9)]]
    edges = [(i, *map(float, (*r[j], *r[(j + 1) % len(r)]))) for i, r in enumerate(outline) for j in range(len(r))]
    points = [(i, i % 21 / 2, i // 21 / 2) for i in range(21 * 21)]
    got = geometry.inside(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(edges, "ring int, x0 double, y0 double, x1 double, y1 double"))
    assert {r.id: r.inside for r in got.collect()} == {i: sum((b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b) for _, a, b, c, d in edges) % 2 == 1 for i, x, y in points}
