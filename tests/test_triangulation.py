"""Triangles against the empty-circle rule tried on every triple, and the surface over them."""

import itertools
import random

import pytest

from tessera.operators.triangulation import _in_circle, _turn, convex_hull, interpolated, triangles

SCHEMA = "id long, x double, y double"


def brute(rows):
    held = {}
    for i, x, y in rows:
        if x is not None and y is not None:
            held[(x, y)] = min(held.get((x, y), i), i)
    points = sorted((i, x, y) for (x, y), i in held.items())
    out = []
    for t in itertools.combinations(points, 3):
        a, b, c = ((x, y, i) for i, x, y in t)
        turn = _turn(a[:2], b[:2], c[:2])
        if turn:
            ring = (a, b, c) if turn > 0 else (a, c, b)
            if not any(_in_circle(*ring, d) for d in ((x, y, i) for i, x, y in points) if d not in (a, b, c)):
                out.append(tuple(p[0] for p in t))
    return sorted(out)


def cloud(kind):
    rnd = random.Random(11)
    if kind == "lattice":
        return [(i, float(i % 6 * 3), float(i // 6 * 3)) for i in random.Random(1).sample(range(36), 36)]
    if kind == "crowd":
        return [(i, rnd.uniform(0, 100), rnd.uniform(0, 60)) for i in range(20)] + [(100 + i, 50 + rnd.random() / 100, 30 + rnd.random() / 100) for i in range(20)]
    if kind == "shore":
        return [(i, float(i), 0.0) for i in range(15)] + [(50 + i, float(i), 40.0) for i in range(12)] + [(80, 7.0, 90.0), (81, 7.0, 91.0), (82, 7.0, 91.0), (83, None, 1.0), (84, 1.0, None)]
    return [(i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(45)]


@pytest.mark.parametrize("kind", ["random", "crowd", "lattice", "shore"])
def test_triangles_against_every_triple(spark, kind):
    rows = cloud(kind)
    got = triangles(spark.createDataFrame(rows, SCHEMA), tile=6)
    assert sorted((r.a, r.b, r.c) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, 1.0, 1.0)], [(1, 0.0, 0.0), (2, 1.0, 1.0)], [(i, float(i), 2.0 * i) for i in range(30)], [(1, None, 1.0)]])
def test_no_triangles(spark, rows):
    assert triangles(spark.createDataFrame(rows, SCHEMA), tile=4).collect() == []


def test_surface_of_a_plane_and_its_edge(spark):
    rnd = random.Random(2)
    rows = [(i, x, y, 2 * x - 3 * y + 7) for i, (x, y) in enumerate([(0.0, 0.0), (50.0, 0.0), (0.0, 40.0), (50.0, 40.0)] + [(rnd.uniform(0, 50), rnd.uniform(0, 40)) for _ in range(60)])]
    rows += [(900, 25.0, 20.0, None)]
    got = {(r.r, r.c): r.v for r in interpolated(spark.createDataFrame(rows, SCHEMA + ", v double"), "v", 5.0).collect()}
    assert set(got) == {(r, c) for r in range(9) for c in range(11)}
    assert all(abs(v - (2 * c * 5 - 3 * r * 5 + 7)) < 1e-6 for (r, c), v in got.items())


def test_hull_leaves_out_points_on_sides():
    assert set(convex_hull([(0, 0), (1, 0), (2, 0), (2, 2), (1, 1), (0, 2), (0, 1)])) == {(0, 0), (2, 0), (2, 2), (0, 2)}
