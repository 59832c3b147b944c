"""Lines, points along them and joins by distance at their edges: nothing, one row, ties, repeats, nulls."""

import math

import pytest

from tessera.operators import geometry, raster, spatial
from tessera.operators.components import grid_components

GRID = "r long, c long, ft double"


def lines(spark, cells, level=5.0):
    out = {}
    for p in raster.polylines(raster.marching_squares(spark.createDataFrame(cells, GRID), [level]), 400.0).orderBy("line", "pos").collect():
        out.setdefault(p.line, []).append(p)
    return list(out.values())


def test_a_peak_is_a_closed_line(spark):
    (ring,) = lines(spark, [(r, c, 10.0 if (r, c) == (1, 1) else 0.0) for r in range(3) for c in range(3)])
    assert [p.pos for p in ring] == [0, 1, 2, 3, 4] and all(p.closed for p in ring)
    assert (ring[0].x, ring[0].y) == (ring[-1].x, ring[-1].y)
    for a, b in zip(ring, ring[1:], strict=False):
        assert b.step == pytest.approx(math.hypot(a.x - b.x, a.y - b.y)) == pytest.approx(math.sqrt(0.5))


def test_a_slope_is_an_open_line_whatever_its_length(spark):
    (line,) = lines(spark, [(r, c, 10.0 * r) for r in range(2) for c in range(70)])
    assert [(p.pos, p.closed) for p in line] == [(i, False) for i in range(70)]
    assert [p.x for p in line] in (list(map(float, range(70))), list(map(float, range(69, -1, -1)))) and {p.y for p in line} == {0.5}


def test_short_and_missing_lines(spark):
    assert lines(spark, [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 10.0), (1, 1, 10.0)]) == []  # two points are no line
    assert lines(spark, [(0, 0, 0.0), (0, 1, None), (1, 0, 10.0), (1, 1, 10.0)]) == []
    assert lines(spark, []) == []


def test_corners_on_the_level(spark):
    cells = [(r, c, 5.0 if (r + c) % 2 else 10.0 * (r == c)) for r in range(4) for c in range(4)]
    segments = raster.marching_squares(spark.createDataFrame(cells, GRID), [5.0])
    kept = segments.where("round(x0 * 400) <> round(x1 * 400) or round(y0 * 400) <> round(y1 * 400)")
    points = raster.polylines(segments, 400.0)
    assert points.where("step is not null").count() <= kept.count() and points.groupBy("line", "pos").count().where("count > 1").count() == 0


def test_points_along_lines(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 30.0, 0.0), (1, 3, 30.0, 14.0), (2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0), (3, 0, 1.0, 1.0)]
    v = spark.createDataFrame(rows, "id long, seq int, x double, y double")
    assert sorted(map(tuple, geometry.placed_along(v, 22.0).collect())) == [(1, 0, 0.0, 0.0), (1, 1, 22.0, 0.0)]
    assert geometry.placed_along(v, 11.0).count() == 4
    assert geometry.placed_along(v.limit(0), 22.0).collect() == [] == geometry.densified(v.limit(0), 22.0).collect()


def test_representative_points_avoid_holes(spark):
    square = lambda low, high: [(low, low), (high, low), (high, high), (low, high)]
    rows = [(7, ring, i, float(x), float(y)) for ring, s in enumerate((square(0, 10), square(1, 8))) for i, (x, y) in enumerate(s)]
    e = geometry.ring_edges(spark.createDataFrame(rows, "id long, ring int, seq int, x double, y double"))
    assert [tuple(r) for r in geometry.representative_points(e).collect()] == [(7, 9.0, 5.0)]
    assert geometry.representative_points(e.limit(0)).collect() == []


def test_boxes_and_polygons(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = [(1, ring, i, a + ring * (4 - 0.8 * a), b + ring * (4 - 0.8 * b)) for ring in (0, 1) for i, (a, b) in enumerate(square)]  # a hole from 4 to 6
    e = geometry.ring_edges(spark.createDataFrame(rows, "id long, ring int, seq int, x double, y double"))
    from pyspark.sql import functions as F

    def meets(*box):
        return [r.meets for r in geometry.meets_box(e, *[F.lit(float(v)) for v in box]).collect()]

    assert meets(1, 1, 2, 2) == [True] and meets(-5, -5, 20, 20) == [True] and meets(-5, 3, 20, 4) == [True]  # inside, around, through
    assert meets(4.5, 4.5, 5.5, 5.5) == [False] and meets(11, 0, 12, 9) == [False]  # in the hole, beside
    assert meets(10, 10, 12, 12) == [True]  # a corner touches
    assert geometry.meets_box(e.limit(0), *[F.lit(0.0)] * 4).collect() == []


def test_distance_joins(spark):
    at = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    a, none = at([(1, 0.0, 0.0), (2, None, 0.0), (3, -7.0, 0.0)]), at([])
    b = at([(5, 3.0, 4.0), (4, -3.0, -4.0), (6, 3.0, 4.0), (7, 0.0, None)])
    assert sorted((r.l_id, r.r_id, r.d) for r in spatial.distance_join(a, b, 5.0).collect()) == [(1, 4, 5.0), (1, 5, 5.0), (1, 6, 5.0)]
    assert [(r.l_id, r.r_id) for r in spatial.nearest_within(a, b, 5.0).collect()] == [(1, 4)]  # of ties the smallest id
    assert sorted(r.id for r in spatial.has_none_within(a, b, 5.0).collect()) == [2, 3]
    assert spatial.distance_join(a, none, 5.0).collect() == spatial.nearest_within(none, b, 5.0).collect() == spatial.nearest(a, none, 5.0).collect() == []


def test_components_of_nothing_and_of_repeats(spark):
    cells = lambda rows: spark.createDataFrame(rows, "r long, c long")
    assert grid_components(cells([]), 10).collect() == []
    got = {(r.r, r.c): r.blob for r in grid_components(cells([(0, 9), (1, 0), (1, 1), (1, 1), (2, 2)]), 10).collect()}
    assert got == {(0, 9): 9, (1, 0): 10, (1, 1): 10, (2, 2): 22}
